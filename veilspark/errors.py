"""Errors of the library; none shows a secret or a user's pattern."""

from .functions.patterns import PatternError
from .rules.errors import RuleError
from .sources.formats import FormatError


class ConfigError(ValueError):
    """A configuration that can't be used."""


class ReplacementError(ConfigError):
    """A replacement template that can't be found again in a text."""


class DetectorError(RuntimeError):
    """A detector that failed on a document."""


class UnknownFormatError(FormatError):
    """A format that no parser is registered for."""


__all__ = ["ConfigError", "DetectorError", "FormatError", "PatternError", "ReplacementError", "RuleError", "UnknownFormatError"]
