"""Errors of rule files."""


class RuleError(ValueError):
    """A rule file that can't be used; the message names the rule and never shows a pattern."""
