"""Replacement templates such as `[REDACTED-{n}]` or `[{reason}#{n}]`."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

REASON = "[A-Za-z0-9_][A-Za-z0-9_.:/-]*"


@dataclass(frozen=True)
class Template:
    """parts: literals and the fields "n" and "reason", in order."""

    parts: tuple[tuple[str, str], ...]
    source: str

    @classmethod
    def parse(cls, source: str = "[REDACTED-{n}]") -> Template:
        """One {n}, at most one {reason}, braces doubled; literal text at both ends and between the fields."""
        parts: list[tuple[str, str]] = []
        for piece in re.findall(r"\{\{|\}\}|\{[^{}]*\}|[{}]|[^{}]+", source):
            if piece in ("{n}", "{reason}"):
                parts.append(("field", piece[1:-1]))
            elif piece in ("{{", "}}") or piece[0] not in "{}":
                text = piece[0] if piece in ("{{", "}}") else piece
                parts[-1:] = [("text", parts[-1][1] + text)] if parts and parts[-1][0] == "text" else [*parts[-1:], ("text", text)]
            else:
                raise ValueError("replacement: unknown field or single brace")
        fields = [v for k, v in parts if k == "field"]
        if fields.count("n") != 1 or fields.count("reason") > 1:
            raise ValueError("replacement: exactly one {n} and at most one {reason} are needed")
        if parts[0][0] != "text" or parts[-1][0] != "text":
            raise ValueError("replacement: it must begin and end with literal text")
        for (k, v), (k2, v2) in zip(parts, parts[1:], strict=False):
            if k == k2 == "field":
                raise ValueError("replacement: fields need text between them")
            if v == "reason" and k == "field" and re.match("[A-Za-z0-9_.:/-]", v2):
                raise ValueError("replacement: {reason} must be followed by a character that no reason has")
            if v == "n" and k == "field" and v2[0].isdigit():
                raise ValueError("replacement: {n} must not be followed by a digit")
        return cls(tuple(parts), source)

    def token(self, n: int, reason: str = "") -> str:
        if n < 1:
            raise ValueError("numbers start at 1")
        if self._reasoned and not re.fullmatch(REASON, reason):
            raise ValueError("reason has characters outside its alphabet")
        return "".join(v if k == "text" else str(n) if v == "n" else reason for k, v in self.parts)

    def column(self, n: Column, reason: Column) -> Column:
        return F.concat(*[F.lit(v) if k == "text" else n.cast("string") if v == "n" else reason for k, v in self.parts])

    @cached_property
    def _reasoned(self) -> bool:
        return ("field", "reason") in self.parts

    @cached_property
    def pattern(self) -> str:
        """Matches tokens of this template, in Java and Python."""
        return "".join(re.escape(v) if k == "text" else "[1-9][0-9]*" if v == "n" else REASON for k, v in self.parts)

    def is_token(self, text: str) -> bool:
        return re.fullmatch(self.pattern, text) is not None

    def find_tokens(self, text: str) -> list[tuple[int, int]]:
        """Byte spans of the tokens in a text."""
        if self.parts[0][1] not in text:
            return []
        from .literals import byte_offsets

        marks = [x for m in re.finditer(self.pattern, text) for x in m.span()]
        places = list(byte_offsets(text, marks))
        return list(zip(places[::2], places[1::2], strict=True))
