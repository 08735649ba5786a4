"""Globs over key paths, file paths and names as anchored regular expressions, and sets of file globs.

A pattern is read one segment at a time. `*` and `?` stay within a segment. `**` at the end of a segment stands for any
number of whole segments; as the last segment it also matches nothing at all, separator included.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(pattern: str, separator: str | None = ".") -> str:
    """The regular expression of a glob; without a separator the whole text is one segment."""
    sep = re.escape(separator) if separator else ""
    one = f"[^{sep}]" if separator else "."
    wild = {"**": ".*", "*": one + "*", "?": one}

    def plain(text: str) -> str:
        return re.sub(r"\*\*|[*?]|[^*?]+", lambda m: wild.get(m[0]) or re.escape(m[0]), text)

    segments = pattern.split(separator) if separator else [pattern]
    *inner, final = segments
    body, joint = "", ""
    for segment in inner:
        stars = len(segment) - len(segment.rstrip("*"))
        if stars and stars % 2 == 0:
            body, joint = f"{body}{joint}{plain(segment[:-2])}(?:{one}+{sep})*", ""
        else:
            body, joint = body + joint + plain(segment), sep
    body += f"(?:{sep}.*)?" if final == "**" and joint else joint + plain(final)
    return rf"\A(?s:{body})\z"


def python(expression: str) -> re.Pattern:
    """An expression of this module for Python's engine, which writes the end of the text in another way."""
    return re.compile(expression.replace(r"\z", r"\Z"))


def any_of(expressions: Iterable[str]) -> str | None:
    """One expression for several; None for none."""
    some = [f"(?:{x})" for x in expressions]
    return "|".join(some) if some else None


def normalize(path: str) -> str:
    """A path without `.`, empty and `..` segments; a `..` that has nothing to go up from stays."""
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out)


def file_glob(pattern: str) -> str:
    """A line of a list of files as an expression over relative paths: a pattern without a slash matches at any depth,
    one with a slash from the base, and one that ends in a slash all that lies below."""
    pattern = pattern.strip()
    body = pattern.lstrip("/")
    if pattern.endswith("/"):
        body += "**"
    return glob(body if "/" in pattern.rstrip("/") else f"**/{body}", "/")


@dataclass(frozen=True)
class FileGlobs:
    """Files under a base directory that a pattern names and no exclusion does."""

    patterns: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    base: str = ""

    @classmethod
    def of(cls, lines: Iterable[str], base: str = "", excluded: Iterable[str] = ()) -> FileGlobs:
        """From a list in which `!pattern` excludes."""
        lines = list(lines)
        return cls(tuple(x for x in lines if not x.startswith("!")), (*(x[1:] for x in lines if x.startswith("!")), *excluded), base)

    @property
    def is_empty(self) -> bool:
        return not self.patterns

    def relative(self, path: str) -> str | None:
        """The path from the base; None outside it."""
        if not self.base:
            return normalize(path)
        base, whole = normalize(os.path.abspath(self.base)), normalize(path if path.startswith("/") else os.path.join(os.path.abspath(self.base), path))
        return whole[len(base) :].lstrip("/") if whole == base or whole.startswith(base.rstrip("/") + "/") else None

    def matches(self, path: str) -> bool:
        """Whether the path, as written or with its links followed, is meant."""
        return any(self._hits(p) for p in {path, os.path.realpath(os.path.join(self.base, path)) if self.base else path})

    def _hits(self, path: str) -> bool:
        rest = self.relative(path)
        if rest is None:
            return False
        hit = lambda some: any(python(file_glob(p)).search(rest) for p in some)
        return hit(self.patterns) and not hit(self.excluded)

    def column(self, relative: Column) -> Column:
        """The same over a column of paths relative to the base; a null path is not meant."""
        wanted, spared = any_of(map(file_glob, self.patterns)), any_of(map(file_glob, self.excluded))
        out = relative.rlike(wanted) if wanted else F.lit(False)
        return F.coalesce(out & ~relative.rlike(spared) if spared else out, F.lit(False))


@dataclass(frozen=True)
class FileKeyPaths:
    """Key paths that are allowed in some files only, written FILE#KEY.PATH."""

    rules: tuple[tuple[str, str], ...] = ()
    base: str = ""

    @classmethod
    def of(cls, lines: Iterable[str], base: str = "") -> FileKeyPaths:
        rules = []
        for line in lines:
            file, mark, keys = line.partition("#")
            if not mark or not file or not keys:
                raise ValueError(f"allow.file_paths: {line!r} is not of the form FILE#KEY.PATH")
            rules.append((file, keys))
        return cls(tuple(rules), base)

    def for_file(self, path: str | None) -> list[str]:
        """The key paths allowed in this file."""
        return [keys for file, keys in self.rules if path and FileGlobs((file,), (), self.base).matches(path)]
