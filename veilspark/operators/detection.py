"""Detectors as values: a native expression, a Python function over one value, or one over a whole document.

Native detectors run inside the scan. Python ones run in Arrow batches: over texts as a pandas UDF, over documents where
their leaves are put together. All give spans (start, end, label) in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import spans as S
from ..functions.globs import any_of, glob
from ..functions.literals import find_literals
from ..functions.tokens import Template


class Leaf(NamedTuple):
    """The columns, or in Python the values, that a detector sees. Free text has no key and an empty path."""

    value: Column | str
    key: Column | str | None = None
    path: Column | str = ""
    context: Column | bool | None = None


Spans = list[tuple[int, int, str]]


@dataclass(frozen=True)
class Detector:
    """id, and one of: native(leaf of columns) -> span array; python(leaf) -> spans; document(leaves) -> spans of each."""

    id: str
    native: Callable[[Leaf], Column] | None = None
    python: Callable[[Leaf], Spans] | None = None
    document: Callable[[list[Leaf]], list[Spans]] | None = None

    def labelled(self, label: str) -> Detector:
        """Reports under another label; a `:suffix` of its own label stays."""
        mine = lambda x: x == self.id or x.startswith(self.id + ":")
        fix = lambda found: [(a, b, label + x[len(self.id) :] if mine(x) else x) for a, b, x in found]
        return replace(
            self,
            native=self.native and (lambda leaf: D.relabel(self.native(leaf), self.id, label)),
            python=self.python and (lambda leaf: fix(self.python(leaf))),
            document=self.document and (lambda leaves: [fix(x) for x in self.document(leaves)]),
        )

    def column(self, leaf: Leaf) -> Column:
        """Spans of a text column; a document detector takes each text as a document of one leaf."""
        if self.native:
            return self.native(leaf)
        one = self.python or (lambda x: self.document([x])[0])

        @F.pandas_udf(S.SPAN)
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: [{"start": a, "end": b, "label": x} for a, b, x in one(Leaf(v))] if v else [])

        return run(leaf.value)


def entropy(threshold: float = 4.5, sensitive_threshold: float = 3.5, min_token_length: int = 10, sensitive_segments: Iterable[str] = D.P.SENSITIVE_SEGMENTS, structural_keys: Iterable[str] = D.P.STRUCTURAL_KEYS, hex_digest_lengths: Iterable[int] = D.P.HEX_LENGTHS) -> Detector:
    """Random-looking tokens, more readily below keys that name secrets."""
    segments, structural, lengths = tuple(sensitive_segments), tuple(structural_keys), tuple(hex_digest_lengths)
    if any(not s or s != D.plain_key(s) or "_" in s for s in segments):
        raise ValueError("entropy: a sensitive segment must be one word in lower case")
    if min_token_length < 2:
        raise ValueError("entropy: min_token_length must be 2 or more")
    if any(not k for k in structural):
        raise ValueError("entropy: a structural key must not be empty")
    return Detector("entropy", lambda leaf: D.entropy(leaf.value, leaf.key, threshold, sensitive_threshold, min_token_length, lengths, segments, structural))


def regex(patterns: Iterable[str], label: str = "regex") -> list[Detector]:
    """A detector per pattern, in the linear engine's dialect."""
    return [Detector("regex", lambda leaf, p=p: D.regex(leaf.value, [p], "regex")).labelled(label) for p in _checked(patterns)]


def _checked(patterns: Iterable[str]) -> list[str]:
    """The patterns; an error names the place of a bad one in the list and never shows it."""
    out = list(patterns)
    for n, p in enumerate(out, 1):
        try:
            D.P.check(p)
        except ValueError as x:
            raise D.P.PatternError(f"pattern {n} is not a valid expression: {x}") from None
    return out


def values(words: Iterable[str]) -> list[Detector]:
    """Listed literals; none for an empty list."""
    words = sorted({w for w in words if w})
    if not words:
        return []
    if len(words) > D.FEW_LITERALS or D._may_overlap(words):
        return [Detector("value", python=lambda leaf: [(a, b, "value") for a, b in find_literals(leaf.value, words)])]
    return [Detector("value", lambda leaf: D.values(leaf.value, words))]


def paths(globs: Iterable[str]) -> list[Detector]:
    """Whole values at key paths; none for an empty list."""
    globs = tuple(globs)
    return [Detector("path", lambda leaf: D.path(leaf.value, leaf.path if isinstance(leaf.path, Column) else F.lit(leaf.path), globs))] if globs else []


def email(allowlist: Iterable[str] = ()) -> Detector:
    allow = tuple(allowlist)
    return Detector("pii:email", lambda leaf: D.email(leaf.value, allow))


@dataclass(frozen=True)
class Placeholders:
    """The vocabulary of values that stand for credentials and aren't."""

    words: tuple[str, ...] = D.P.PLACEHOLDERS
    masks: str = D.P.MASKS
    mask_min: int = 3
    bracket_min: int = 5
    template: Template | None = None

    def is_placeholder(self, value: Column) -> Column:
        return D.is_placeholder(value, self.template, self.words, self.masks, self.mask_min, self.bracket_min)

    def has_real_value(self, value: Column) -> Column:
        return D.let(value, lambda v: (v != "") & ~self.is_placeholder(v))


def credentials(placeholders: Placeholders | None = None) -> dict[str, Detector]:
    """The four detectors that pass over placeholders."""
    real = (placeholders or Placeholders()).has_real_value
    return {
        "credentialed_uri": Detector("credentialed_uri", lambda leaf: D.credentialed_uri(leaf.value, real)),
        "connection_string": Detector("connection_string", lambda leaf: D.connection_string(leaf.value, real)),
        "credential_assignment": Detector("credential_assignment", lambda leaf: D.credential_assignment(leaf.value, real)),
        "credential_key": Detector("credential_key", lambda leaf: S.none() if leaf.key is None else D.credential_key(leaf.value, leaf.key, leaf.context, real)),
    }


SIMPLE = {"pii:phone": Detector("pii:phone", lambda leaf: D.phone(leaf.value)), "pii:address": Detector("pii:address", lambda leaf: D.address(leaf.value)), "provider_token": Detector("provider_token", lambda leaf: D.provider_token(leaf.value))}


def resolve(items: Iterable[str | Detector]) -> list[Detector]:
    """Detectors by name, with their usual settings; others as they are."""
    from ..rules.engine import starter

    made = {"entropy": entropy, "pii:email": email, "ruleset": starter} | {k: lambda d=d: d for k, d in (SIMPLE | credentials()).items()}
    out = []
    for x in items:
        if isinstance(x, str) and x not in made:
            raise ValueError(f"unknown detector {x!r}; known are {', '.join(sorted(made))}")
        out.append(made[x]() if isinstance(x, str) else x)
    return out


def allowed_paths(path: Column, globs: Iterable[str]) -> Column:
    """Whether a key path is one of those that are never scanned."""
    pattern = any_of(map(glob, globs))
    return path.rlike(pattern) if pattern else F.lit(False)
