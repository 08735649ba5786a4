"""Overlapping literal lists: the match that ends first wins, then the longest; by Aho-Corasick in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from .spans import SPAN


def byte_offsets(text: str, places: Iterable[int]) -> Iterator[int]:
    """UTF-8 offsets of rising character offsets, in one pass."""
    at = size = 0
    for place in places:
        size += len(text[at:place].encode("utf-8", "surrogatepass"))
        at = place
        yield size


@lru_cache(maxsize=64)
def automaton(words: tuple[str, ...]):
    """Built once per worker and list."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, len(w))
    machine.make_automaton()
    return machine


def find_literals(text: str, words: Iterable[str]) -> list[tuple[int, int]]:
    """Byte spans of non-overlapping literals, by earliest end; empty ones are passed over."""
    words = tuple(sorted({w for w in words if w}))
    if not words:
        return []
    ends: dict[int, list[int]] = {}
    for last, n in automaton(words).iter(text):
        ends.setdefault(last + 1, []).append(n)
    marks, free = [], 0
    for end in sorted(ends):
        if fits := [n for n in ends[end] if end - n >= free]:
            marks += [end - max(fits), end]
            free = end
    places = list(byte_offsets(text, marks))
    return list(zip(places[::2], places[1::2], strict=True))


def spans_udf(words: list[str], label: str):
    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "label": label} for a, b in find_literals(t or "", words)])

    return run
