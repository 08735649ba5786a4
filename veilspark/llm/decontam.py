"""Benchmark decontamination under edit distance.

An item is contaminated where a window of a document lies within `rate` of the item's words in edit distance. The
search runs per item size over all windows of that size in whole texts:

1. A window within k edits of an item of w words shares at least w-2-3k of its three-word runs with it (below that,
   w-k of its words). Counting such runs in every window is an exact first filter.
2. The windows left, and the items, are embedded by CGK random walks: reading position i moves on by a random bit that
   depends on step and symbol, so a few edits change few steps of the walk and edit distance becomes Hamming distance.
3. Bit-sampling tables over the embeddings pair windows with items; walks and tables are repeated until a pair at the
   largest allowed distance is found with probability `recall`. The success rate is measured for each item size, on
   items of that size, edited at random at that distance. Where MOST tables don't reach the target, all items that
   share a run with a window are its candidates, which misses none.
4. Candidates are verified by exact edit distance over words, against the nearest stretch around the windows found.

The items are held by every worker; `search` checks their size first (`max_item_bytes`) and deals them in blocks
beyond it. Null and empty texts hold no item, and items without words are found nowhere. Repeated rows are each
reported; items of one id, or without one, are reported once per document, at the nearest. An empty table on either
side gives no rows (`drop_contaminated`: drops none). Other columns are not read, and pass through `drop_contaminated`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mix, words_of

GRAM = 3
SAMPLED = 3
#: Tables that share one walk, and the number of tables from which candidates by shared runs are cheaper.
PER_WALK, MOST = 8, 512


def nearest_end(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(edit distance, end) of the stretch of region nearest to item over all starts and ends; the first such end."""
    columns = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item.tolist()):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (region != word))
        new[0] = i + 1
        row = np.minimum.accumulate(new - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


def _steps(w: int) -> int:
    """Steps of a walk over w symbols that it takes before its end, but for a few walks in a hundred."""
    return max(1, int(2 * w - 2 * (2 * w) ** 0.5))


def _walk(symbols: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings of the rows of symbols (n, w): (n, steps), zero where a walk has run past the end."""
    n, w = symbols.shape
    at, out = np.zeros(n, np.int64), np.zeros((n, _steps(w)), np.uint64)
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
    every = np.arange(n)
    for step in range(out.shape[1]):
        read = padded[every, at]
        out[:, step] = read
        bit = (mix(read * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + step + 1)) >> np.uint64(17)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), w)
    return out


def table_keys(symbols: np.ndarray, tables: int, first: int = 0) -> np.ndarray:
    """(n, tables - first) keys: SAMPLED positions of an embedding each, PER_WALK tables to a walk."""
    n, w = symbols.shape
    out = np.empty((n, tables - first), np.uint64)
    for t in range(first, tables):
        if t == first or t % PER_WALK == 0:
            embedded = _walk(symbols, t // PER_WALK)
        key = np.full(n, t + 1, np.uint64)
        for p in np.random.default_rng((w, t)).integers(0, embedded.shape[1], SAMPLED):
            key = mix(key + embedded[:, p])
        out[:, t - first] = key
    return out


def edited(words: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """Words after random replacements, insertions and deletions."""
    words = list(words)
    for kind, p in zip(rng.integers(0, 3, edits).tolist(), rng.integers(0, 1 << 30, edits).tolist(), strict=True):
        new = int(rng.integers(1, 1 << 62))
        if kind == 1:
            words.insert(p % (len(words) + 1), new)
        elif kind == 0 or len(words) == 1:
            words[p % len(words)] = new
        else:
            del words[p % len(words)]
    return words


def tables_for(items: list[np.ndarray], edits: int, recall: float, trials: int = 1500) -> int:
    """Tables (a power of two) at which items of one size with `edits` random edits are found with the given rate; 0
    where MOST don't do."""
    w = len(items[0])
    rng = np.random.default_rng(w + 5)
    plain = [items[n % len(items)] for n in range(trials)]
    other = [(edited(x.tolist(), edits, rng) + rng.integers(1, 1 << 62, w).tolist())[:w] for x in plain]
    a, b = np.array(plain, np.uint64), np.array(other, np.uint64)
    met, known, tables = np.zeros(trials, bool), 0, 16
    while tables <= MOST:
        met |= (table_keys(a, tables, known) == table_keys(b, tables, known)).any(axis=1)
        if met.mean() >= recall:
            return tables
        known, tables = tables, 2 * tables
    return 0


def _by_id(row: tuple) -> tuple:
    return row[0] is not None, row[0] or 0, row[1] or ""


class Items:
    """The benchmark by item size: grams for the exact filter, tables of keys, and words for verification."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, tables: dict[int, int]):
        self.vocabulary: dict[bytes, int] = {}
        self.sizes: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for item, text in sorted(rows, key=_by_id):
            words = words_of(text or "")
            if words:
                self.sizes[len(words)].append((item, tuple(self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words)))
        self.symbol = np.random.default_rng(3).integers(1, 1 << 62, len(self.vocabulary) + 1, dtype=np.uint64)
        self.rate = rate
        self.tables: dict[int, tuple[int, dict[int, list[int]], np.ndarray]] = {}
        grams: dict[int, set[int]] = defaultdict(set)
        for w, items in self.sizes.items():
            symbols = self.symbol[np.array([x for _, x in items])]
            index: dict[int, list[int]] = defaultdict(list)
            keys = table_keys(symbols, tables.get(w, 1)) if tables.get(w, 1) else self._runs(w, np.array([x for _, x in items]))
            for i, row in enumerate(keys.tolist()):
                for key in set(row):
                    index[key].append(i)
            self.tables[w] = (tables.get(w, 1), dict(index), np.array(sorted(index), np.uint64))
            if self.needed(w)[0] == GRAM:
                for g in np.unique(self.gram_codes(np.array([x for _, x in items]))).tolist():
                    grams[g].add(w)
        self.grams = np.array(sorted(grams), np.int64)
        self.gram_sizes = [sorted(grams[g]) for g in self.grams.tolist()]

    def needed(self, w: int) -> tuple[int, int]:
        """(gram size, how many of a window's grams must be the item's) for w words and rate * w edits."""
        k = int(self.rate * w)
        return (GRAM, w - GRAM + 1 - GRAM * k) if w - GRAM + 1 - GRAM * k > 0 else (1, w - k)

    def gram_codes(self, codes: np.ndarray) -> np.ndarray:
        """One number per run of GRAM word codes along the last axis; 0 where a word is outside the vocabulary."""
        n = codes.shape[-1] - GRAM + 1
        out, whole = np.zeros((*codes.shape[:-1], n), np.int64), np.ones((*codes.shape[:-1], n), bool)
        for i in range(GRAM):
            part = codes[..., i : i + n]
            out = out * (len(self.vocabulary) + 1) + part
            whole &= part > 0
        return out * whole

    def _runs(self, w: int, codes: np.ndarray) -> np.ndarray:
        """The runs of each row that count for the filter, as keys; a window within reach of an item shares one at least."""
        return (codes if self.needed(w)[0] == 1 else self.gram_codes(codes)).astype(np.uint64)

    def _starts(self, w: int, places: np.ndarray) -> np.ndarray:
        """Window starts with enough grams, from the sorted places of grams of items of w words."""
        gram, need = self.needed(w)
        if len(places) < need:
            return np.empty(0, np.int64)
        first, last = places[: len(places) - need + 1], places[need - 1 :]
        ok = last - first <= w - gram
        low, count = last[ok] - (w - gram), first[ok] - last[ok] + w - gram + 1
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(np.repeat(low, count) + steps)

    def find(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each text, item -> (smallest distance, first word of that window)."""
        get = self.vocabulary.get
        split = [words_of(t) for t in texts]
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.sizes or not texts:
            return out
        widest = max(self.sizes)
        gap = [0] * (2 * widest)  # windows never hold words of two texts
        coded = gap.copy()
        for words in split:
            coded.extend(map(get, words, repeat(0)))
            coded.extend(gap)
        joined = np.array(coded, np.int64)
        sizes = np.array(list(map(len, split)))
        starts = len(gap) + np.cumsum(sizes + len(gap)) - (sizes + len(gap))
        places: dict[int, np.ndarray] = {}
        candidates: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        if len(self.grams):
            codes = self.gram_codes(joined)
            at = np.flatnonzero(codes)
            which = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
            hit = self.grams[which] == codes[at]
            by_size: dict[int, list[int]] = defaultdict(list)
            for p, g in zip(at[hit].tolist(), which[hit].tolist(), strict=True):
                for w in self.gram_sizes[g]:
                    by_size[w].append(p)
            places = {w: np.array(p, np.int64) for w, p in by_size.items()}
        for w, items in self.sizes.items():
            k = int(self.rate * w)
            if self.needed(w)[0] == 1:
                places[w] = np.flatnonzero(np.isin(joined, [x for _, words in items for x in words]))
            at = self._starts(w, places.get(w, np.empty(0, np.int64)))
            n, index, keys = self.tables[w]
            for block in range(0, len(at), 20_000):
                some = at[block : block + 20_000]
                window = joined[some[:, None] + np.arange(w)]
                found = table_keys(self.symbol[window] * (window > 0), n) if n else self._runs(w, window)
                hit = (keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found) & (found > 0)
                for i in np.flatnonzero(hit.any(axis=1)).tolist():
                    at_word = int(some[i])
                    doc = max(0, int(np.searchsorted(starts, at_word + w // 2, side="right")) - 1)
                    for j in {j for key in found[i][hit[i]].tolist() for j in index[key]}:
                        candidates[doc, w, j].append(at_word)
        for (doc, w, j), at in candidates.items():
            self._verify(out[doc], joined, at, w, self.sizes[w][j], int(starts[doc]), int(starts[doc] + sizes[doc]))
        return out

    def _verify(self, found: dict, joined: np.ndarray, at: list[int], w: int, item: tuple, low: int, high: int) -> None:
        """Exact distance of the item to the nearest stretch of its document around each cluster of windows."""
        name, words = item
        k = int(self.rate * w)
        item_words = np.array(words, np.int64)
        at = sorted(at)
        best = found.get(name, (k + 1, 0))
        first = 0
        for i in range(1, len(at) + 1):
            if i < len(at) and at[i] - at[i - 1] <= w:
                continue
            a, b = max(at[first] - k, low), min(at[i - 1] + w + k, high)
            first = i
            if b <= a or best[0] == 0:
                continue
            distance, end = nearest_end(item_words, joined[a:b])
            if distance < best[0]:
                _, size = nearest_end(item_words[::-1], joined[a : a + end][::-1])
                best = found[name] = (distance, a + end - size - low)


def plan_tables(rows: list[tuple[int, str]], rate: float, recall: float) -> dict[int, int]:
    """Number of tables for each item size that allows edits."""
    rng = np.random.default_rng(3)
    sizes: dict[int, list] = defaultdict(list)
    for _, text in sorted(rows, key=_by_id):
        if words := words_of(text or ""):
            sizes[len(words)].append(rng.integers(1, 1 << 62, len(words), dtype=np.uint64))
    return {w: tables_for(items, int(rate * w), recall) for w, items in sizes.items() if int(rate * w)}


def search(df: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_item_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, distance, item_words, at_word) of each document and item with a window within rate."""
    docs = common.id_text(df, id_col, text_col)
    out = None
    for shared in _item_blocks(benchmark, rate, recall, item_col, item_text, max_item_bytes):
        found = docs.mapInArrow(_searcher(shared, rate), "doc_id long, item_id long, distance long, item_words long, at_word long")
        out = found if out is None else out.union(found)
    return out


def _item_blocks(benchmark: DataFrame, rate: float, recall: float, item_col: str, item_text: str, max_item_bytes: int) -> Iterator:
    """(name, broadcast) of the items in blocks of max_item_bytes or so, however many there are; those of one id together."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-total // max_item_bytes) or 1
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = [(r.item, r.words) for r in part.collect()]
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast((rows, plan_tables(rows, rate, recall)))


def _items(block, rate: float) -> Items:
    """The items of a block, made ready once per Python worker."""
    name, shared = block
    return common.held(("decontam", name, rate), lambda: Items(shared.value[0], rate, shared.value[1]))


def _searcher(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared, rate)
        words = {i: w for w, rows in items.sizes.items() for i, _ in rows}
        for ids, texts in common.texts_of(batches):
            rows = [(doc, item, d, words[item], at) for doc, hits in zip(ids, items.find(texts), strict=True) for item, (d, at) in sorted(hits.items(), key=lambda x: _by_id((x[0], None)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "distance", "item_words", "at_word"])

    return run


def drop_contaminated(df: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99, text_col: str = "text", item_text: str = "text", max_item_bytes: int = 8 << 20) -> DataFrame:
    """The rows of df whose text holds no item, with all their columns. One pass per block of items, no shuffle."""
    at = df.schema.fieldNames().index(text_col)
    schema = df.schema
    for shared in _item_blocks(benchmark, rate, recall, "item_id", item_text, max_item_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(shared, rate)
            for batch in batches:
                for part in common.slices(batch, at):
                    hits = items.find([t or "" for t in part.column(at).to_pylist()])
                    yield part.filter(pa.array([not h for h in hits], pa.bool_()))

        df = df.mapInArrow(run, schema)
    return df
