"""Removal of long repeated passages: every byte covered by a string of `length` bytes that an earlier document has.

`column_wise` below is the column-wise construction of a collection's Burrows-Wheeler transform, over overlapping
segments and through sequential files. Each of its rounds passes over everything inserted so far, which costs more than
the limit of time allows (figures in the README), so it isn't the main path; the tests hold the main path against it.

The main path finds the same strings by content-defined routing. Every window of `length` bytes has a smallest
k-gram hash; equal windows have equal ones. Maximal runs of windows with the same smallest hash are the units:
chunks first ask which of their hashes any other document has; only runs of shared hashes are then sent, as the text
they cover, to the key range of their hash, where 128-bit hashes of all their windows meet and the smallest doc_id
of each is found. Answers are one bit per window. Equal runs of a chunk are sent once, so a group of copies costs
one run per chunk that holds some, not its size.

Null, empty and shorter texts lose nothing. Rows that repeat a doc_id count as that document and don't remove each
other; rows without an id count as one last document. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, common
from .shingles import mix

GRAM = 20
CHUNK_BYTES = 2 << 20
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram at each position, by joining grams of doubling length."""
    grams, size, out, have = _LETTER[0][data], 1, None, 0
    while True:
        if k & size:
            out = grams if out is None else out[: len(grams) - have] * np.uint64(_BASE[1]) + grams[have:] if have else grams
            have += size
        if size * 2 > k:
            return mix(out[: len(data) - k + 1])
        grams = mix(grams[: len(grams) - size] * np.uint64(_BASE[0]) + grams[size:])
        size *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, run hash, first window, number of windows, text index) of maximal equal-hash runs."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array(list(map(len, texts)), np.int64)
    starts = np.cumsum(sizes) - sizes
    none = np.empty(0, np.int64)
    if not len(data) or sizes.max() < length:
        return data, none.astype(np.uint64), none, none, none
    low = _sliding_min(_gram_hashes(data, GRAM), length - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    inside = np.arange(len(low)) <= (starts + sizes - length)[owner]
    new = np.empty(len(low), bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(inside.astype(np.int64), first)
    keep = count > 0
    first, count = first[keep], count[keep]
    return data, mix(low[first]), first, count, owner[first]  # minima are small numbers; mixed, they fill all key ranges alike


def window_hashes(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of the stretches of data that begin at starts and hold counts windows."""
    n = len(data)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out = []
    for letter, base in zip(_LETTER, _BASE, strict=True):
        powers = np.full(n, base, np.uint64)
        inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        powers[:1] = inverse[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letter[data] * powers, out=sums[1:])
        out.append(mix((sums[at + length] - sums[at]) * inverse[at]))
    return out[0], out[1]


def _order(ids: list) -> np.ndarray:
    """Ids as numbers to compare; a missing one comes last."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(types), 8)
    ends = np.cumsum(sizes) + 8 * (len(types) + 1)
    return [np.frombuffer(raw, t, int(s) // np.dtype(t).itemsize, int(e - s)) for t, s, e in zip(types, sizes, ends, strict=True)]


def _rows(rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "part", "chunk", "data"])


ROWS = "kind int, part int, chunk long, data binary"


def _short(keys: np.ndarray) -> bytes:
    """The upper 48 bits of each key, behind their number. Two hashes that agree in these are taken for shared, which
    only sends some text that turns out to be unshared."""
    return len(keys).to_bytes(4, "little") + np.ascontiguousarray((keys >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_short(data: bytes) -> tuple[np.ndarray, int]:
    """(keys, where they end)."""
    n = int.from_bytes(data[:4], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4).reshape(-1, 6)
    return out.view("<u8").reshape(-1), 4 + 6 * n


def _ask_hashes(table: DataFrame, parts: int, length: int) -> DataFrame:
    """The distinct run hashes of each chunk by key range, with a bit for those of several of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, texts = chunks.unpack(data.as_py())
                _, low, _, _, owner = runs_of(texts, length)
                keys, at = np.unique(low, return_inverse=True)
                doc = _order(ids)[owner]
                high = np.full(len(keys), np.iinfo(np.int64).min)
                least = np.full(len(keys), np.iinfo(np.int64).max)
                np.maximum.at(high, at, doc)
                np.minimum.at(least, at, doc)
                several = high > least
                rows = [(0, p, chunk, _short(keys[s]) + np.packbits(several[s]).tobytes()) for p, s in chunks.deal(keys, parts)]
                if rows:
                    yield _rows(rows)

    return table.mapInArrow(run, ROWS)


def _answer_hashes(asked: DataFrame) -> DataFrame:
    """For each chunk and key range: a bit per hash asked for, set if two documents or more have it."""

    def handle(part: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        who, keys, several = [], [], []
        for chunk, data in rows:
            mine, end = _from_short(data)
            who.append(chunk)
            keys.append(mine)
            several.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=end), count=len(mine)).astype(bool))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        twin = np.zeros(len(every), bool)
        same = ranked[1:] == ranked[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        shared = np.empty(len(every), bool)
        shared[order] = twin
        shared |= np.concatenate(several)  # every chunk that has such a hash has it with another document
        ends = np.cumsum([len(k) for k in keys])
        for chunk, end, k in zip(who, ends, keys, strict=True):
            yield _rows([(0, part, chunk, np.array([part, len(k)], np.int64).tobytes() + np.packbits(shared[end - len(k) : end]).tobytes())])

    return chunks.by_group(asked.select("part", "chunk", "data"), "part", handle, ROWS)


def _in_part_order(got: list[bytes]) -> np.ndarray:
    """Bits of the answers of all key ranges, joined in the order of the ranges."""
    out = []
    for data in sorted(got, key=lambda d: int.from_bytes(d[:8], "little")):
        n = int.from_bytes(data[8:16], "little")
        out.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=16), count=n).astype(bool))
    return np.concatenate(out) if out else np.empty(0, bool)


def _ask_windows(table: DataFrame, answers: DataFrame, parts: int, length: int) -> DataFrame:
    """kind 0: distinct runs of shared hashes, as text, with the smallest doc_id that has them in the chunk;
    kind 1: for the chunk itself, where each run lies and which of the sent ones it equals."""

    def handle(chunk: int, data: bytes, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = chunks.unpack(data)
        buffer, low, first, count, owner = runs_of(texts, length)
        if not len(low):
            return
        keys, at = np.unique(low, return_inverse=True)
        chosen = np.flatnonzero(_in_part_order(got)[at])
        if not len(chosen):
            return
        chosen = chosen[np.argsort(low[chosen], kind="stable")]
        low, first, count, doc = low[chosen], first[chosen], count[chosen], _order(ids)[owner[chosen]]
        raw = buffer.tobytes()
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(raw[f : f + c + length - 1], len(index)) for f, c in zip(first.tolist(), count.tolist(), strict=True)), np.int64, len(first))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        _, one = np.unique(which, return_index=True)
        rows = [(1, -1, chunk, _pack(first, count, which, (doc == least[which]).astype(np.uint8), count[one]))]
        bodies = list(index)
        for p, s in chunks.deal(low[one], parts):
            text = np.frombuffer(b"".join(bodies[s]), np.uint8)
            rows.append((0, p, chunk, _pack(count[one][s], least[s], text)))
        yield _rows(rows)

    return common.materialize(chunks.with_answers(table, answers, handle, ROWS), "runs")


def _answer_windows(asked: DataFrame, length: int) -> DataFrame:
    """For each chunk and key range: a bit per window sent, set if a smaller doc_id has it elsewhere."""

    def handle(part: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        who, h1, h2, docs = [], [], [], []
        for chunk, data in rows:
            count, least, text = _unpack(data, np.int64, np.int64, np.uint8)
            sizes = count + length - 1
            a, b = window_hashes(text, np.cumsum(sizes) - sizes, count, length)
            who.append((chunk, len(a)))
            h1.append(a)
            h2.append(b)
            docs.append(np.repeat(least, count))
        h1, h2, docs = np.concatenate(h1), np.concatenate(h2), np.concatenate(docs)
        order = np.argsort(h1, kind="stable")
        a, b = h1[order], h2[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # different windows of one 64-bit hash
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        bits = np.empty(len(order), bool)
        bits[order] = least < docs[order]
        end = 0
        for chunk, n in who:
            yield _rows([(0, part, chunk, np.array([part, n], np.int64).tobytes() + np.packbits(bits[end : end + n]).tobytes())])
            end += n

    return chunks.by_group(asked.filter("kind = 0").select("part", "chunk", "data"), "part", handle, ROWS)


def removed_runs(buffer: np.ndarray, plan: bytes | None, got: list[bytes], length: int) -> np.ndarray:
    """Mask of the bytes to remove from a chunk."""
    cover = np.zeros(len(buffer) + length + 1, np.int32)
    if plan is not None:
        first, count, which, smallest, sent = _unpack(plan, np.int64, np.int64, np.int64, np.uint8, np.int64)
        bits = _in_part_order(got)
        offset = (np.cumsum(sent) - sent)[which]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = bits[np.repeat(offset, count) + steps] | np.repeat(smallest == 0, count)
        start = (np.repeat(first, count) + steps)[hit]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
    return np.cumsum(cover)[: len(buffer)] > 0


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each row."""
    docs = common.id_text(df, id_col, text_col)
    parts = chunks.ranges(docs, 8)
    table = chunks.build(docs, "repeat-chunks", CHUNK_BYTES)
    shared = _answer_hashes(_ask_hashes(table, parts, length))
    asked = _ask_windows(table, shared.select("chunk", "data"), parts, length)
    answers = _answer_windows(asked, length).select("chunk", F.concat(F.lit(b"A"), "data").alias("data"))
    plans = asked.filter("kind = 1").select("chunk", F.concat(F.lit(b"P"), "data").alias("data"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts_too]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + texts_too]

    def handle(_chunk: int, data: bytes, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = chunks.unpack(data)
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        plan = next((x[1:] for x in got if x[:1] == b"P"), None)
        gone = removed_runs(buffer, plan, [x[1:] for x in got if x[:1] == b"A"], length)
        rows, end = [], 0
        for doc, text in zip(ids, texts, strict=True):
            mine = gone[end : end + len(text)]
            kept = buffer[end : end + len(text)][~mine].tobytes()
            end += len(text)
            spans = int(mine[:1].sum()) + int(np.count_nonzero(mine[1:] & ~mine[:-1]))
            rows.append((doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_too
    return chunks.with_answers(table, answers.union(plans), handle, schema)


def segments(texts: list[bytes], length: int, stride: int) -> list[tuple[int, int, bytes]]:
    """(text, start, bytes) of overlapping pieces such that each window of `length` bytes lies whole in one of them."""
    return [(t, a, x[a : a + stride + length - 1]) for t, x in enumerate(texts) for a in range(0, max(len(x) - length + 1, 0), stride)]


def column_wise(texts: list[bytes], length: int, stride: int = 99, folder: str | None = None) -> list[np.ndarray]:
    """Removal masks by the column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

    Texts are cut into overlapping segments, so the number of rounds is a segment's length, however long the texts. Each
    round inserts one more symbol of every segment, from its end: the rows (suffixes so far, in order) are read in
    sequence, a stable sort by the symbol before each row gives where the longer suffixes stand, and their common
    prefixes are one more than the least between the rows they come from. The transform and the prefixes pass from round
    to round through files in `folder`, written and read in sequence. Rows whose common prefix reaches `length` share a
    window; the smallest text of each such group keeps it.
    """
    import os
    import tempfile

    masks = [np.zeros(len(x), bool) for x in texts]
    cut = segments(texts, length, stride)
    if not cut:
        return masks
    sizes = np.array([len(x) for *_, x in cut])
    m, rounds = len(cut), int(sizes.max())
    column = np.zeros((rounds + 1, m), np.uint16)  # symbols from the end, 1 to 256; 0 before the first
    for k, (*_, x) in enumerate(cut):
        column[: len(x), k] = np.frombuffer(x, np.uint8)[::-1].astype(np.uint16) + 1
    with tempfile.TemporaryDirectory(dir=folder) as at:
        names = [os.path.join(at, n) for n in ("transform", "prefixes")]

        def put(rows: np.ndarray, common: np.ndarray) -> None:
            rows.tofile(names[0])
            common.tofile(names[1])

        put(column[0].copy(), np.zeros(m, np.uint8))
        row = np.arange(m)  # where each segment's longest suffix so far stands
        for size in range(1, rounds + 1):
            rows, common = np.fromfile(names[0], np.uint16), np.fromfile(names[1], np.uint8)
            grows = np.flatnonzero(sizes >= size)
            order = np.argsort(rows, kind="stable")
            ranked = rows[order]
            done = int(np.searchsorted(ranked, 1))  # rows with nothing before them
            total = m + len(rows) - done
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows)) + m - done
            new = np.zeros(total, bool)
            row[grows] = place[row[grows]]
            new[row[grows]] = True
            after = np.empty(total, np.uint16)
            after[~new] = rows
            after[row[grows]] = column[size, grows]
            longer = np.zeros(total, np.uint8)
            bounds = np.append(np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]), len(rows))
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a >= done and b - a > 1:  # rows of one symbol follow each other, so one pass gives all the least ones
                    of = order[a:b]
                    least = np.minimum.reduceat(common[: of[-1] + 1], of[:-1] + 1)
                    longer[a + 1 + m - done : b + m - done] = np.minimum(least, length - 1) + 1
            stays = np.setdiff1d(np.arange(m), grows, assume_unique=True)
            row[stays] = np.flatnonzero(~new)[row[stays]]
            put(after, longer)
        rows, common = np.fromfile(names[0], np.uint16), np.fromfile(names[1], np.uint8)
    order = np.argsort(rows, kind="stable")
    done = int(np.count_nonzero(rows == 0))
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows)) + m - done
    group = np.cumsum(common < length)
    owner, start = np.array([t for t, *_ in cut]), np.array([a for _, a, _ in cut])
    least = np.full(int(group[-1]) + 1, len(texts))
    at, found = np.arange(m), []
    for size in range(1, rounds + 1):
        some = np.flatnonzero(sizes >= size)
        at[some] = place[at[some]]
        if size >= length:
            found.append((some, group[at[some]], start[some] + sizes[some] - size))
            np.minimum.at(least, found[-1][1], owner[some])
    for some, mine, begin in found:
        for k, g, p in zip(owner[some].tolist(), mine.tolist(), begin.tolist(), strict=True):
            if least[g] < k:
                masks[k][p : p + length] = True
    return masks
