"""MinHash near-duplicate detection with tensored banding.

A document is the set of its distinct word shingles. Two small collections of m half-bands of r minhashes each are
computed, 2*m*r minhashes in all; the m*m pairs of one half-band from either collection are the table keys, so the
cost of hashing is about the square root of what as many independent tables would take. Two documents of similarity
J share no key with probability at most 2*(1-J^r)^m; m is chosen so that this is at most `miss` at the threshold.

Documents with equal sets form one class and enter the tables once. The classes of a bucket are linked provisionally
where their sketches don't rule the threshold out (six standard deviations below it); the components of these links
are families, and linked documents that share a bucket are in one family. Within a family the full sets decide: all
intersections of one set with the others come from one count over the family's postings, and only links that join
something are passed on, so a family of n hands on less than n links. Buckets and families beyond a tile's size are
dealt over tasks and held against their representative; only what isn't linked with that meets all others, in tiles. No
candidate is dropped for the size of its bucket or family.

Null and empty texts have no shingles and are linked with nothing. Repeated rows of a doc_id with the same text
are one class; rows of one doc_id with different texts are classes of their own with one id, and links of either hold
for both. A row without an id is linked with nothing and kept. An empty table gives no rows. Columns other than
the id and the text are not read, and pass through `drop_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .shingles import WordHash, mix, shingle_set, words_of

HALF = 3
#: Up to what a group is met in one task, and the size of tiles in which the rest of larger ones meet.
TILE, LARGE_TILE = 1024, 4096
TILE_BYTES, LARGE_BYTES, ROW_BYTES = 1 << 20, 16 << 20, 2048
FILTER_BITS = 21


def half_bands(num: int, den: int, miss: float = 2e-4) -> int:
    """Half-bands per collection so that a pair at the threshold num/den is missed with probability of miss at most."""
    return max(2, math.ceil(math.log(miss / 2) / math.log(1 - (num / den) ** HALF)))


def _family(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = 2 * m * HALF
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def sketches(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of 2*m*HALF minhashes per non-empty set."""
    mult, add = _family(m)
    joined = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(mult), len(sets)), np.uint32)
    for k in range(len(mult)):
        x = joined * mult[k] + add[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[k] = np.minimum.reduceat(x, starts)
    return np.ascontiguousarray(out.T)


def table_keys(sketch: np.ndarray, m: int) -> np.ndarray:
    """The m*m keys of each row: every half-band of the first collection with every one of the second."""
    halves = np.zeros((len(sketch), 2 * m), np.uint64)
    for r in range(HALF):
        halves = mix(halves + sketch[:, r::HALF].astype(np.uint64) + np.uint64(r + 1))
    halves = mix(halves + np.arange(2 * m, dtype=np.uint64)[None, :])
    first, second = halves[:, :m], halves[:, m:]
    return mix(first[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + second[:, None, :]).reshape(len(sketch), m * m).view(np.int64)


def signatures(docs: DataFrame, width: int, m: int) -> DataFrame:
    """(doc_id, n, fp, sketch): set size, 128-bit fingerprint of the set and minhashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("neardup")
        hashes = WordHash()
        for ids, texts in common.texts_of(batches):
            sets = [shingle_set(words_of(t), hashes, width) for t in texts]
            hashes.trim()
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = sketches([sets[i] for i in full], m) if full else ()
            sketch: list = [None] * len(sets)
            for i, row in zip(full, rows, strict=True):
                sketch[i] = row.tobytes()
            fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) and doc is not None else None for doc, s in zip(ids, sets, strict=True)]
            cols = [pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(fps, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, sketch binary")


def _keys(classes: DataFrame, m: int) -> DataFrame:
    """(key, id) for each class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, -1)
                keys = table_keys(sketch, m)
                ids = np.repeat(np.asarray(part.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["key", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "key long, id long")


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list]]:
    """Rows of batches sorted by their first width columns, grouped by those."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, id) of buckets with more than one class. A bucket's rows arrive together and are passed on as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, not passed on yet, and whether its key came before
        for batch in batches:
            key, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(key):
                continue
            twin = np.zeros(len(key) + 1, bool)
            if held:
                key, ids, twin = np.r_[held[0], key], np.r_[held[1], ids], np.r_[twin, False]
                twin[0] = held[2]
            same = key[1:] == key[:-1]
            twin[1 : len(key)] |= same
            twin[: len(key) - 1] |= same
            held = (key[-1], ids[-1], twin[len(key) - 1])
            out = np.flatnonzero(twin[: len(key) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(ids[out])], ["key", "id"])
        if held and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["key", "id"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, id long")


class _Sketches:
    """Rows of one byte per minhash; agreement in enough places."""

    def __init__(self, level: float):
        self.level = level

    def load(self, data: list[bytes]) -> None:
        self.rows = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        width = self.rows.shape[1]
        self.floor = (self.level - 6 * math.sqrt(self.level * (1 - self.level) / width)) * width

    def hits(self, i: int, at: np.ndarray) -> np.ndarray:
        return at[(self.rows[at] == self.rows[i]).sum(axis=1) >= self.floor]


class _FullSets:
    """Sets of hashes; all intersections of one with the others come from one count over the postings of its items."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def load(self, data: list[bytes]) -> None:
        self.sizes = np.array([len(x) // 8 for x in data])
        _, self.item = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
        owner = np.repeat(np.arange(len(data)), self.sizes)
        self.posting = owner[np.argsort(self.item, kind="stable")]
        self.ends = np.cumsum(np.bincount(self.item))
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        self.first = np.cumsum(self.sizes) - self.sizes

    def hits(self, i: int, at: np.ndarray) -> np.ndarray:
        mine = self.item[self.first[i] : self.first[i] + self.sizes[i]]
        count = self.ends[mine] - self.starts[mine]
        place = np.repeat(self.starts[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(self.posting[place], minlength=len(self.sizes))[at]
        return at[self.den * shared >= self.num * (self.sizes[i] + self.sizes[at] - shared)]


def _forest(n: int, hits, leading: int | None = None) -> list[tuple[int, int]]:
    """Links i-j that join something new, where hits(i, open) gives the partners of i among the open ones.

    With leading, only the first so many rows look for partners, and only among the others.
    """
    part, out = np.arange(n), []
    for i in range(n - 1 if leading is None else leading):
        other = part != part[i]
        if leading is not None:
            other[:leading] = False
        if not other.any():
            if leading is None:
                break
            continue
        for j in hits(i, np.flatnonzero(other)).tolist():
            if part[j] != part[i]:
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


def _links(pairs: list[tuple[int, int]], ids: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _group_links(rows: DataFrame, group: str, data: str, weight, test, limit: int, large: int) -> DataFrame:
    """(a, b) links between rows (group, id, data) of one group that pass the test, a forest of each task's.

    A group of at most `limit` by weight is met in one task. A larger one is dealt over tiles: every row is held against
    the group's representative first, which most of a group of near copies are linked with. Only what isn't is then held
    against all of its group, in tiles of `large`. No pair is left out: what is linked with the representative needs no
    other link to it, and the rest meet everyone.
    """
    sizes = rows.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / limit)).cast("int").alias("tiles"), F.min("id").alias("rep"))
    sizes = common.materialize(sizes, "sizes")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _groups(batches, 1):
            test.load([r[1] for r in some])
            if pairs := _forest(len(some), test.hits):
                yield _links(pairs, [r[0] for r in some])

    small = rows.join(sizes.filter("tiles = 1").select(group), group).select(group, "id", data)
    out = small.repartition(group).sortWithinPartitions(group).mapInArrow(alone, "a long, b long")
    big = sizes.filter("tiles > 1")
    if big.isEmpty():
        return out.distinct()
    dealt = rows.join(big, group).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    heads = dealt.filter("id = rep").select(group, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("turn"), "id", "rep", "tiles", data)
    both = heads.unionByName(dealt.filter("id <> rep").select(group, "tile", F.lit(1).alias("turn"), "id", "rep", "tiles", data))

    def against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _), some in _groups(batches, 2):
            head, rest = some[0], some[1:]  # the representative comes first
            for at in range(0, len(rest), 2000):
                part = rest[at : at + 2000]
                test.load([head[4], *(r[4] for r in part)])
                near = np.zeros(len(part) + 1, bool)
                near[test.hits(0, np.arange(1, len(part) + 1))] = True
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), *(pa.array([r[k] for r in part], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))), pa.array(near[1:])], [group, "id", "rep", "tiles", "near"])

    held = both.repartition(group, "tile").sortWithinPartitions(group, "tile", "turn").mapInArrow(against_head, f"{group} long, id long, rep long, tiles int, near boolean")
    held = common.materialize(held, "held")
    out = out.union(held.filter("near").select("rep", "id"))
    left = held.filter("not near").select(group, "id", "tiles")
    if left.isEmpty():
        return out.distinct()
    left = left.join(rows.select(group, "id", data), [group, "id"])
    of_left = left.groupBy(group, "tiles").agg(F.sum(weight).alias("size"))
    # the group lies in tiles of `large`, or in smaller ones as long as the copies of what is left stay below its own size
    wide = F.greatest(F.lit(1), F.ceil(F.col("tiles") * limit / large), F.least("tiles", F.floor(F.col("tiles") * limit / F.col("size"))))
    of_left = common.materialize(of_left.select(group, F.greatest(F.lit(1), F.ceil(F.col("size") / large)).cast("int").alias("left_tiles"), wide.cast("int").alias("wide")), "left")
    others = dealt.join(of_left, group).withColumn("there", F.pmod(F.xxhash64("id"), F.col("wide")).cast("int"))
    others = others.select(group, F.explode(F.sequence(F.lit(0), F.col("left_tiles") - 1)).alias("here"), "there", F.lit(1).alias("turn"), "id", data)
    looking = left.join(of_left, group).withColumn("here", F.pmod(F.xxhash64("id", F.lit(1)), F.col("left_tiles")).cast("int"))
    looking = looking.select(group, "here", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("there"), F.lit(0).alias("turn"), "id", data)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _groups(batches, 3):
            leading = sum(r[0] == 0 for r in some)
            ids = [r[1] for r in some]
            if leading < len(some):
                test.load([r[2] for r in some])
                if pairs := [(i, j) for i, j in _forest(len(some), test.hits, leading) if ids[i] != ids[j]]:
                    yield _links(pairs, ids)

    met = looking.unionByName(others).repartition(group, "here", "there").sortWithinPartitions(group, "here", "there", "turn").mapInArrow(meet, "a long, b long")
    return out.union(met).distinct()


def _provisional(buckets: DataFrame, classes: DataFrame, level: float) -> DataFrame:
    """(a, b) links of classes in one bucket whose sketches agree in enough places."""
    rows = buckets.join(classes.select("id", "brief"), "id").select("key", "id", "brief")
    return _group_links(rows, "key", "brief", F.lit(1), _Sketches(level), TILE, LARGE_TILE)


def _confirmed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links of one family with den * intersection >= num * union on full sets."""
    weight = F.octet_length("items") + F.lit(ROW_BYTES)  # many small sets are as much work as few large ones
    return _group_links(sets, "family", "items", weight, _FullSets(num, den), TILE_BYTES, LARGE_BYTES)


def _bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _sets(docs: DataFrame, families: DataFrame, width: int) -> DataFrame:
    """(id, items): sorted shingle hashes of documents of a family, and of a few others.

    A filter of 2**FILTER_BITS bits spares most other texts; it has the same size whatever the input, and the join
    with the families drops what it lets through. Ids are never null here: with a null, Arrow gives NumPy floats, which
    round large ids.
    """
    docs = docs.filter("doc_id is not null")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bits(np.asarray(batch.column(0)))))], ["bit"])

    spark = docs.sparkSession
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[families.select("node").mapInArrow(hashed, "bit long").distinct().toArrow().column(0).to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(bits[_bits(np.asarray(batch.column(0)))]))
            for ids, texts in common.texts_of(iter([some])):
                items = [shingle_set(words_of(t), hashes, width).tobytes() for t in texts]
                hashes.trim(200_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], ["id", "items"])

    return docs.mapInArrow(run, "id long, items binary")


def near_duplicates(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row. Links: den * intersection >= num * union."""
    docs = common.id_text(df, id_col, text_col)
    m = half_bands(num, den)
    sig = common.materialize(signatures(docs, width, m), "signatures")
    best = sig.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "sketch")).alias("x"))
    classes = common.materialize(best.select("fp", F.col("x.doc_id").alias("id"), F.col("x.sketch").alias("sketch")), "classes")
    buckets = common.materialize(_buckets(_keys(classes, m)), "buckets")
    families = common.materialize(components(_provisional(buckets, _brief(classes), num / den)), "families")
    of_family = families.select(F.col("node").alias("id"), F.col("component").alias("family"))
    sets = common.materialize(_sets(docs, families, width).join(of_family, "id").select("family", "id", "items"), "sets")
    label = components(_confirmed(sets, num, den))
    of_class = classes.select("fp", "id").join(label, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    of_class = common.materialize(of_class, "of_class")
    out = sig.select("doc_id", "n", "fp").join(of_class, "fp", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns; rows without an id stay.

    Of rows that repeat an id one stays. Only ids are joined to the rows; the few that are dropped are broadcast where
    Spark finds their table small.
    """
    dropped, again, n = common.spare_names(df, "__dropped", "__again", "__n")
    gone = near_duplicates(df, width, num, den, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(dropped))
    out = df.join(common.materialize(gone.distinct(), "dropped"), df[id_col] == F.col(dropped), "left_anti")
    twice = df.groupBy(F.col(id_col).alias(again)).agg(F.count("*").alias(n)).filter((F.col(n) > 1) & F.col(again).isNotNull()).select(again)
    twice = common.materialize(twice, "repeated")
    if twice.isEmpty():
        return out
    known = out[id_col] == F.col(again)
    return out.join(twice, known, "left_anti").union(out.join(twice, known, "left_semi").dropDuplicates([id_col]))


def _brief(classes: DataFrame) -> DataFrame:
    """(id, brief): one byte of each minhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            brief = [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(brief, pa.binary())], ["id", "brief"])

    return classes.select("id", "sketch").mapInArrow(run, "id long, brief binary")
