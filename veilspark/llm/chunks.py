"""Documents packed into compressed chunks, and question-and-answer exchanges between chunks and key ranges.

Corpus-wide lookups (how often is this word seen, is this fingerprint shared) would shuffle a row per occurrence.
Here each chunk of a few MB of text asks once per distinct key: keys are hashed, dealt to key ranges as packed
arrays, counted there and answered per chunk. The chunks lie in the shared folder, one file per task, and the chunk
table holds their places; so a chunk can be read again, by any executor, together with its answers, without being shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 4 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])


def pack(ids: list[int], texts: list[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], schema=_SCHEMA))
    return sink.getvalue().to_pybytes()


def unpack(place: bytes) -> tuple[list[int], list[bytes]]:
    """Ids and texts of the chunk at a place (file, offset, length)."""
    path, offset, length = place.decode().rsplit("\t", 2)
    store, at = common.open_store(path)
    with store.open_input_file(at) as f:
        f.seek(int(offset))
        batch = pa.ipc.open_stream(f.read(int(length))).read_next_batch()
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def build(docs: DataFrame, name: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, data) of (doc_id, text) rows, data being the place of a chunk; a text longer than limit is a chunk of its own.

    Every attempt of a task writes a file of its own name, and only those of finished tasks are in the table.
    """
    folder = common.scratch(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size, offset = TaskContext.get().partitionId() << 32, [], [], 0, 0
        store, at = common.open_store(folder)
        store.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.chunks"
        with store.open_output_stream(f"{at}/{name}", compression=None) as out:

            def row() -> pa.RecordBatch:
                nonlocal offset
                blob = pack(ids, texts)
                out.write(blob)
                place = f"{folder}/{name}\t{offset}\t{len(blob)}".encode()
                offset += len(blob)
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([place], pa.binary())], ["chunk", "data"])

            for some_ids, some in common.texts_of(batches, limit):
                for doc, text in zip(some_ids, some, strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    if ids and size + len(raw) > limit:
                        yield row()
                        number, ids, texts, size = number + 1, [], [], 0
                    ids.append(doc)
                    texts.append(raw)
                    size += len(raw)
            if ids:
                yield row()

    places = common.materialize(docs.mapInArrow(run, "chunk long, data binary"), f"{name}-places")
    return places.repartition(ranges(docs), "chunk")  # few bytes, but much work each


def ranges(docs: DataFrame, each: int = 1) -> int:
    """Number of key ranges: `each` per shuffle partition, which is how a cluster is told the size of its shuffles.

    A task takes its ranges one after the other, so more of them bound what it holds at once.
    """
    return each * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """Slices of sorted 64-bit keys that belong to each of `parts` equal key ranges."""
    edges = np.searchsorted(keys, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
    bounds = [0, *edges.tolist(), len(keys)]
    return [(p, slice(a, b)) for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]


def by_group(df: DataFrame, key: str, handle: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """Rows of (key, sub, data...) gathered by key and handed, sorted by sub, to handle(key, iterator of rows)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in batch.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        for k, group in groupby(rows(batches), key=lambda r: r[0]):
            yield from handle(k, (r[1:] for r in group))

    return (df.repartition(tasks, key) if tasks else df.repartition(key)).sortWithinPartitions(*df.columns[:2]).mapInArrow(run, schema)


def with_answers(table: DataFrame, answers: DataFrame, handle: Callable, schema: str) -> DataFrame:
    """handle(chunk, data, [answers]) for each chunk; its answers arrive before it.

    The answers are shuffled, and places of chunks; tasks are as many as shuffle partitions, however few bytes those are.
    """

    def one(chunk: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        got: list[bytes] = []
        for kind, data in rows:
            if kind == 0:
                got.append(data)
            else:
                yield from handle(chunk, data, got)

    both = answers.select("chunk", F.lit(0).alias("kind"), "data").union(table.select("chunk", F.lit(1).alias("kind"), "data"))
    return by_group(both, "chunk", one, schema, ranges(table))
