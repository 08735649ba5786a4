"""Helpers shared by the corpus operators: shared storage, text batches, sorted streams."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds decoded at once (one longer text is held alone).
SLICE_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir; in local mode only, else a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a temporary folder is shared."""
    return master == "local" or master.startswith("local[")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone, and with it any reader of the folder
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table that `materialize` wrote, once everything built on it is written itself."""
    _remove(df.sparkSession, df.scratch_path)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, for files in the shared folder that are not tables.

    Names that Hadoop gives to object stores become those of Arrow's own clients.
    """
    scheme, mark, rest = path.partition("://")
    if mark:
        path = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs"}.get(scheme, scheme) + mark + rest
    try:
        return fs.FileSystem.from_uri(path if mark or path.startswith("file:") else "file://" + path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"spark.checkpoint.dir is on a store that Python workers can't open: {scheme}") from e


_held: dict = {}


def held(key: Hashable, make: Callable = object):
    """What an operator keeps in a Python worker between tasks, made by the first that needs it.

    Workers serve one operator after another, so whatever another one kept is let go of here, and its memory given back.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; a null text counts as empty, other columns are pruned at the scan."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names that df has no column of, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have at most limit bytes, or are one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def texts_of(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts) of (doc_id, text) batches, in parts of bounded size."""
    for batch in batches:
        for part in slices(batch, 1, limit):
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
