"""Sinks: tables and JSON of findings, scan reports, and redacted documents written to files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import quoted, value_cell


def finding_cells(done: DataFrame, show_value: bool = False) -> DataFrame:
    """(doc_id, id, token, detector, start, len, count, location[, value], allowed) as texts, a row per finding."""
    f = lambda k: F.col(f"f.{k}")
    place = F.concat_ws(":", f("line").cast("string"), f("column").cast("string"))
    name = F.coalesce(F.nullif(f("path"), F.lit("")), f("field"))
    where = F.trim(F.concat(F.when(f("line").isNotNull(), place).otherwise(""), F.coalesce(F.concat(F.lit(" ["), name, F.lit("]")), F.lit(""))))
    cells = [f("token").alias("token"), f("detector").alias("detector"), F.coalesce(F.get(f("offsets"), F.lit(0)).cast("string"), F.lit("-")).alias("start"), f("len").cast("string").alias("len"), f("occurrences").cast("string").alias("count"), where.alias("location")]
    cells += [quoted(f("secret")).alias("value")] if show_value else []
    return done.select("doc_id", F.explode("findings").alias("f")).select("doc_id", f("id").alias("id"), *cells, F.when(f("allowed"), "allowed").otherwise("").alias("allowed"))


def finding_json(done: DataFrame, show_value: bool = False) -> DataFrame:
    """(doc_id, json): format, redactions and warnings of each document."""
    fields = ["id", "token", "detector", "len", "line", "column", "field", "path", "occurrences", "offsets", "allowed"]
    name = {"len": "length"}
    one = lambda f: F.struct(*[f[k].alias(name.get(k, k)) for k in fields[:3]], F.get(f["offsets"], F.lit(0)).alias("start"), *[f[k].alias(name.get(k, k)) for k in fields[3:]], *([f["secret"].alias("value")] if show_value else []))
    warnings = F.when(F.col("warning").isNull(), F.array().cast("array<string>")).otherwise(F.array("warning"))
    body = F.struct(F.col("format"), F.transform("findings", one).alias("redactions"), warnings.alias("warnings"))
    return done.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def scan_cells(report: DataFrame, show_value: bool = False) -> DataFrame:
    """(file, findings, detectors[, value], protected) as texts, of scan.scanned's rows."""
    cells = [F.col("path").alias("file"), F.col("count").cast("string").alias("findings"), F.array_join("detectors", ",").alias("detectors")]
    cells += [value_cell(F.col("findings")).alias("value")] if show_value else []
    return report.select(*cells, F.when(F.col("protected"), "protected").otherwise("").alias("protected"))


def scan_json(report: DataFrame, show_value: bool = False) -> DataFrame:
    """(path, json) of each file of scan.scanned's rows."""
    one = lambda f: F.struct(f["detector"].alias("detector"), f["line"].alias("line"), *([f["value"].alias("value")] if show_value else []))
    return report.select("path", F.to_json(F.struct("path", "count", "detectors", "protected", F.transform("findings", one).alias("findings")), {"ignoreNullFields": "false"}).alias("json"))


def table(header: Iterable[str], rows: Iterable[Iterable[str]]) -> str:
    """Rows in columns below their header, for people."""
    every = [list(header), *map(list, rows)]
    widths = [max(map(len, column)) for column in zip(*every, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in every)


def pretty(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def write_files(done: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, bytes) of documents written below folder by their doc_id, or in place by their path; lazily, by the tasks.

    A file appears whole or not at all: it is written beside its place and renamed, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = os.path.join(folder, doc) if folder else path
                if to is None:
                    raise ValueError("a document without a path can't be written in place")
                if folder and os.path.commonpath([os.path.abspath(folder), os.path.abspath(to)]) != os.path.abspath(folder):
                    raise ValueError("a document's name leads out of the folder")
                os.makedirs(os.path.dirname(os.path.abspath(to)), exist_ok=True)
                handle, beside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(to)))
                with os.fdopen(handle, "wb") as f:
                    f.write(data)
                os.chmod(beside, os.stat(to).st_mode & 0o7777 if os.path.exists(to) else 0o644)
                os.replace(beside, to)
                out.append((to, len(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out]), pa.array([n for _, n in out], pa.int64())], ["path", "bytes"])

    return done.select("doc_id", "path", "content").mapInArrow(run, "path string, bytes long")
