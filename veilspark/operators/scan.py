"""Scan of many files: what each holds, which are protected, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import FileGlobs
from ..sources.files import BINARY_PROBE, DEFAULT_MAX_SIZE

TABLE_VALUES, TABLE_VALUE_CHARS, LISTED_SECRETS = 3, 60, 20


def scanned(done: DataFrame, protected: FileGlobs | None = None) -> DataFrame:
    """(path, count, detectors, protected, findings) of redacted documents with a finding that isn't allowed.

    done: (doc_id, findings) as documents.redact_all gives them, doc_id being the path from the root. Detectors come in
    the order in which they first found something. No shuffle.
    """
    left = F.filter("findings", lambda f: ~f["allowed"])
    rows = done.select(F.col("doc_id").alias("path"), left.alias("left")).filter(F.size("left") > 0)
    shown = F.transform("left", lambda f: F.struct(f["detector"].alias("detector"), f["line"].alias("line"), f["secret"].alias("value")))
    guard = (protected or FileGlobs()).column(F.col("path"))
    return rows.select("path", F.size("left").alias("count"), F.array_distinct(F.transform("left", lambda f: f["detector"])).alias("detectors"), guard.alias("protected"), shown.alias("findings"))


def splits(files: DataFrame, protected: FileGlobs | None = None, unprotected_only: bool = False, max_size: int | None = DEFAULT_MAX_SIZE) -> DataFrame:
    """files (relative, size, content, error) with `fate`: scan, skip (binary or large), protected (not read) or error."""
    binary = F.coalesce(F.position(F.lit(b"\x00"), F.substring("content", 1, BINARY_PROBE)) > 0, F.lit(False))
    large = F.col("size") > max_size if max_size is not None else F.lit(False)
    guard = (protected or FileGlobs()).column(F.col("relative")) if unprotected_only else F.lit(False)
    return files.withColumn("fate", F.when(guard, "protected").when(large, "skip").when(F.col("error").isNotNull(), "error").when(binary, "skip").otherwise("scan"))


def totals(files: DataFrame) -> DataFrame:
    """One row (scanned, skipped, protected_unread, errors) of files with their fate."""
    n = lambda fate: F.count_if(F.col("fate") == fate)
    return files.agg(n("scan").alias("scanned"), n("skip").alias("skipped"), n("protected").alias("protected_unread"), n("error").alias("errors"))


def quoted(value: Column) -> Column:
    """A value between quotes with its line breaks and quotes escaped."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def value_cell(findings: Column) -> Column:
    """The first few values of a file, each cut short, and how many more there are."""
    cut = lambda v: F.when(F.length(v) > TABLE_VALUE_CHARS, F.concat(quoted(F.left(v, F.lit(TABLE_VALUE_CHARS))), F.lit("…"))).otherwise(quoted(v))
    shown = F.transform(F.slice(findings, 1, TABLE_VALUES), lambda f: cut(f["value"]))
    more = F.when(F.size(findings) > TABLE_VALUES, F.array(F.concat(F.lit("+"), (F.size(findings) - TABLE_VALUES).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(shown, more), ", ")


def unprotected(files: DataFrame, protected: FileGlobs) -> DataFrame:
    """Files (relative) that no rule protects."""
    return files.filter(~protected.column(F.col("relative")))


#: Names of files that often hold credentials, by this library's choice.
CANDIDATES = (
    ".env", ".env.*", "*.env", ".envrc", "*.tfvars", "terraform.tfstate", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "id_rsa", "id_ed25519", "id_ecdsa", ".npmrc", ".pypirc", ".netrc",
    ".pgpass", ".my.cnf", ".htpasswd", "credentials", "credentials.json", "secrets.yml", "secrets.yaml", "secrets.json",
)


def candidates(files: DataFrame, examples: int = 3) -> DataFrame:
    """(pattern, n, examples) of the candidate names that files (relative) have; examples are the first paths."""
    from ..functions.globs import file_glob

    kinds = F.array(*[F.when(F.col("relative").rlike(file_glob(p)), F.lit(p)) for p in CANDIDATES])
    rows = files.select("relative", F.explode(F.array_compact(kinds)).alias("pattern"))
    first = F.slice(F.array_sort(F.collect_list("relative")), 1, examples)
    few = rows.groupBy("pattern", (F.xxhash64("relative") % 64).alias("part")).agg(F.count("*").alias("n"), first.alias("some"))  # a common name is split, and each part hands on few paths
    return few.groupBy("pattern").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, examples).alias("examples"))
