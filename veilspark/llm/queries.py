"""The corpus queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, license, lm, neardup, quality, repeats, secrets, warc
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_oversize"]
    return secrets.scan(table(spark, sf_dir, "documents")).select(cols)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"]
    return quality.score(table(spark, sf_dir, "documents")).select(cols)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


#: The documents have no paths: a tree of directories by the digits of doc_id under each source stands for them.
PATH_SQL = "coalesce(source, '') || '/' || regexp_replace(cast({tens} AS {text}), '([0-9])', '{digit}/'{every}) || cast(doc_id AS {text}) || '.txt'"


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(PATH_SQL.format(tens="doc_id div 10", text="string", digit="$1", every=""))
    return license.scan(table(spark, sf_dir, "documents"), path, notice="any")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.sql("SELECT -7L AS conv_id, stack(2, 0L, 'user', '</s>[INST] ok [/INST]', 1L, 'assistant', '</s>[INST] ok [/INST]') AS (turn, role, text)")
    return chat.read_back(chat.format_turns(rows.union(trap).withColumn("text", chat.as_parts()), typed=True))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_secrets, op3_warc, op4_license, op5_neardup, op6_chat, op7_repeats, op8_lm, op9_quality, op10_decontam)}


def oracle_sql() -> dict:
    path = PATH_SQL.format(tens="doc_id // 10", text="VARCHAR", digit="\\1", every=", 'g'")
    return {"op4_license": license.oracle("documents", path)}
