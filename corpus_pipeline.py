"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage is written as Parquet in the shared folder and read back as the next one's documents.

Columns besides the id and the text are carried along, whatever their names, and may be null. A null or empty text fails
the quality floors, so no later stage of a run sees one; each stage by itself keeps such rows. Rows that repeat an id and
rows that tie are judged alike by all stages but near-duplicates. A table, or a stage's result, without rows gives an
empty result with the columns of the full one. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, common, decontam, neardup, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model over the quality rules keeps; null and empty texts go, repeated rows stay repeated."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one of the smallest id;
    of rows that repeat an id one stays, and rows without an id or without words all stay."""
    return neardup.drop_near_duplicates(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage close to a benchmark item; items without words, or no items, take none away."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets at any depth of encoding masked; n_chars follows the text, and a null text stays null."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in masked.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, which decode to the text again; null and empty texts have none."""
    import public_tokenizers

    return bpe.add_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("bpe", tokens)]

#: Minhash, label model and lattice searches are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
