"""Redaction of text columns: spans, numbered tokens, findings and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors, spans
from ..functions.tokens import Template
from .detection import Detector, Leaf, resolve


def merged_spans(text: Column, found: Column, template: Template | None = None, within: Iterable[str] = ()) -> Column:
    """Disjoint spans to redact: nothing inside an existing token, nothing inside an allowed pattern."""
    template = template or Template.parse()
    out = spans.merge(spans.outside(found, spans.find(text, template.pattern, "token")))
    for pattern in within:
        out = spans.outside(out, spans.find(text, pattern, "within"))
    return out


def _allowed(secret: Column, values: Iterable[str], regexes: Iterable[str]) -> Column:
    out = F.lit(False)
    if values := list(values):
        out |= secret.isin(*values)
    for pattern in regexes:
        out |= secret.rlike(rf"(?s)\A(?:{pattern})\z")
    return out


def with_spans(df: DataFrame, names: Iterable[str | Detector] = detectors.DEFAULT, text_col: str = "text", out: str = "spans", template: Template | None = None, within: Iterable[str] = ()) -> DataFrame:
    """df with the merged spans of the named or given detectors. The raw spans are a column of their own first, so that
    they are computed once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [d.column(Leaf(text)) for d in resolve(names)]
    df = df.withColumn("__found", F.concat(*found) if found else spans.none())
    return df.withColumn(out, F.when(F.size("__found") == 0, spans.none()).otherwise(merged_spans(text, F.col("__found"), template, within))).drop("__found")


def redact(df: DataFrame, names: Iterable[str | Detector] = detectors.DEFAULT, text_col: str = "text", template: Template | None = None, within: Iterable[str] = (), allow_values: Iterable[str] = (), allow_regexes: Iterable[str] = ()) -> DataFrame:
    """df with `redacted`: each distinct secret of a text gets a number by first appearance.

    One stage, no shuffle, so it also runs on streams. Allowed secrets stay in the text and keep their number. A null
    text stays null.
    """
    template = template or Template.parse()
    out = with_spans(df, names, text_col, "__spans", template, within)
    text, s = F.col(text_col), F.col("__spans")

    def tokens(secrets: Column) -> Column:
        """A secret's number is its place among the distinct ones."""
        stays = _allowed_each(secrets, allow_values, allow_regexes)
        number = lambda ids: F.transform(secrets, lambda x: F.array_position(ids, x))
        put = lambda n, i: template.column(n, F.get(s, i)["label"])
        made = spans.let(F.array_distinct(secrets), lambda ids: F.transform(number(ids), put))
        return made if stays is None else F.zip_with(made, stays, lambda t, kept: F.coalesce(kept, t))

    done = spans.replace(text, s, spans.let(spans.secrets(text, s), tokens))
    return out.withColumn("redacted", F.when(text.isNull() | (F.size(s) == 0), text).otherwise(done)).drop("__spans")


def _allowed_each(secrets: Column, values: Iterable[str], regexes: Iterable[str]) -> Column | None:
    """The secrets that stay, null for the others; None where nothing is allowed."""
    values, regexes = list(values), list(regexes)
    return F.transform(secrets, lambda x: F.when(_allowed(x, values, regexes), x)) if values or regexes else None


def occurrences(df: DataFrame, names: Iterable[str | Detector] = detectors.DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, label, secret) of each merged span."""
    found = with_spans(df.select(id_col, text_col), names, text_col)
    rows = found.select(F.col(id_col).alias("doc_id"), F.explode(spans.with_secrets(F.col(text_col), F.col("spans"))).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.label", "s.secret")


def findings(occ: DataFrame, template: Template | None = None) -> DataFrame:
    """(doc_id, id, secret, detector, token, len, offsets, occurrences), numbered by first appearance in the document.

    One shuffle by (doc_id, secret), pre-aggregated, and one by document for the numbers.
    """
    from pyspark.sql import Window

    template = template or Template.parse()
    groups = occ.groupBy("doc_id", "secret").agg(F.min(F.struct("start", "label")).alias("first"), F.sort_array(F.collect_list("start")).alias("offsets"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.start"))
    out = groups.select("doc_id", rank.alias("id"), "secret", F.col("first.label").alias("detector"), "offsets")
    return out.select("doc_id", "id", "secret", "detector", template.column(F.col("id"), F.col("detector")).alias("token"), F.octet_length("secret").alias("len"), "offsets", F.size("offsets").alias("occurrences"))


def scan_report(df: DataFrame, found: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, findings, detectors) per path with findings; detectors in order of first appearance."""
    rows = df.select("doc_id", path_col).join(found, "doc_id")
    first = rows.groupBy(path_col, "detector").agg(F.min(F.struct("doc_id", "id")).alias("at"), F.count("*").alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "detector"))), lambda x: x["detector"])
    return first.groupBy(F.col(path_col).alias("path")).agg(F.sum("n").alias("findings"), names.alias("detectors"))


def propagate(leaves: DataFrame, found: DataFrame) -> DataFrame:
    """Leaves of a document whose whole value is a secret found elsewhere in it: (doc_id, leaf_idx, id)."""
    known = found.select(F.col("doc_id").alias("d"), F.col("secret").alias("s"), "id")
    return leaves.join(known, (leaves.doc_id == known.d) & (leaves.value == known.s)).select("doc_id", "leaf_idx", "id")
