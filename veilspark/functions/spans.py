"""Byte spans in texts as column expressions: find, merge, exclude, number, replace.

A span is a struct (start, end, label) of UTF-8 byte offsets, end exclusive. Everything here is built from JVM
expressions, so a plan that redacts a text column is one stage without a shuffle. Whatever a lambda needs from outside
it is bound by `let` first, since an expression inside a lambda is evaluated for every element; and `scan` collects
results in blocks, since each concatenation copies an array. So the work stays about linear in the spans of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,label:string>>"
SECRET_SPAN = "array<struct<start:int,end:int,label:string,secret:string>>"
BLOCK = 64


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Go through items with a state; step(state, item) gives the next state and an array of results, of type kind."""
    none_of = F.array().cast(kind)
    zero = F.struct(state.alias("state"), none_of.alias("block"), F.array().cast(f"array<{kind}>").alias("done"))

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        full = F.size(acc["block"]) >= BLOCK
        block = F.concat(F.when(full, none_of).otherwise(acc["block"]), out)
        done = F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"])
        return F.struct(after.alias("state"), block.alias("block"), done.alias("done"))

    return F.aggregate(items, zero, one, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))


def _found(text: Column, pattern: Column | str) -> Column:
    """Structs (start, end, m) of the non-overlapping matches. Patterns must not match the empty text."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = "array<struct<start:int,end:int,m:string>>"

    def pairs(hits: Column) -> Column:
        gaps = F.slice(F.split(text, p, -1), F.lit(1), F.size(hits))
        return F.zip_with(hits, gaps, lambda m, gap: F.struct(m.alias("m"), F.octet_length(gap).alias("gap"), F.octet_length(m).alias("n")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + x["gap"]
        return a + x["n"], F.array(F.struct(a.alias("start"), (a + x["n"]).alias("end"), x["m"].alias("m")))

    return F.when(F.rlike(text, p), scan(let(F.regexp_extract_all(text, p, F.lit(0)), pairs), F.lit(0), step, kind)).otherwise(F.array().cast(kind))


def find(text: Column, pattern: Column | str, label: str, keep: Callable[[Column], Column] | None = None, part: Callable[[Column], tuple[Column, Column]] | None = None) -> Column:
    """Spans of a pattern. keep(match) filters; part(match) gives byte offsets in the match to report instead of all."""
    found = _found(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["m"]))

    def span(x: Column) -> Column:
        a, b = (F.lit(0), x["end"] - x["start"]) if part is None else part(x["m"])
        return F.struct((x["start"] + a).cast("int").alias("start"), (x["start"] + b).cast("int").alias("end"), F.lit(label).alias("label"))

    spans = F.filter(F.transform(found, span), lambda x: x["end"] > x["start"])
    return F.coalesce(spans, none())


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return _piece(F.encode(text, "UTF-8"), start, end)


def _piece(raw: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(raw, start + 1, end - start), "UTF-8")


def merge(spans: Column) -> Column:
    """Sorted and joined where they overlap or touch; the first label (by start, longest, name) stays."""
    sort_key = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["label"].alias("label"))
    last = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("back"), F.lit("").alias("label"))  # behind all, to let go of the last span

    def step(open_: Column, s: Column) -> tuple[Column, Column]:
        new = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label"))
        grown = F.struct(open_["start"].alias("start"), F.greatest(open_["end"], -s["back"]).alias("end"), open_["label"].alias("label"))
        joins = s["start"] <= open_["end"]
        return F.when(joins, grown).otherwise(new), F.when(joins | (open_["end"] < 0), none()).otherwise(F.array(open_))

    nothing = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("label"))
    joined = lambda given: scan(F.concat(F.array_sort(F.transform(given, sort_key)), F.array(last)), nothing, step, SPAN)
    return let(spans, lambda given: F.when(F.size(given) < 2, given).otherwise(joined(given)))


def outside(spans: Column, zones: Column) -> Column:
    """Spans that lie within none of the zones: none of those that begin no later ends where they do or behind."""

    def entries(some: Column, is_span: int) -> Column:
        return F.transform(some, lambda s: F.struct(s["start"].alias("start"), F.lit(is_span).alias("is_span"), s["end"].alias("end"), s["label"].alias("label")))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        here = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
        return F.when(x["is_span"] == 0, F.greatest(reach, x["end"])).otherwise(reach), F.when((x["is_span"] == 1) & (reach < x["end"]), here).otherwise(none())

    rest = lambda given, near: scan(F.array_sort(F.concat(entries(near, 0), entries(given, 1))), F.lit(-1), step, SPAN)
    return let(spans, lambda given: F.when(F.size(given) == 0, given).otherwise(let(zones, lambda near: F.when(F.size(near) == 0, given).otherwise(rest(given, near)))))


def secrets(text: Column, spans: Column) -> Column:
    """The texts of the spans."""
    return let(F.encode(text, "UTF-8"), lambda raw: F.transform(spans, lambda s: _piece(raw, s["start"], s["end"])))


def with_secrets(text: Column, spans: Column) -> Column:
    """The spans with the texts they cover, so that rows made of them needn't carry the whole text."""
    named = lambda raw, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), _piece(raw, s["start"], s["end"]).alias("secret"))
    return let(F.encode(text, "UTF-8"), lambda raw: F.transform(spans, lambda s: named(raw, s)))


def replace(text: Column, spans: Column, tokens: Column) -> Column:
    """The text with each of the disjoint sorted spans replaced by the token at its place."""

    def parts(raw: Column, some: Column, put: Column) -> Column:
        before = lambda i: F.coalesce(F.get(some, i - 1)["end"], F.lit(0))
        each = F.transform(some, lambda s, i: F.concat(_piece(raw, F.when(i > 0, before(i)).otherwise(0), s["start"]), F.get(put, i)))
        return F.concat(F.array_join(each, ""), _piece(raw, F.element_at(some, -1)["end"], F.octet_length(raw)))

    body = lambda some: let(tokens, lambda put: let(F.encode(text, "UTF-8"), lambda raw: parts(raw, some, put)))
    return let(spans, lambda some: F.when(F.size(some) == 0, text).otherwise(body(some)))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character; characters are summed in order, so the result is the same everywhere."""

    def bits(t: Column) -> Column:
        share = lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(t)
        return F.aggregate(F.transform(F.array_sort(F.array_distinct(F.split(t, ""))), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return let(token, bits)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a byte offset."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset)
    head = F.decode(head, "UTF-8")
    return (F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """1-based byte column of a byte offset."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "UTF-8")
    return (F.octet_length(F.substring_index(head, "\n", -1)) + 1).cast("int")
