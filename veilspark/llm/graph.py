"""Connected components of an edge table, without collecting nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b); component is the smallest node reachable.

    Alternating star contraction: each round hooks every node's larger neighbours, then its smaller ones, to the
    smallest of them, until each component is a star. A round moves at most the edges there are; minima are
    pre-aggregated and written apart from the edges, so a node with very many edges is split where they join (by the
    skew-join rule, or without a shuffle while the minima are few). Each round is written to the shared folder and
    takes the place of the one before. Self-loops and repeated edges change nothing; no edges give no rows.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "lows")
        large = materialize(both.join(low, both.a == low.u).filter("b > a and b > m").select(F.col("m").alias("a"), "b").distinct(), "edges")
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u"), "lows")
        hooked = large.join(least, large.b == least.u).select("m", "a", "b")
        small = hooked.select("m", F.col("b").alias("v")).union(hooked.select("m", F.col("a").alias("v"))).filter("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        old, now = now, materialize(small, "edges")
        for done in (old, low, large, least):
            discard(done)
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a"), F.min("b")).first())
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
