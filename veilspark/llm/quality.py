"""Quality rules by weak supervision, in DataFrame functions only.

Each rule reads per-document features and votes good (1), bad (0) or abstains (null). The votes of all documents
are counted by pattern (at most 3^rules rows, whatever the input), expectation-maximisation over those counts
estimates how often each rule votes good for good and for bad documents, and a document is kept if its posterior
probability of being good is at least one half. A few stated floors (`base_failed`) still reject on their own.

Three of the rules read symbols in ways that are close to each other, so the model counts their evidence as if it were
independent. With one vote for the three the fitted classes lose the bad documents (figures in the README); so they stay.

A null or empty text has no words and fails the floors. Repeated rows count and are judged alike; there are no
ties. An empty table learns nothing and returns no rows. Other columns are not read, except by `keep_good`, which
returns its input's columns unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_symbol_words"]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id (or, with keep, all columns of df) and FEATURES of whole texts. One stage, no shuffle.

    Repeated 3-word windows are found per text by sorting the 64-bit hashes of its windows, which costs
    n log n in its words; texts without a repeated window skip the sort.
    """
    mine = "__q_"
    base = [F.col(c) for c in df.columns] if keep else [F.col(id_col).cast("long").alias("doc_id")]
    names = df.columns if keep else ["doc_id"]
    c = lambda x: F.col(mine + x)
    step = lambda d, **new: d.select(*d.columns, *[v.alias(mine + k) for k, v in new.items()])
    df = df.select(*base, F.coalesce(F.col(text_col), F.lit("")).alias(mine + "text"))
    df = step(df, trim=F.trim(c("text"), F.lit(SPACE)), lines=F.filter(F.split(c("text"), "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != ""))
    df = step(df, words=F.when(c("trim") == "", F.array().cast("array<string>")).otherwise(F.split(c("trim"), r"[ \t\n\x0B\f\r]+", -1)))
    words = c("words")
    df = step(df, windows=F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    windows = c("windows")
    df = step(df, sorted=F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = c("sorted")
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    df = step(df, hits=F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(F.when(i == 0, F.get(s, F.lit(1))["h"] == x["h"]).otherwise(same(x, i)), F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    p = c("hits")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    text, lines = c("text"), c("lines")
    return df.select(
        *names,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: w != F.translate(w, SYMBOLS, ""))).cast("long").alias("n_symbol_words"),
        F.size(F.filter(lines, lambda x: F.right(x, F.lit(1)).isin(".", "!", "?", '"', ":", "…", "。"))).cast("long").alias("n_ends"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, null abstains."""
    n = F.col("n_words")
    vote = lambda good, bad: F.when(bad, 0).when(good, 1)
    mean = F.try_divide("word_chars", "n_words")
    return {
        "v_length": vote(n >= 100, n < 50),
        "v_word_length": vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        "v_symbols": vote(F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 10 > n),
        "v_symbol_share": vote(F.col("n_symbols") * 200 <= F.col("word_chars"), F.col("n_symbols") * 10 > F.col("word_chars")),
        "v_symbol_words": vote(F.col("n_symbol_words") * 20 <= n, F.col("n_symbol_words") * 10 > n * 3),
        "v_lines": vote(F.col("n_dup_lines") * 20 <= F.col("n_lines"), F.col("n_dup_lines") * 3 > F.col("n_lines")),
        "v_repeats": vote(F.col("n_repeat_words") * 10 <= n, F.col("n_repeat_words") * 3 > n),
        "v_ends": vote(F.col("n_ends") * 2 >= F.col("n_lines"), F.col("n_ends") * 10 < F.col("n_lines")),
    }


class LabelModel:
    """Two-class model of independent voters, fitted on counts of vote patterns."""

    def __init__(self, names: list[str]):
        self.names = names
        self.prior = 0.8
        self.good = [0.9] * len(names)  # P(vote is good | votes, document is good)
        self.bad = [0.3] * len(names)  # P(vote is good | votes, document is bad)

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log-odds of the prior, and of a bad and a good vote of each rule; a rule that would vote against its own sense counts nothing."""
        out = []
        for g, b in zip(self.good, self.bad, strict=True):
            out.append((min(0.0, math.log((1 - g) / (1 - b))), max(0.0, math.log(g / b))))
        return math.log(self.prior / (1 - self.prior)), out

    def posterior(self, pattern: tuple) -> float:
        odds, weights = self.weights()
        odds += sum(weights[i][v] for i, v in enumerate(pattern) if v is not None)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))

    def fit(self, counts: dict[tuple, int], rounds: int = 60) -> LabelModel:
        patterns = sorted(counts.items(), key=lambda x: tuple(-1 if v is None else v for v in x[0]))
        for _ in range(rounds if patterns else 0):
            post = [self.posterior(p) for p, _ in patterns]
            total = sum(n for _, n in patterns)
            self.prior = min(0.99, max(0.5, (sum(n * q for (_, n), q in zip(patterns, post, strict=True)) + 8) / (total + 10)))
            for i in range(len(self.names)):
                seen = [(p[i], n, q) for (p, n), q in zip(patterns, post, strict=True) if p[i] is not None]
                self.good[i] = (sum(n * q * v for v, n, q in seen) + 9) / (sum(n * q for _, n, q in seen) + 10)
                self.bad[i] = (sum(n * (1 - q) * v for v, n, q in seen) + 3) / (sum(n * (1 - q) for _, n, q in seen) + 10)
        return self

    def column(self) -> Column:
        """Posterior probability as an expression over the vote columns."""
        odds, weights = self.weights()
        total = F.lit(odds)
        for name, (bad, good) in zip(self.names, weights, strict=True):
            total = total + F.when(F.col(name) == 1, good).when(F.col(name) == 0, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(features_df: DataFrame) -> LabelModel:
    """Count vote patterns (a bounded table) and fit the label model."""
    rules = votes()
    counts = features_df.select(*[v.alias(k) for k, v in rules.items()]).groupBy(*rules).count().collect()
    return LabelModel(list(rules)).fit({tuple(r[k] for k in rules): r["count"] for r in counts})


def judge(features_df: DataFrame, model: LabelModel) -> DataFrame:
    """Adds the votes, base_failed, p_good and kept."""
    df = features_df.select("*", *[v.alias(k) for k, v in votes().items()], base_failed().alias("base_failed"))
    df = df.withColumn("p_good", model.column())
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features, votes, posterior and verdict of each row. The features are computed once and kept by checkpoint()."""
    from . import common

    common.shared_root(df.sparkSession)
    feats = features(df, id_col, text_col).checkpoint()
    return judge(feats, fit(feats))


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's columns.

    The rows are written once with their features, so that texts are analysed once for the fit and the filter; the
    fit reads the feature columns alone. Nothing is shuffled but counts of vote patterns.
    """
    from . import common

    spare = {c: f"__q_own_{i}" for i, c in enumerate(df.columns)}
    feats = features(df.select([F.col(c).alias(spare[c]) for c in df.columns]), spare[id_col], spare[text_col], keep=True)
    feats = common.materialize(feats, "features")
    return judge(feats, fit(feats)).filter("kept").select([F.col(v).alias(k) for k, v in spare.items()])
