"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from veilspark.llm import bpe, chat, common, decontam, license, lm, neardup, quality, repeats, secrets, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Names that operators use inside, as columns of the input.
CLASHES = ["tile", "family", "kept", "__q_", "__dropped", "__n", "__again", "spans", "formatted", "token_ids", "n_tokens", "term", "own_id", "dir", "component", "node", "fate", "kind", "part", "chunk", "data"]
sha = lambda b: hashlib.sha256(b).hexdigest()


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHES if extra else []:
        df = df.withColumn(c, F.lit("mine"))
    return df.repartition(3)


def operators():
    byte, piece = public_tokenizers.path(BYTE), public_tokenizers.path(PIECE)
    return {
        "bpe": lambda df, _b: bpe.round_trip(df, byte), "secrets": lambda df, _b: secrets.scan(df), "license": lambda df, _b: license.scan(df, F.concat(F.lit("d/"), F.col("doc_id").cast("string"))),
        "neardup": lambda df, _b: neardup.near_duplicates(df), "repeats": lambda df, _b: repeats.remove_repeats(df), "lm": lambda df, _b: lm.score(df, piece), "quality": lambda df, _b: quality.score(df), "decontam": decontam.search,
        "warc": lambda df, _b: warc.archive_pages(df.select(F.col("doc_id").alias("page_id"), F.lit("http://h/x").alias("url"), F.col("text").alias("html"), *[c for c in df.columns if c not in ("doc_id", "text", "kind", "part")])),
        "chat": lambda df, _b: chat.read_back(chat.format_turns(df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", "formatted", "spans"))),
    }


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "tie one two three four five six"), (5, "tie one two three four five six"), (4, "tie one two three four five six"), (None, "no id here at all"), (None, None), (2**60 + 1, "large id")]


@pytest.mark.parametrize("name", ["bpe", "secrets", "license", "neardup", "repeats", "lm", "quality", "decontam", "warc", "chat"])
def test_operators(spark, name):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, None), (2, ""), (1, "one two three four five six")], "item_id long, text string")
    run = operators()[name]
    out = run(table(spark, ROWS), bench).collect()
    key = {"warc": "page_id", "chat": "conv_id"}.get(name, "doc_id")
    ids = sorted((r[key] for r in out), key=str)
    if name == "decontam":
        assert {(r.doc_id, r.item_id) for r in out} == {(4, 1), (5, 1)} and len(out) == 3
    elif name == "chat":
        assert ids == sorted({i for i, _ in ROWS}, key=str) and {r.conv_id: r.n_turns for r in out}[4] == 2
    else:
        assert ids == sorted((i for i, _ in ROWS), key=str)
    assert run(table(spark, ROWS).limit(0), bench).collect() == []
    if name == "decontam":
        assert run(table(spark, ROWS), bench.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "secrets", "bpe"])
def test_stages(spark, name, tmp_path):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = " ".join(f"word{i} and more" for i in range(80))
    rows = [*ROWS, (20, prose), (20, prose), (21, prose + " end."), (22, None)]
    df = table(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    stage = stages()[name]
    out = stage(spark, df, str(tmp_path))
    if name != "bpe":
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    every = sorted(rows, key=str)
    if name == "decontamination":
        assert got == sorted([x for x in rows if "tie one" not in (x[1] or "")], key=str)
    elif name == "near_duplicates":
        assert len(got) == len(set(got)) + 0 and {i for i, _ in got} == {1, 2, 3, 4, None, 2**60 + 1, 20, 22}
    elif name == "quality":
        assert {i for i, _ in got} <= {20, 21}
    else:
        assert got == every
    assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "token_ids" in out.columns


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choices(words, k=1_700_000))
    prose = prose[: len(prose) // 2] + " password=hunter2hunter2\nLicensed under the Apache License, Version 2.0.\n" + prose[len(prose) // 2 :]
    solid = base64.b64encode(rng.randbytes(1_500_000)).decode().replace("/", "a").replace("+", "b")
    return [(1, prose), (2, prose + " x"), (3, solid), (4, "short one")]


@pytest.mark.parametrize("name", ["bpe", "secrets", "license", "neardup", "repeats", "lm", "quality", "decontam", "warc", "chat"])
def test_long_texts(spark, long_rows, name):
    """Ten million characters of words, and two million without a space."""
    prose = long_rows[0][1]
    assert len(prose) > 9_000_000
    item = " ".join(prose.split()[1000:1030])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {(r.page_id if name == "warc" else r.conv_id if name == "chat" else r.doc_id): r for r in operators()[name](table(spark, long_rows), bench).collect()}
    if name == "bpe":
        assert all(r.is_lossless for r in out.values()) and out[1].decoded_sha256 == sha(prose.encode())
    elif name == "secrets":
        at = prose.index("password=")
        assert f"assign:{at}:{at + 23}" in out[1].spans and out[2].n_assign == 1
    elif name == "license":
        assert out[1].own_license == "Apache-2.0" and out[3].own_license is None
    elif name == "neardup":
        assert out[2].component_id == 1 and out[3].component_id == 3
    elif name == "repeats":
        assert out[1].n_removed == 0 and out[2].n_removed == len(prose) and out[2].kept_sha256 == sha(b" x")
    elif name == "lm":
        assert out[1].n_tokens == len(prose.split()) + 1 and math.isfinite(out[3].score) and out[3].n_tokens == 2
    elif name == "quality":
        assert out[1].n_words == len(prose.split()) and out[1].base_failed == (100 * out[1].n_repeat_words > 50 * out[1].n_words)
    elif name == "decontam":
        assert set(out) == {1, 2} and out[1].distance == 0 and out[1].at_word == 1000
    elif name == "warc":
        assert out[1].payload_bytes == len(prose)
    else:
        assert out[1].formatted_chars == len(prose) + len("[INST]  [/INST]")


def test_cluster_needs_a_shared_folder(spark):
    assert common.is_local("local") and common.is_local("local[4]") and not common.is_local("local-cluster[3,2,1024]") and not common.is_local("spark://h:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.open_store("wasb://x/y")


def test_statements_without_a_cue_word(spark):
    rows = [(1, "Released under the MIT."), (2, "This Source Code Form is subject to the terms of the Mozilla Public, v. 2.0."), (3, "To the extent possible under law, the author has waived all related rights to this work."), (4, "the work of the source file is found in the file")]
    got = {r.own_id: r.own_license for r in license.own_licenses(table(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MPL-2.0", 3: "CC0-1.0"}


def test_label_model_against_enumeration():
    """The posterior by Bayes' rule over both classes, and the column expression against it."""
    import itertools

    model = quality.LabelModel(["a", "b", "c"]).fit({(1, 1, None): 50, (0, None, 0): 9, (1, 0, 1): 20, (None, None, None): 3})
    for pattern in itertools.product((None, 0, 1), repeat=3):
        good, bad = model.prior, 1 - model.prior
        for i, v in enumerate(pattern):
            if v is not None:
                g, b = (model.good[i], model.bad[i]) if v else (1 - model.good[i], 1 - model.bad[i])
                if (g >= b) == bool(v):  # a vote against the rule's own sense counts nothing
                    good, bad = good * g, bad * b
        assert math.isclose(model.posterior(pattern), good / (good + bad), rel_tol=1e-9)


def test_label_model_column(spark):
    model = quality.LabelModel(["a", "b"]).fit({(1, 1): 50, (0, 0): 9, (1, None): 5})
    patterns = [(x, y) for x in (None, 0, 1) for y in (None, 0, 1)]
    df = spark.createDataFrame(patterns, "a int, b int")
    for r in df.select("a", "b", model.column().alias("p")).collect():
        assert math.isclose(r.p, model.posterior((r.a, r.b)), rel_tol=1e-9)


def test_decontamination_recall():
    """Windows at the largest distance share a table with their item as often as asked."""
    import numpy as np

    rng = np.random.default_rng(11)
    for w in (5, 8, 13, 21, 50):
        k = int(0.2 * w)
        items = [rng.integers(1, 1 << 62, w, dtype=np.uint64) for _ in range(60)]
        tables = decontam.tables_for(items, k, 0.99)
        assert tables
        plain = [items[i % 60] for i in range(600)]
        other = [(decontam.edited(x.tolist(), k, rng) + rng.integers(1, 1 << 62, w).tolist())[:w] for x in plain]
        keys = lambda rows: decontam.table_keys(np.array(rows, np.uint64), tables)  # noqa: E731, B023
        assert (keys(plain) == keys(other)).any(axis=1).mean() >= 0.97
        apart = [rng.integers(1, 1 << 62, w).tolist() for _ in range(600)]
        assert (keys(plain) == keys(apart)).any(axis=1).mean() < 0.05
