"""Toxicity and mixing."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.llm import mixing, toxicity

R = random.Random(1)
CLEAN = [a + b for a in "bcdfglmnprst" for b in ("ala", "eno", "iri", "osu")]
BAD = ["dreckig", "mistig", "lump"]


def text(toxic):
    words = [R.choice(CLEAN) for _ in range(R.randrange(20, 80))]
    for _ in range(2 * toxic):
        words.insert(R.randrange(len(words)), R.choice(BAD) + R.choice(["", ".", "!"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(1200)]
    documents = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(None, "lump lump", 0.1, "x"), (5000, None, 0.1, "x"), (5001, "", 0.1, "x")], "doc_id bigint, text string, score double, place string").repartition(3).cache()
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, 1)], "doc_id bigint, toxic int, weight int")
    return rows, documents, labels


def test_toxicity_on_held_out_rows(corpus):
    rows, documents, labels = corpus
    model = toxicity.fit(documents, labels.where(~toxicity.is_held_out()))
    got = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(y) for i, y in held)
    assert len(held) > 200 and right / len(held) > 0.97 and all(0 <= s <= 1 for s in got.values())
    assert got[None] > 0.3 and got[5000] == got[5001] < 0.3
    assert len(model.places) < 1000  # sparse
    kept = toxicity.reject(documents, model)
    assert kept.columns == documents.columns and kept.count() == sum(s < 0.3 for s in got.values())


def test_toxicity_does_not_see_held_out_labels(corpus):
    _, documents, labels = corpus
    one = toxicity.fit(documents, labels.where(~toxicity.is_held_out()))
    turned = labels.withColumn("toxic", F.when(toxicity.is_held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    two = toxicity.fit(documents, turned.where(~toxicity.is_held_out()))
    assert np.array_equal(one.places, two.places) and np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_toxicity_without_labels(corpus):
    _, documents, labels = corpus
    model = toxicity.fit(documents, labels.limit(0))
    assert {r.score for r in toxicity.score(documents, model).collect()} == {1 / (1 + np.exp(3.0))}
    assert toxicity.score(documents.limit(0), model).count() == 0


def test_mixing_meets_the_targets(spark):
    rows = [(i, " ".join(["w"] * R.randrange(60, 100)), "abc"[min(2, i % 5)], ["en", "de"][i % 3 == 0], i) for i in range(4000)]
    odd = [(None, "x y", None, None, 1), (9001, None, "a", "en", 1), (9002, "", "a", "en", 1), (7, rows[7][1], rows[7][2], rows[7][3], 1)]
    documents = spark.createDataFrame(rows + odd, "doc_id bigint, text string, source string, lang string, p int").cache()
    cells = mixing.cells_of(documents).cache()
    assert cells.agg(F.sum("t")).first()[0] == sum(len((r[1] or "").split()) for r in rows + odd)
    want = {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"article": 1.0}}
    targets = {d: spark.createDataFrame([*w.items(), ("nowhere", 0.3)], "value string, share double") for d, w in want.items()}
    raked = mixing.rake(cells, targets).toPandas()
    for d, shares in want.items():
        own = raked.groupby(d).raked.sum() / raked.raked.sum()
        assert all(abs(own[v] - s) < 1e-3 for v, s in shares.items())
    got = mixing.mix(documents, targets=targets).toPandas()
    assert set(got.columns) == {"doc_id", "text", "source", "lang", "p"}
    tokens = got.text.fillna("").str.split().str.len()
    for v, s in want["source"].items():
        assert abs(tokens[got.source == v].sum() / tokens.sum() - s) < 0.04
    assert len(got) == len(mixing.mix(documents, targets=targets).toPandas())


def test_mixing_defaults_and_empty(spark):
    rows = spark.createDataFrame([(1, "a b c", "s", "en"), (2, None, None, None), (None, "z", "s", "en")], "doc_id bigint, text string, source string, lang string")
    assert {r.doc_id for r in mixing.chosen(rows).collect()} == {1, 2, None}
    assert mixing.mix(rows.limit(0)).count() == 0


def test_mixing_with_clashing_names(spark):
    names = ("_tokens", "_source", "_lang", "_topic", "_p", "_kept", "row", "_mix_p")
    rows = spark.createDataFrame([(k, "a b c", "s", "en", *names) for k in range(3)] + [(3, None, "s", None, *names)], "doc_id bigint, text string, source string, lang string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(rows)
    assert got.columns == rows.columns and sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())


def test_raking_goes_on_until_the_targets_are_met(spark):
    # source and language tell of each other: six rounds are too few
    cells = spark.createDataFrame([("a", "x", "t", 6000), ("a", "y", "t", 900), ("b", "x", "t", 1200), ("b", "y", "t", 1900)], "source string, lang string, topic string, t bigint")
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.45, "y": 0.55}, "topic": {"t": 1.0}}
    raked = mixing.rake(cells, {d: spark.createDataFrame([*w.items()], "value string, share double") for d, w in want.items()}).toPandas()
    for d, shares in want.items():
        own = raked.groupby(d).raked.sum() / raked.raked.sum()
        assert all(abs(own[v] - s) < 1e-8 for v, s in shares.items())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_mixing_query_has_the_rows_of_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    names = ["doc_id", "topic", "n_tokens", "probability", "kept"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({mixing.oracle()})").fetchall())
    got = sorted(tuple(r) for r in mixing.op6_mixing(spark, data).select(*names).collect())
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert all(abs(g[3] - w[3]) <= 2e-9 for g, w in zip(got, want, strict=True))
