"""Exact top-k and approximate neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.llm import ann, topk

RNG = np.random.default_rng(3)
VECTORS = RNG.normal(size=(1200, 16)).astype(np.float32)
VECTORS[600:700] = VECTORS[600] + 0.01 * RNG.normal(size=(100, 16)).astype(np.float32)
VECTORS[50] = VECTORS[150]
ODD = [(2000, None), (2001, []), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2004, [None] * 16), (2005, [0.0] * 16), (None, [1.0] * 16), (100, VECTORS[100].tolist())]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(VECTORS)] + ODD
    return spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id bigint, embedding array<float>, id int, rank int").repartition(3).cache()


def test_topk_is_exact(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in topk.op7_exact_topk(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(1024 * v.astype(np.float64)).astype(np.int64) for i, v in enumerate(VECTORS)} | {2005: np.zeros(16, np.int64)}
    assert set(got) == {i for i in whole if i % 100 == 0}
    for q, rows in got.items():
        want = sorted((-int(v @ whole[q]), i) for i, v in whole.items() if i != q)[:10]
        assert sorted(rows) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_topk_small_blocks_and_few_rows(spark):
    rows = spark.createDataFrame([(i, [int(x) for x in RNG.integers(-5, 6, 4)]) for i in range(30)], "id bigint, v array<bigint>").cache()
    one = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(rows, rows.where("id % 7 = 0"), 5, rows_per_block=4, queries_per_block=2).collect()}
    assert one == {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(rows, rows.where("id % 7 = 0"), 5).collect()}
    few = topk.search(rows.limit(3), rows.limit(3), 10)
    assert few.count() == 6
    assert topk.search(rows.limit(0), rows.limit(0), 10).count() == 0


def test_ann_recall(spark, table):
    small = ann.Settings(k=20, reverse=15, offers=8, rounds=3, tables=2, block=128, beam=60, width=20, steps=2)
    rows = ann.nearest(table, F.col("id") % 20 == 0, settings=small).collect()
    exact = VECTORS.astype(np.float64)
    hits = total = 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
        assert r.query_id != r.vec_id and abs(r.score - float(exact[r.query_id] @ exact[r.vec_id])) < 1e-9
    assert set(by) == set(range(0, 1200, 20))
    for q, own in by.items():
        s = exact @ exact[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(len(s)), -s))[:20].tolist())
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(own, own[1:], strict=False))
        hits += len(want & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9


def test_ann_few_rows(spark, table):
    rows = ann.nearest(table.where("vec_id < 4"), F.col("id") % 2 == 0)
    assert rows.count() == 6
    assert ann.nearest(table.limit(0), F.col("id") % 2 == 0).count() == 0


def test_ann_lets_go_of_each_round(spark, table, monkeypatch):
    """Shuffles of a round are let go of before the next one."""
    calls = []
    monkeypatch.setattr(ann, "release", lambda own: calls.append(own))
    small = ann.Settings(k=5, reverse=5, offers=3, rounds=2, tables=1, block=64, beam=10, width=5, steps=2)
    assert ann.nearest(table.where("vec_id < 200"), F.col("id") % 20 == 0, k=3, settings=small).count() == 30
    assert len(calls) == 1 + small.rounds + small.steps
