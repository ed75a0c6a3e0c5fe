"""The pipeline's stages on a small corpus, each against what it must keep and drop."""

import os

import pytest

import corpus_pipeline
from sievelark.llm import jaccard, lines, mixing, packing, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        after = after if name == "packing" else lines.written(after)
        out.append((name, docs, after.cache()))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)
            assert ids(after) <= ids(before)


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(~toxicity.is_held_out())
    scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.fit(before, labels)).collect()}
    assert ids(after) == {i for i, s in scores.items() if s < 0.3}


def test_line_stage(stages):
    before, after = stages["line dedup"]
    gone = {}
    for r in lines.occurrences(before).where("not kept").collect():
        gone.setdefault(r.doc_id, set()).add(r.place)
    want = {}
    for r in before.collect():
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(r.doc_id, ()))
        if r.doc_id not in gone or text.strip(" "):
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after.collect()} == want
    forms = [r.line for r in lines.lines_of(after).collect()]
    assert len(forms) == len(set(forms))


def test_jaccard_stage(stages):
    before, after = stages["n-gram Jaccard join"]
    assert ids(after) == {r.doc_id for r in jaccard.groups(before).where("component_id = doc_id").collect()}


def test_mixing_stage(stages):
    before, after = stages["mixing sources"]
    assert ids(after) == {r.doc_id for r in mixing.chosen(before).where("_kept").collect()}
    assert after.count() > 0.5 * before.count()


def test_packing_stage(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == ids(before)
    for r in rows:
        assert r.offset + r.length <= packing.WINDOW


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None
