"""Cases that a cut would lose: links past the stars, passages with inner repeats, bounds met exactly, short lines."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelark.llm import linking, lines, substring


@pytest.mark.parametrize(("settings", "hubs"), [({}, 1), ({}, 4), ({"cell": 2}, 4)])
def test_links_of_rows_that_are_no_centre(spark, settings, hubs):
    # x and z are alike; they share a token only with more central rows that are like neither
    rows = [(1, 10 + k, 9 - k) for k in range(hubs)] + [(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 10, 5)]
    frame = spark.createDataFrame(rows, "token int, id bigint, central int")
    seen = []

    def verify(pairs):
        seen.extend((r.u, r.v) for r in pairs.collect())
        return pairs.where("u = 1 and v = 2")

    found = linking.link(frame, lambda a, b: F.lit(True), verify, **settings)
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1)}
    assert len(seen) == len(set(seen))


def test_lines_of_exactly_the_similarity(spark):
    sizes = [n for n in range(1, 400)]
    rows = spark.createDataFrame([(n,) for n in sizes], "n int")
    assert [(r.n, r.most) for r in rows.select("n", lines.most_edits(F.col("n"), 0.8).alias("most")).orderBy("n").collect()] == [(n, (100 - 80) * n // 100) for n in sizes]


def test_line_pair_of_exactly_the_similarity(spark):
    # 50 letters, 10 of them changed at the end of each line: no gate of bits
    one, two = "ab " * 13 + "cdefghijklm", "ab " * 13 + "cnopqrstuvw"
    rows = spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")
    assert len(one) == 50 and {r.doc_id: r.kept for r in lines.occurrences(rows, bits=64).collect()} == {1: True, 2: False}


def shingles(words):
    return np.array([hash(tuple(words[k : k + 5])) & (2**64 - 1) for k in range(len(words) - 4)], np.uint64)


def inner_repeat(n, *places):
    words = [f"w{k}" for k in range(n)]
    for p in places:
        words[p : p + 5] = "the same five words here".split()
    return words


@pytest.mark.parametrize("passage", [inner_repeat(60, 10, 40), inner_repeat(90, 20, 60), [f"w{k}" for k in range(30)] * 10])
def test_exact_passages_with_inner_repeats(passage):
    one = [f"a{k}" for k in range(20)] + passage + [f"b{k}" for k in range(20)]
    two = [f"c{k}" for k in range(7)] + passage + [f"d{k}" for k in range(30)]
    n = len(passage) - 4
    assert substring.matches(shingles(one), shingles(two), substring.Settings())[0] == (20, 19 + n, 7, 6 + n, 1.0)


def test_passages_with_inner_repeats(spark):
    passage = inner_repeat(60, 10, 40)
    rows = [(k, " ".join([f"{k}a{i}" for i in range(40)] + passage + [f"{k}b{i}" for i in range(40)])) for k in range(2)]
    found = substring.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.first_word, r.n_words, r.source_doc_id, r.source_first_word) for r in found] == [(1, 40, 60, 0, 40)]


@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 40))
@examples(max_examples=200, deadline=None)
def test_segments_by_brute_force(one, two, at_once):
    want = set()
    for i in range(len(one)):
        for j in range(len(two)):
            if one[i] == two[j] and (not i or not j or one[i - 1] != two[j - 1]):
                n = 1
                while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n]:
                    n += 1
                want.add((i, j, n))
    got = substring.segments(np.array(one, np.uint64), np.array(two, np.uint64), at_once)
    assert len(got) == len(want) and set(map(tuple, got.tolist())) == want


def test_exact_repeats_of_short_lines(spark):
    import corpus_pipeline

    texts = [(1, "Les.\n12 34\n----\n\n \t\n吾輩は猫である。"), (2, "one two three\nles\n 12 34\n12 35\n----\n\n \t\n吾輩は猫である。")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, rows, "").collect()} == {1: texts[0][1], 2: "one two three\n12 35\n\n \t"}
    assert {(r.doc_id, r.place) for r in lines.occurrences(rows).where("not kept").collect()} == {(2, 1), (2, 2), (2, 4), (2, 7)}
