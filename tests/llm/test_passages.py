"""Substring dedup against brute force: every exact repeat of 50 words, whatever else holds its shingles, and edited ones."""

import random

import pytest

from sievelark.llm import substring

WORDS = [a + b for a in ("al", "ber", "cor", "dun", "es", "fal") for b in ("a", "en", "is", "or", "um", "yx")]


def prose(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(30)) for _ in range(n)]


def frame(spark, texts, extra=""):
    return spark.createDataFrame([(i, " ".join(t) if t is not None else None, "x") for i, t in texts], f"doc_id bigint, text string, {extra or 'lang'} string").repartition(4)


def uncovered(texts, rows, width=50):
    """Windows of `width` words that a lower document has too and no row covers."""
    by, first = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.first_word, r.first_word + r.n_words))
    out, repeats = [], 0
    for i, words in sorted((i, t) for i, t in texts if i is not None and t):
        for a in range(len(words) - width + 1):
            own = tuple(words[a : a + width])
            if first.setdefault(own, i) != i:
                repeats += 1
                if not any(x <= a and a + width <= y for x, y in by.get(i, ())):
                    out.append((i, a))
    return repeats, out


def test_every_exact_repeat(spark):
    r = random.Random(4)
    pool = [prose(k, r.randrange(50, 130)) for k in range(12)]
    texts = []
    for i in range(60):
        own = []
        for k in range(r.randrange(1, 5)):
            p = r.choice(pool)
            cut = r.randrange(len(p) - 49)
            own += prose(1000 + 10 * i + k, r.randrange(40)) + (p if r.random() < 0.5 else p[cut : cut + 50])
        texts.append((i, own))
    rows = substring.passages(frame(spark, texts)).collect()
    repeats, missed = uncovered(texts, rows)
    assert repeats > 2000 and not missed
    words = dict(texts)
    for x in rows:
        assert x.source_doc_id < x.doc_id and x.n_words >= 50 and x.similarity >= 0.8
        if x.similarity == 1.0 and x.n_words == x.source_n_words == 50:
            assert words[x.doc_id][x.first_word : x.first_word + 50] == words[x.source_doc_id][x.source_first_word : x.source_first_word + 50]


@pytest.mark.parametrize("hot", [1024, 5])
def test_distractors_take_no_place(spark, monkeypatch, hot):
    # many documents hold single shingles, or half, of a passage that only two documents share
    monkeypatch.setattr(substring, "HOT", hot)
    passage = prose(1, 50)
    texts = [(k, prose(100 + k, 30) + passage[k % 46 : k % 46 + 5] + prose(300 + k, 30)) for k in range(120)]
    texts += [(200 + k, prose(500 + k, 20) + passage[:30] + prose(700 + k, 20)) for k in range(30)]
    texts += [(400, prose(900, 40) + passage + prose(901, 40)), (401, prose(902, 10) + passage + prose(903, 40))]
    rows = substring.passages(frame(spark, texts)).collect()
    assert [(r.doc_id, r.source_doc_id, r.first_word, r.n_words, r.source_first_word, r.similarity) for r in rows] == [(401, 400, 10, 50, 40, 1.0)]


def test_core_of_an_edited_copy(spark):
    # an exact run between stretches that are edited beyond the threshold
    one, r = prose(5, 300), random.Random(9)
    two = [w if 110 <= k < 180 or r.random() < 0.6 else f"new{k}" for k, w in enumerate(one)]
    rows = substring.passages(frame(spark, [(1, one), (2, two)])).collect()
    assert any(x.first_word <= 110 and x.first_word + x.n_words >= 180 for x in rows)


def test_edited_passages(spark):
    r, texts = random.Random(6), []
    for k in range(60):
        own = prose(2000 + k, 100)
        other = list(own)
        for at in (33, 66):  # 86 of 106 shingles are shared, and no run of 50 words
            other[at + r.randrange(-2, 3)] = f"edit{k}"
        texts += [(2 * k, prose(3000 + k, 30) + own), (2 * k + 1, other + prose(4000 + k, 30))]
    found = {r.doc_id for r in substring.passages(frame(spark, texts)).collect() if r.n_words >= 50}
    assert len(found & {2 * k + 1 for k in range(60)}) >= 57


def test_odd_rows(spark):
    p = prose(7, 60)
    texts = [(1, p), (1, p), (None, p), (2, None), (3, []), (4, p[:49]), (5, ["w"] * 20000), (6, ["w"] * 300), (7, [x.upper() for x in p])]
    rows = substring.passages(frame(spark, texts, "first_word")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(6, 5), (7, 1)}
    assert substring.passages(frame(spark, texts).limit(0)).count() == 0
