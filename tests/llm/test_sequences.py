"""Packing and token counts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievelark.llm import bpe, packing, token_counts

TEXTS = [(1, "Hello world, hello tokens."), (2, ""), (3, None), (4, "été ñandú 漢字 🙂 " * 400), (None, "no id"), (5, "same"), (5, "same"), (6, "special <|endoftext|> inside"), (7, "a\n\n b\t" * 50)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id bigint, text string, length string, offset int")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_path())


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_tokenizers(text):
    own = bpe.vocabulary(bpe.default_path())
    assert own.ids(text).tolist() == own.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [16, 1024])
def test_every_id_in_one_piece(documents, reference, window):
    rows = packing.pack(documents, window=window).collect()
    want = Counter()
    for doc, text in TEXTS:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[doc, len(ids), ids.tobytes()] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for (doc, total, data), n in want.items():
        own = [r for r in by_doc[doc] if r.doc_tokens == total]
        assert sum(r.length for r in own) == total * n
        for r in own:
            assert r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0  # no sequence needs padding
        assert at <= window


@given(st.lists(st.integers(1, 70), max_size=60))
@settings(deadline=None)
def test_levels_choose_the_least_sum_of_squares(sizes):
    levels, count = packing.Levels(32), np.zeros(33, int)
    for k, size in enumerate(s % 32 + 1 for s in sizes):
        best = {}
        for level in range(33 - size):
            if level and not count[level]:
                continue
            after = count.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            best[level] = int((after[1:32] ** 2).sum())
        chosen = levels.level_for(size)
        assert best[chosen] == min(best.values()) and chosen == max(h for h, v in best.items() if v == min(best.values()))
        levels.place((k, 0, np.zeros(size, np.uint32), size))
        if chosen:
            count[chosen] -= 1
        if chosen + size < 32:
            count[chosen + size] += 1
        assert (levels.count[1:32] == count[1:32]).all()


def test_pack_empty_table(documents):
    assert packing.pack(documents.limit(0)).count() == 0


def test_token_counts(spark, documents, reference):
    lengths = [len(reference.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS]
    sums = token_counts.suffix_sums(token_counts.histogram(documents)).cache()
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        assert r.docs_at_least == sum(n >= limit for n in lengths) and r.tokens_at_least == sum(n for n in lengths if n >= limit)
        assert r.tokens_truncated == sum(min(n, limit) for n in lengths)
        assert abs(r.fit_fraction - sum(n <= limit for n in lengths) / len(lengths)) < 1e-12
    for limit in (1, 5, 100, 10**6):
        r = token_counts.at_limit(sums, limit).first()
        assert r.docs_over == sum(n >= limit for n in lengths) and r.tokens_truncated == sum(min(n, limit) for n in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.suffix_sums(token_counts.histogram(documents.limit(0))).count() == 0
