"""Line dedup, n-gram Jaccard join, substring dedup, components and license scans, against brute force."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelark.llm import components as C
from sievelark.llm import jaccard, licenses, lines, prefixes, substring
from sievelark.llm.words import Words, sorted_sets

WORDS = [a + b for a in ("al", "ber", "cor", "dun", "es", "fal") for b in ("a", "en", "is", "or", "um", "yx")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, seed, edits):
    r, own = random.Random(seed), text.split(" ")
    for _ in range(edits):
        own[r.randrange(len(own))] = f"edit{r.randrange(10**6)}"
    return " ".join(own)


BASE = prose(1, 120)
DOCS = (
    [(i, edited(BASE, i, i % 5)) for i in range(40)] + [(40 + i, BASE.upper()) for i in range(5)] + [(50 + i, prose(100 + i, 60)) for i in range(20)]
    + [(70, "one two"), (71, "One  two "), (72, "one two three"), (73, ""), (74, None), (75, " \n\t"), (76, "x"), (80, prose(7, 3000)), (81, edited(prose(7, 3000), 3, 30))]
    + [(90, prose(200, 30) + " " + prose(300, 60) + " " + prose(201, 30)), (91, prose(202, 45) + " " + prose(300, 60) + " " + prose(203, 5))]
)


@pytest.fixture(scope="module")
def documents(spark):
    own = spark.createDataFrame([(i, t, "en", i, 5) for i, t in DOCS], "doc_id bigint, text string, lang string, n bigint, token int")
    return own.repartition(3).cache()


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@given(st.lists(st.text(st.sampled_from("aAbB é\n\t\x0b.🙂"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(texts):
    import pyarrow as pa

    own = Words(pa.array(texts, pa.string()))
    hashes, bounds = own.shingles()
    seen = {}
    for k, (text, found) in enumerate(zip(texts, sorted_sets(hashes, bounds), strict=True)):
        words = text.encode().lower().split()
        assert own.bounds[k + 1] - own.bounds[k] == len(words) and len(found) == len(sets_of(text))
        assert seen.setdefault(frozenset(sets_of(text)), tuple(found)) == tuple(found)


def test_jaccard_groups(spark, documents):
    own = dict(DOCS)
    shingles = {i: sets_of(t) for i, t in own.items()}
    links = [(a, b) for a in own for b in own if a < b and shingles[a] and shingles[b] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    want = groups_of(links, own)
    got = {r.doc_id: r for r in jaccard.groups(documents).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in shingles.items()}
    kept = {r.doc_id for r in jaccard.one_of_each(documents).collect()}
    assert kept == {i for i in own if want[i] == i}


def test_jaccard_odd_rows(spark):
    rows = spark.createDataFrame([(1, BASE), (1, BASE), (None, BASE), (2, BASE + " more"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(rows).collect()), key=repr)
    n = len(sets_of(BASE))
    assert got == sorted([(1, n, 1), (1, n, 1), (2, n + 1, 1), (None, n, None), (None, 0, None)], key=repr)
    assert sorted((r.doc_id is None, r.doc_id) for r in jaccard.one_of_each(rows).collect()) == [(False, 1), (True, None), (True, None)]
    assert jaccard.groups(rows.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(20)] + [(0, i) for i in range(400, 500)]
    frame = spark.createDataFrame([*links, (None, 1), (7, None)], "u bigint, v bigint")
    real = [(a, b) for a, b in links if a != b]
    want = groups_of(real, {x for pair in real for x in pair})
    assert {x.node: x.component for x in C.components(frame).collect()} == want
    assert C.components(frame.limit(0)).count() == 0


LINES = [
    (1, "Alpha beta gamma delta\n" + prose(50, 60) + "\nshort"), (2, "alpha, beta; gamma: delta!\nother line here\n\nshort"), (3, edited(prose(50, 60), 1, 1) + "\nfresh words only here"),
    (4, None), (5, ""), (6, "\n\n"), (None, "Alpha beta gamma delta\nunique line of null"), (7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (8, "12 34\n12 34\none two\none two"),
]


def test_line_dedup(spark):
    rows = spark.createDataFrame([(i, t, 9, "z") for i, t in LINES], "doc_id bigint, text string, n_chars int, place string")
    out = sorted(((r.doc_id is None, r.doc_id, r.text, r.n_chars) for r in lines.dedup(rows).collect()), key=repr)
    texts = {(n, d): t for n, d, t, _ in out}
    assert texts[False, 1] == LINES[0][1] and texts[False, 2] == "other line here\n\nshort" and texts[True, None] == "unique line of null"
    assert (False, 7) not in texts and texts[False, 8] == "12 34\n12 34\none two" and texts[False, 4] is None and texts[False, 5] == "" and texts[False, 6] == "\n\n"
    assert next(n for null, d, _, n in out if d == 2) == len("other line here\n\nshort") and next(n for null, d, _, n in out if d == 1) == 9
    assert lines.dedup(rows.limit(0)).count() == 0


def test_line_groups_by_brute_force(spark):
    """Against edit similarity alone: lines of 12 to 60 words, some of whose words are changed."""
    r, texts = random.Random(3), []
    base = [prose(400 + k, 12 + 6 * k) for k in range(9)]
    for k in range(36):
        one = base[k % 9]
        texts.append((k, "\n".join([one, edited(one, k, 1 + r.randrange(1 + len(one.split()) // 20)), prose(500 + k, 30)])))
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    by_line = {(x.doc_id, x.place): x.line for x in lines.lines_of(rows).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    forms = sorted(set(by_line.values()))
    links = [(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if 10 * abs(len(a) - len(b)) <= 2 * max(len(a), len(b)) and 10 * distance(a, b) <= 2 * max(len(a), len(b))]
    want, size = groups_of(links, forms), {}
    for place, line in by_line.items():
        size.setdefault(want[line], []).append(place)
    expected = {p: p == min(own) for own in size.values() if len(own) > 1 for p in own}
    got = {(x.doc_id, x.place): (x.group_id, x.kept) for x in lines.occurrences(rows).collect()}
    assert set(got) <= set(expected)
    right = sum(got.get(p, (0, None))[1] == kept for p, kept in expected.items())
    assert right >= 0.97 * len(expected)
    assert len({g for g, _ in got.values()}) == sum(k for _, k in got.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def enough_alike(a, b):
    """Whether lines (arrays of words) are links that must be found: by words, or by characters with half of the words shared."""
    m, n = len(" ".join(a)), len(" ".join(b))
    if max(m, n) > 128:
        return 5 * distance(a, b) <= max(len(a), len(b))
    common = sum((Counter(a) & Counter(b)).values())
    return 2 * common >= max(len(a), len(b)) and 5 * abs(m - n) <= max(m, n) and 5 * distance(" ".join(a), " ".join(b)) <= max(m, n)


def test_no_link_between_lines_that_share_enough_words_is_lost(spark):
    """All of them: lines of two words and more, words that repeat, typing errors, words replaced, moved in and left out."""
    r, forms = random.Random(11), []
    for k in range(160):
        own = [r.choice(WORDS) for _ in range(2 + k % 40)]
        for _ in range(3):
            new = list(own)
            for _ in range(1 + len(own) // r.choice([4, 6, 12])):
                at = r.randrange(len(new))
                kind = r.randrange(4)
                if kind == 0:
                    new[at] = new[at][:-1] + r.choice("aeioxyz")
                elif kind == 1:
                    new[at] = r.choice(WORDS)
                elif kind == 2:
                    new.insert(at, r.choice(WORDS))
                elif len(new) > 2:
                    del new[at]
            forms.append(new)
        forms.append(own)
    # frequent words have another way to meet: make all of these frequent
    forms += [[w, "number", *("i" * (1 + k % 7) + "v" * (k // 7)).split()] for w in WORDS for k in range(2)]
    forms = sorted({tuple(f) for f in forms})
    rows = spark.createDataFrame([(i, " ".join(f)) for i, f in enumerate(forms)], "doc_id bigint, text string")
    links = [(i, j) for i in range(len(forms)) for j in range(i) if enough_alike(forms[i], forms[j])]
    got = {x.doc_id: x.group_id for x in lines.occurrences(rows).collect()}
    assert len(links) > 300 and not [(forms[i], forms[j]) for i, j in links if i not in got or got[i] != got.get(j)]


def test_tokens_meet_whatever_is_frequent():
    """Any two lines that share enough words share a token, whether none, some or all words are listed as frequent."""
    import numpy as np
    import pyarrow as pa

    r, forms = random.Random(12), []
    for k in range(60):
        own = [r.choice(WORDS) + r.choice(["", "a", "b"]) for _ in range(r.choice([2, 3, 5, 9, 30, 70]) if k else 480)]
        forms += [" ".join(own), *(" ".join(edited(" ".join(own), k * 9 + e, max(1, len(own) // 6)).split(" ") + own[: len(own) // 9]) for e in range(3))]
    forms = sorted(set(forms))
    texts, split = pa.array(forms), [f.split(" ") for f in forms]
    words, many = prefixes.counts(texts)
    for least in (0, 6, 20, 10**9):
        listed = words[many > least]
        rank = np.argsort(np.argsort(many[many > least], kind="stable")) + 1
        held = [set() for _ in forms]
        for row, token in prefixes.tokens(texts, np.array([len(f) for f in forms]), listed, rank, Fraction("0.8")):
            for i, t in zip(row.tolist(), token.tolist(), strict=True):
                held[i].add(t)
        seen = 0
        for i, a in enumerate(split):
            for j, b in enumerate(split[:i]):
                longer, common = max(len(a), len(b)), sum((Counter(a) & Counter(b)).values())
                if common >= ((longer + 1) // 2 if max(len(forms[i]), len(forms[j])) <= 128 else longer - longer // 5):
                    seen += 1
                    assert held[i] & held[j], (forms[i], forms[j])
        assert seen > 50


def test_dedup_lines_with_clashing_names(spark):
    names = ("gone_places", "places", "row", "own", "key", "rest", "doc_id_", "print")
    rows = spark.createDataFrame([(1, "one two three four\nlast line", *names), (2, "other words here\nOne, two; three four", *names)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = {x.doc_id: x for x in lines.dedup(rows).collect()}
    assert got[2].text == "other words here" and got[1].text == "one two three four\nlast line" and tuple(got[2])[2:] == names
    assert lines.dedup(rows).columns == rows.columns


def test_long_and_repeated_lines(spark):
    long = prose(77, 15000)
    rows = spark.createDataFrame([(1, long), (1, long), (2, edited(long, 1, 3)), (None, long), (3, "x " * 15000)], "doc_id bigint, text string")
    got = sorted(((x.doc_id or 0, x.kept) for x in lines.occurrences(rows).collect()), key=repr)
    assert got == [(0, False), (1, True), (1, True), (2, False)]


def test_edit_distance_of_words(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(300):
        own = [r.choice(["a", "bb", "cab", "d"]) for _ in range(r.randrange(1, 8))]
        other = list(own)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(other) + 1)
            other[k : k + r.randrange(2)] = [r.choice(["a", "bb", "x"])] * r.randrange(2)
        pairs.append((" ".join(own), " ".join(other) or "a"))
    rows = spark.createDataFrame(pairs, "a string, b string")
    for row in rows.select("a", "b", lines.edit_distance(F.split("a", " "), F.split("b", " ")).alias("x"), F.levenshtein("a", "b").alias("y")).collect():
        assert row.x == row.y, row


def test_passages(spark, documents):
    found = substring.passages(documents).collect()
    pairs = {(r.doc_id, r.source_doc_id): r for r in found}
    # exact repeats are met for sure; documents that share a passage with edits mostly
    assert {d for d, _ in pairs} >= {*range(5, 40, 5), *range(41, 45), 91} and not {d for d, _ in pairs} & set(range(50, 77))
    assert len({d for d, _ in pairs} & set(range(1, 40))) > 20
    own = pairs[91, 90]
    assert 60 <= own.n_words <= 64 and own.first_word in range(41, 46) and own.source_first_word in range(26, 31)
    for r in found:
        assert r.similarity >= 0.8 and r.n_words >= 50 and r.source_doc_id < r.doc_id
    assert substring.passages(documents.limit(0)).count() == 0


@given(st.lists(st.integers(0, 6), min_size=1, max_size=30), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_compact_windows_are_those_of_the_cartesian_tree(tokens, least):
    import numpy as np

    own = np.array(tokens, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    value, text, c, left, right = substring.compact_windows(own, np.array([0, len(own)]), 3, least)
    full, _, every, _, _ = substring.compact_windows(own, np.array([0, len(own)]), 3, 1)
    order = [(int(v) >> len(own).bit_length(), k) for k, v in zip(every, full, strict=True)]
    rank = {int(k): o for o, k in order}
    want = set()
    for k in range(len(own)):
        a = b = k
        while a and (rank[a - 1], a - 1) > (rank[k], k):
            a -= 1
        while b < len(own) - 1 and (rank[b + 1], b + 1) > (rank[k], k):
            b += 1
        if b - a + 1 >= least:
            want.add((a, k, b))
    assert {(int(a), int(k), int(b)) for a, k, b in zip(left, c, right, strict=True)} == want


def test_licenses(spark):
    long = prose(9, 300)
    header = licenses.TEMPLATES["mit-header"]
    rows = [(1, long + "\nReleased under the MIT License.\n" + long), (2, "licensed UNDER the apache license version 2 0"), (3, long), (4, None), (5, ""), (6, f"{long} {header} {long}"),
            (7, long + " " + " ".join(header.split()[:14])), (None, "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License.")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string"), licenses.default_templates(spark)).collect()}
    assert set(got) == {(1, "mit"), (2, "apache-2.0"), (6, "mit-header"), (None, "cc-by-nc-4.0")}
    assert got[6, "mit-header"].containment == 1.0 and got[6, "mit-header"].first_word == 300 and got[2, "apache-2.0"].first_word == 0
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string"), licenses.default_templates(spark)).count() == 0
