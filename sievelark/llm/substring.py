"""Substring dedup: near-duplicate passages by compact windows of token min-hashes.

After Peng et al., "Near-duplicate sequence search at scale for large language model memorization evaluation"
(SIGMOD 2023). A text's tokens are its word shingles (five words); a passage of `words` words has `words - 4`. For each of `hashes` hash
functions, the Cartesian tree over the tokens' hash values has a node c for every token, spanning [l, r], where c has the least value: all
subsequences within [l, r] that hold c share the min-hash value of c. This triple is a compact window; one stands for up to (c-l+1)(r-c+1)
subsequences. Those spanning fewer tokens than a passage are left out (about 2 in 46 remain).

1. One pass makes the windows: nodes that span enough are exactly the minima of sliding windows of a passage's length, found by
   numpy; the tree over them gives l and r. Windows go to buckets by min-hash value, packed in binary columns.
2. Exact repeats. Equal subsequences have equal min-hashes, so two of them meet at the value of the first function. A window of that function
   carries a digest of each passage-long subsequence that it stands for. Where a value's digests are equal, the lowest document is the source of the others.
   No representative is chosen before digests are compared: **every repeat of `words` words is found**, whatever else holds the value.
3. Edited repeats. Windows of all functions also carry `hints`: min-hashes, by two other functions, of the half passage before c and of the one after it (a passage
   that holds c has one of the two whole). Windows that agree in value and in a hint share two hashes there: within such a class, each meets the lowest document's and
   the one it sorts next to by the remaining hints. Windows whose subsequences are all equal count once, so copies cost nothing here.
   This makes up to eight pairs a window, whatever the size of the class; it is a search by representatives, not all pairs.
4. Interval joins: windows of a pair of documents with like alignment, and exact repeats along it, are joined where they overlap. Stretches that exact repeats
   cover are done. The others are verified on the shingles themselves: matching stretches (gaps of up to `gap` tokens) of `words` words or more whose shingle
   sets have a Jaccard similarity of `similarity` or more; a stretch that falls short is cut at its widest gap and its parts are tried.
   A document's longest stretches are verified first, then those of other partners where nothing was found.

Values that more than `HOT` windows have (a frequent line's) would fill a bucket. A first pass counts them; at most `MOST_HOT` of them (8 MB) are broadcast. Their
digests go out by digest and their windows by value and hint, so no bucket gathers a hot value; and within a task, equal subsequences are resolved
before they are sent.

Defined cases: null and empty texts and those of under `words` words have no passages; null doc_ids take no part; rows sharing a doc_id are one document (no passage
repeats within it); repeats within one document are not looked for; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, release
from .sketch import among
from .words import Digests, Words, mix, text_slices

#: Starts of passages that a task gathers before it sends them.
FLUSH = 500_000
#: A min-hash value of more windows than this is hot; of these, so many at most are told to all tasks (64 bits each).
HOT, MOST_HOT = 1024, 1_000_000
#: Low bits of a value that tell its hash function.
_FUNCTION = np.uint64(255)
_CAP = 255
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    words: int = 50
    hashes: int = 4
    similarity: float = 0.8
    gap: int = 12

    @property
    def tokens(self) -> int:
        return self.words - 4

    @property
    def half(self) -> int:
        """Tokens before or after any token of a passage, on one side at least."""
        return self.tokens // 2


def window_minima(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values, in a few passes whatever the width (van Herk 1992)."""
    n = len(value)
    if n < width:
        return np.zeros(0, value.dtype)
    full = np.full(-(-n // width) * width, np.iinfo(value.dtype).max, value.dtype)
    full[:n] = value
    block = full.reshape(-1, width)
    before = np.minimum.accumulate(block, axis=1).reshape(-1)
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


class Tokens:
    """The tokens of some texts under the hash functions; text k's are in bounds[k]:bounds[k+1]."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray):
        self.tokens, self.bounds = tokens, bounds
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self._low = np.uint64((1 << max(1, len(tokens).bit_length())) - 1)

    def values(self, function: int) -> np.ndarray:
        return mix(self.tokens ^ mix(np.array([function + 1], np.uint64))[0])

    def starts(self, width: int) -> np.ndarray:
        """Places where runs of `width` tokens of one text begin."""
        n = len(self.tokens) - width + 1
        return np.flatnonzero(self.text[:n] == self.text[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def least(self, values: np.ndarray, width: int) -> np.ndarray:
        """Where the least value of each run of `width` tokens is (the first of equal ones), whatever the texts."""
        order = (values & ~self._low) | np.arange(len(values), dtype=np.uint64)
        return (window_minima(order, width) & self._low).astype(np.int64)


def compact_windows(tokens: np.ndarray, bounds: np.ndarray, function: int, least: int) -> tuple[np.ndarray, ...]:
    """value, text, c, l, r of all compact windows of `least` tokens or more; tokens of several texts, text k in bounds[k]:bounds[k+1]."""
    own = Tokens(tokens, bounds)
    value, starts = own.values(function), own.starts(least)
    place = own.least(value, least)[starts]
    at = place[np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))] if len(place) else place
    left, right = spans(own, value, at)
    text = own.text[at]
    begin = bounds[text]
    return value[at], text, at - begin, left - begin, right - begin


def spans(own: Tokens, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the Cartesian tree's nodes at the places `at` span, first and last place: one pass with a stack."""
    order = ((value & ~own._low) | np.arange(len(value), dtype=np.uint64))[at].tolist()
    owner, positions = own.text[at].tolist(), at.tolist()
    first, last = own.bounds[:-1].tolist(), (own.bounds[1:] - 1).tolist()
    left, right = [0] * len(at), [0] * len(at)
    stack: list[int] = []
    for k in range(len(at)):
        if stack and owner[stack[-1]] != owner[k]:
            for s in stack:
                right[s] = last[owner[s]]
            stack.clear()
        while stack and order[stack[-1]] > order[k]:
            right[stack.pop()] = positions[k] - 1
        left[k] = positions[stack[-1]] + 1 if stack else first[owner[k]]
        stack.append(k)
    for s in stack:
        right[s] = last[owner[s]]
    return np.array(left, np.int64), np.array(right, np.int64)


def pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Columns of whole numbers by byte planes, highest first: the low `widths` bytes of each."""
    return b"".join(c.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)[:, :w][:, ::-1].T.tobytes() for c, w in zip(columns, widths, strict=True))


def unpack(blobs: pa.ChunkedArray, widths: list[int]) -> list[np.ndarray]:
    """The columns of all blobs, end to end."""
    parts: list[list[np.ndarray]] = [[] for _ in widths]
    for blob in blobs.to_pylist():
        if blob:
            plane = np.frombuffer(blob, np.uint8).reshape(sum(widths), -1)
            at = 0
            for column, w in zip(parts, widths, strict=True):
                own = np.zeros((plane.shape[1], 8), np.uint8)
                own[:, :w] = plane[at : at + w][::-1].T
                column.append(own.view(np.uint64).reshape(-1))
                at += w
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def lowest(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose key a lower document has too, and that document's first row of the key."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    several = np.zeros(len(key), bool)
    several[1:] |= same
    several[:-1] |= same
    some = order[several]
    some = some[np.lexsort((place[some], doc[some], key[some]))]
    first = np.maximum.accumulate(np.where(changes(key[some]), np.arange(len(some)), 0)) if len(some) else some
    other = doc[some] != doc[some[first]] if len(some) else np.zeros(0, bool)
    return some[other], some[first[other]]


def alignments(doc: np.ndarray, a: np.ndarray, source: np.ndarray, sa: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """doc, a, n, source, sa of the longest runs in which place a of doc equals place sa of its source."""
    size = np.ones(len(a), np.int64) if size is None else size
    order = np.lexsort((a, a - sa, source, doc))
    doc, a, source, sa, size = (x[order] for x in (doc, a, source, sa, size))
    new = changes(doc, source, a - sa)
    # within an alignment, runs sorted by beginning join while they touch; lifted by their number, alignments stay apart
    lift = np.cumsum(new) * (int(a.max(initial=0) + size.max(initial=0)) + 2)
    reach = np.maximum.accumulate(lift + a + size) if len(a) else a
    new[1:] |= lift[1:] + a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    end = (reach - lift)[np.append(first[1:], len(a)) - 1] if len(a) else a
    return doc[first], a[first], end - a[first], source[first], sa[first]


_RUN, _NEAR, _KNOWN, _PAIR = [7, 8, 4, 1], [7, 8, 4, 1, 1, 4, 2, 2, 2, 2], [8, 4, 3, 8, 4], [8, 8, 4, 1, 1, 4, 1, 1]
_DIGEST = [6]


def _windows(own: Tokens, settings: Settings):
    """For each function its windows (value, c, l, r and the first and last start of a passage around c), its hints, and all starts."""
    width, half = settings.tokens, settings.half
    values = [own.values(j) for j in range(settings.hashes)]
    starts = own.starts(width)
    hints = []
    for v in values:
        low = own.least(v, half) if len(v) >= half else np.zeros(0, np.int64)
        hints.append(np.maximum(mix(v[low]) >> np.uint64(48), np.uint64(1)))
    for j, v in enumerate(values):
        place = own.least(v, width)[starts]
        new = np.flatnonzero(changes(place)) if len(place) else place
        at, first, last = place[new], starts[new], starts[np.append(new[1:], len(place)) - 1] if len(place) else new
        left, right = spans(own, v, at)
        begin, end = own.bounds[own.text[at]], own.bounds[own.text[at] + 1]
        told = []
        for f in ((j + 1) % settings.hashes, (j + 2) % settings.hashes):
            for to in (at + 1, at - half):  # the half after, the half before; 0 where the text has none
                fine = (to >= begin) & (to + half <= end)
                told.append(np.where(fine, hints[f][np.where(fine, to, 0)] if len(hints[f]) else 0, 0).astype(np.uint64))
        yield (v[at] & ~_FUNCTION) | np.uint64(j), at, left, right, first, last, told, starts


def _known(value: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which values are among the sorted `hot` ones."""
    if not len(hot):
        return np.zeros(len(value), bool)
    return hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value


def _sent(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[np.ndarray, Tokens]]:
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
        for first, part in text_slices(batch["text"]):
            tokens, bounds = Words(part).shingles()
            if len(bounds) > 1 and np.diff(bounds).max() >= settings.tokens:
                yield ids[first : first + len(part)], Tokens(tokens, bounds)


def _frequent(settings: Settings):
    """Values that come several times in a task's windows, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], ["value", "n"])

        for _, own in _sent(batches, settings):
            held += [w[0] for w in _windows(own, settings)]
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def hot_values(texts: DataFrame, settings: Settings) -> np.ndarray:
    """The most frequent min-hash values of more than HOT windows, sorted; MOST_HOT at most."""
    counts = texts.mapInArrow(_frequent(settings), "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    table = counts.orderBy(F.desc("n"), "value").limit(MOST_HOT).select("value").toArrow()
    return np.sort(table["value"].to_numpy().view(np.uint64))


def _send(buckets: int, settings: Settings, hot_list):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: np.ndarray = hot_list.value
        exact: list[tuple[np.ndarray, ...]] = []
        near: list[tuple[np.ndarray, ...]] = []
        count = 0

        def dealt(home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            home = (home >> shift).astype(np.int64)
            order = np.argsort(home, kind="stable")
            return order, np.searchsorted(home[order], np.arange(buckets + 1))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            digest, value, doc, a, window = (np.concatenate(x) for x in zip(*exact, strict=True))
            over, of = lowest(digest, doc, a)
            known = alignments(doc[over], a[over], doc[of], a[of])
            open_ = np.ones(len(digest), bool)
            open_[over] = False
            rest = np.flatnonzero(open_)
            single = _known(value[rest], hot)
            alone, rest = rest[single], rest[~single]
            first = rest[changes(window[rest], rest - np.arange(len(rest)))] if len(rest) else rest
            size = np.diff(np.append(np.searchsorted(rest, first), len(rest)))
            runs = [np.concatenate([mix(value[first]), mix(digest[alone])]) >> np.uint64(8), doc[np.append(first, alone)], a[np.append(first, alone)], np.append(size, np.ones(len(alone), np.int64))]
            order, ends = dealt(runs[0] << np.uint64(8))
            runs = [c[order] for c in runs]
            at = np.concatenate([[0], np.cumsum(np.append(size, np.ones(len(alone), np.int64)))])[:-1][order]
            places = np.repeat(at - (np.cumsum(runs[3]) - runs[3]), runs[3]) + np.arange(int(runs[3].sum()))
            digests = digest[np.append(rest, alone)][places] >> np.uint64(16)
            of_run = np.concatenate([[0], np.cumsum(runs[3])])

            key, doc, c, left, right, span, *told = (np.concatenate(x) for x in zip(*near, strict=True))
            drop, _ = lowest(mix(key ^ (span * _STEP)), doc, c)
            open_ = np.ones(len(key), bool)
            open_[drop] = False
            frequent = _known(key, hot) & open_
            columns = [[x[open_ & ~frequent] for x in (mix(key), doc, c, left, right, span, *told)]]
            for k, hint in enumerate(told):
                some = frequent & (hint > 0)
                columns.append([mix(key + hint * _STEP + np.uint64(k + 1))[some], *(x[some] for x in (doc, c, left, right, span, *told))])
            nears = [np.concatenate(x) for x in zip(*columns, strict=True)]
            nears[0] = nears[0] >> np.uint64(8)
            order, near_ends = dealt(nears[0] << np.uint64(8))
            nears = [x[order] for x in nears]

            order, known_ends = dealt(mix(known[0].view(np.uint64)))
            known = [x[order] for x in known]
            some = np.flatnonzero((np.diff(ends) > 0) | (np.diff(near_ends) > 0) | (np.diff(known_ends) > 0))
            for k in range(0, len(some), 64):
                own = some[k : k + 64].tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int32()),
                    pa.array([pack([x[ends[b] : ends[b + 1]] for x in runs], _RUN) for b in own], pa.binary()),
                    pa.array([pack([digests[of_run[ends[b]] : of_run[ends[b + 1]]]], _DIGEST) for b in own], pa.binary()),
                    pa.array([pack([x[near_ends[b] : near_ends[b + 1]] for x in nears], _NEAR) for b in own], pa.binary()),
                    pa.array([pack([x[known_ends[b] : known_ends[b + 1]] for x in known], _KNOWN) for b in own], pa.binary()),
                ], ["bucket", "runs", "digests", "near", "known"])
            exact.clear()
            near.clear()
            count = 0

        for ids, own in _sent(batches, settings):
            digests, begin = Digests(own.tokens), own.bounds[own.text]
            for j, (key, at, left, right, first, last, told, starts) in enumerate(_windows(own, settings)):
                doc = ids[own.text[at]]
                if not j:
                    window = np.repeat(np.arange(len(at)), np.diff(np.append(np.searchsorted(starts, first), len(starts)))) + count
                    exact.append((digests.of(starts, starts + settings.tokens), key[window - count], ids[own.text[starts]], starts - begin[starts], window))
                span = digests.of(first, last + settings.tokens) >> np.uint64(32)
                near.append((key, doc, at - begin[at], np.minimum(at - left, _CAP), np.minimum(right - at, _CAP), span, *told))
            count += len(starts)
            if count >= FLUSH:
                yield from flush()
        if count:
            yield from flush()

    return run


def _signed(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c.view(np.int64) for c in columns]


def _meet(groups: int, settings: Settings):
    """What a bucket finds: alignments of exact repeats, and pairs of windows that agree in value and hint; by the later document."""

    def run(table: pa.Table) -> pa.Table:
        key, doc, a, size = unpack(table["runs"], _RUN)
        (digest,) = unpack(table["digests"], _DIGEST)
        doc, a, size = _signed([doc, a, size])
        whole = np.repeat(key, size) ^ mix(digest)
        places = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(len(digest))
        docs = np.repeat(doc, size)
        over, of = lowest(whole, docs, places)
        known = _signed(unpack(table["known"], _KNOWN))
        found = alignments(*(np.concatenate(x) for x in zip((docs[over], places[over], docs[of], places[of]), (known[0], known[1], known[3], known[4]), strict=True)), np.concatenate([np.ones(len(over), np.int64), known[2]]))
        del whole, places, docs, digest

        key, doc, c, left, right, span, *told = unpack(table["near"], _NEAR)
        doc, c, left, right = _signed([doc, c, left, right])
        drop, _ = lowest(mix(key ^ (span * _STEP)), doc, c)
        open_ = np.ones(len(key), bool)
        open_[drop] = False
        key, doc, c, left, right, *told = (x[open_] for x in (key, doc, c, left, right, *told))
        pairs = [np.zeros((2, 0), np.int64)]
        for k in range(len(told)):
            some = np.flatnonzero(told[k])
            order = some[np.lexsort((c[some], doc[some], *(told[(k + i) % len(told)][some] for i in (3, 2, 1)), told[k][some], key[some]))]
            new = changes(key[order], told[k][order]) if len(order) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            least = order[np.lexsort((doc[order], group))][begin] if len(order) else order
            pairs.append(np.stack([order, least[group]]))
            pairs.append(np.stack([order[1:], order[:-1]])[:, ~new[1:]])
        one, two = np.concatenate(pairs, axis=1)
        swap = doc[one] < doc[two]
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        fits = (doc[one] != doc[two]) & (np.minimum(left[one], left[two]) + np.minimum(right[one], right[two]) + 1 >= settings.tokens - settings.gap)
        own = np.unique(one[fits] * len(doc) + two[fits])
        one, two = own // max(1, len(doc)), own % max(1, len(doc))
        pair = [doc[one], doc[two], c[one], left[one], right[one], c[two], left[two], right[two]]

        def dealt(columns, widths):
            home = (mix(columns[0].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[order], np.arange(groups + 1))
            return [x[order] for x in columns], ends, widths

        sides = [dealt(list(found), _KNOWN), dealt(pair, _PAIR)]
        some = np.flatnonzero(np.diff(sides[0][1]) + np.diff(sides[1][1]))
        blobs = [pa.array([pack([x[ends[g] : ends[g + 1]] for x in columns], widths) for g in some], pa.binary()) for columns, ends, widths in sides]
        return pa.table([pa.array(some, pa.int32()), *blobs], names=["grp", "found", "pairs"])

    return run


class Cover:
    """A set of places as intervals that neither touch nor overlap."""

    def __init__(self):
        self.first: list[int] = []
        self.last: list[int] = []

    def holds(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.first, a) - 1
        return k >= 0 and self.last[k] >= b

    def add(self, a: int, b: int) -> None:
        low, high = bisect.bisect_left(self.last, a - 1), bisect.bisect_right(self.first, b + 1)
        if low < high:
            a, b = min(a, self.first[low]), max(b, self.last[high - 1])
        self.first[low:high], self.last[low:high] = [a], [b]

    def missing(self, a: int, b: int) -> int:
        """How many places of [a, b] it doesn't hold."""
        own = range(bisect.bisect_left(self.last, a), bisect.bisect_right(self.first, b))
        return b - a + 1 - sum(min(b, self.last[k]) - max(a, self.first[k]) + 1 for k in own)

    @classmethod
    def of(cls, other: Cover | None) -> Cover:
        out = cls()
        if other:
            out.first, out.last = list(other.first), list(other.last)
        return out


#: A stretch [a, b] of doc's tokens and one [oa, ob] of other's.
_STRETCH = ("doc", "a", "b", "other", "oa", "ob")
_OUT = "doc_id bigint, first_word bigint, n_words bigint, source_doc_id bigint, source_first_word bigint, source_n_words bigint, similarity double"


def _assemble(settings: Settings):
    """Documents' exact repeats (turn 0) and candidate stretches, those to verify first (1) and those only if nothing is found there (2)."""
    width = settings.tokens

    def run(table: pa.Table) -> pa.Table:
        exact = alignments(*(lambda d, a, n, s, sa: (d, a, s, sa, n))(*_signed(unpack(table["found"], _KNOWN))))
        doc, other, c, left, right, oc, oleft, oright = _signed(unpack(table["pairs"], _PAIR))
        begin = np.concatenate([exact[1], c - np.minimum(left, oleft)])
        end = np.concatenate([exact[1] + exact[2] - 1 + width - 1, c + np.minimum(right, oright)])
        shift = np.concatenate([exact[1] - exact[4], c - oc])
        near = np.concatenate([np.zeros(len(exact[0]), bool), np.ones(len(doc), bool)])
        doc, other = np.concatenate([exact[0], doc]), np.concatenate([exact[3], other])
        order = np.lexsort((shift, other, doc))
        doc, other, begin, end, shift, near = (x[order] for x in (doc, other, begin, end, shift, near))
        apart = changes(doc, other)
        apart[1:] |= shift[1:] - shift[:-1] > settings.gap
        group = np.cumsum(apart)
        order = np.lexsort((begin, group))
        doc, other, begin, end, shift, near, group = (x[order] for x in (doc, other, begin, end, shift, near, group))
        lift = group * (int(end.max(initial=0)) + width + 2)
        reach = np.maximum.accumulate(lift + end) if len(end) else end
        new = changes(group)
        new[1:] |= lift[1:] + begin[1:] > reach[:-1] + settings.gap
        first = np.flatnonzero(new)
        rows = [(0, *r) for r in zip(*(x.tolist() for x in (exact[0], exact[1], exact[1] + exact[2] + width - 2, exact[3], exact[4], exact[4] + exact[2] + width - 2)), strict=True)]
        if len(first):
            x, y = begin[first], (reach - lift)[np.append(first[1:], len(end)) - 1]
            low, high = np.minimum.reduceat(shift, first), np.maximum.reduceat(shift, first)
            some = np.flatnonzero(np.logical_or.reduceat(near, first) & (y - x + 1 >= width - settings.gap))
            some = some[np.argsort(x[some] - y[some], kind="stable")]
            done: dict[int, Cover] = {}
            for _, d, p, q, *_ in rows:
                done.setdefault(d, Cover()).add(p, q)
            chosen: dict[int, Cover] = {}
            for d, p, q, o, lo, hi in zip(*(e[some].tolist() for e in (doc[first], x, y, other[first], low, high)), strict=True):
                if d in done and done[d].holds(p, q):
                    continue
                if d not in chosen:
                    chosen[d] = Cover.of(done.get(d))
                rows.append((2 if chosen[d].holds(p, q) else 1, d, p, q, o, p - hi, q - lo))
                chosen[d].add(p, q)
        columns = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 7
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["turn", *_STRETCH])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the asked stretches of each text, 32 bits each, and where they begin."""
    schema = pa.schema([*((n, pa.int64()) for n in _STRETCH), ("at", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for first, part in text_slices(batch["text"]):
            tokens, bounds = Words(part).shingles()
            short, rows = (tokens >> np.uint64(32)).astype(np.uint32), []
            for k, asks in enumerate(batch["asks"].slice(first, len(part)).to_pylist()):
                for ask in asks:
                    x, y = min(bounds[k] + max(0, ask["x"]), bounds[k + 1]), min(bounds[k] + ask["y"] + 1, bounds[k + 1])
                    rows.append(ask["stretch"] | {"at": int(x - bounds[k]), "shingles": short[x:y].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)


def segments(one: np.ndarray, two: np.ndarray, at_once: int = 1 << 22, low: int | None = None, high: int | None = None) -> np.ndarray:
    """Rows (begin, begin in two, length) of all longest stretches that are equal place by place, sorted; every occurrence of a shingle counts.

    low, high: only alignments (place in one less place in two) between these. Pairs of equal places are made for `at_once` of them at a time; only where a
    stretch begins or ends is kept.
    """
    low, high = -len(two) if low is None else low, len(one) if high is None else high
    rank = np.unique(np.concatenate([one, two]), return_inverse=True)[1].astype(np.int64) * (len(two) + 1)
    place = np.arange(len(one))
    key = np.sort(rank[len(one) :] + np.arange(len(two)))
    of = lambda j: np.searchsorted(key, rank[: len(one)] + np.clip(j, 0, len(two)), "left")
    begin, count = of(place - high), of(place - low + 1)
    count = np.maximum(count - begin, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    begins, ends, k = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)], 0
    while k < len(one):
        stop = max(k + 1, int(np.searchsorted(total, total[k] + at_once, "right")) - 1)
        i = np.repeat(place[k:stop], count[k:stop])
        at = np.arange(len(i)) - np.repeat(total[k:stop] - total[k], count[k:stop]) + np.repeat(begin[k:stop], count[k:stop])
        j = key[at] % (len(two) + 1)
        head = (i == 0) | (j == 0) | (one[i - 1] != two[j - 1])
        tail = (i == len(one) - 1) | (j == len(two) - 1) | (one[np.minimum(i + 1, len(one) - 1)] != two[np.minimum(j + 1, len(two) - 1)])
        begins.append(np.stack([i[head], j[head]]))
        ends.append(np.stack([i[tail], j[tail]]))
        k = stop
    (i, j), (x, y) = np.concatenate(begins, axis=1), np.concatenate(ends, axis=1)
    # on a diagonal, beginnings and ends alternate
    first, last = np.lexsort((i, i - j)), np.lexsort((x, x - y))
    i, j, size = i[first], j[first], x[last] - i[first] + 1
    by = np.lexsort((j, i))
    return np.stack([i[by], j[by], size[by]], axis=1)


def chains(parts: np.ndarray, gap: int) -> list[list[int]]:
    """Numbers of segments that follow each other with gaps and shifts of up to `gap`, those that cover most first; each segment in one chain."""
    begin, size, shift = parts[:, 0].tolist(), parts[:, 2].tolist(), (parts[:, 0] - parts[:, 1]).tolist()
    cover, before, last = list(size), [-1] * len(begin), {}
    for s in range(len(begin)):
        end = begin[s] + size[s] - 1
        for d in range(shift[s] - gap, shift[s] + gap + 1):
            p = last.get(d)
            if p is None:
                continue
            till = begin[p] + size[p] - 1
            if begin[p] < begin[s] and till < end and begin[s] - till <= gap and cover[p] + end - max(till, begin[s] - 1) > cover[s]:
                cover[s], before[s] = cover[p] + end - max(till, begin[s] - 1), p
        last[shift[s]] = s
    used, out = [False] * len(begin), []
    for s in sorted(range(len(begin)), key=lambda s: (-cover[s], s)):
        own = []
        while s >= 0 and not used[s]:
            used[s] = True
            own.append(s)
            s = before[s]
        if own:
            out.append(own[::-1])
    return out


def _long_enough(parts: np.ndarray, settings: Settings) -> np.ndarray:
    """Those segments that a chain of `tokens` places may have: chains stay among diagonals that follow each other within `gap`."""
    shift = parts[:, 0] - parts[:, 1]
    order = np.argsort(shift, kind="stable")
    group = np.zeros(len(parts), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(np.diff(shift[order]) > settings.gap)]) if len(parts) else group
    low, high = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    np.minimum.at(low, group, parts[:, 0])
    np.maximum.at(high, group, parts[:, 0] + parts[:, 2])
    return parts[(high - low)[group] >= settings.tokens]


def matches(one: np.ndarray, two: np.ndarray, settings: Settings, low: int | None = None, high: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """(begin, end, begin in two, end in two, similarity) of like stretches of two shingle sequences, along alignments between low and high.

    Stretches are chains of equal segments along an alignment, whatever else repeats a shingle. A chain that as a whole isn't alike enough is cut at
    its widest gap, and so on. A stretch within one found before, in the first sequence, is not told again.
    """
    if not len(one) or not len(two):
        return []
    parts = _long_enough(segments(one, two, low=low, high=high), settings)
    out: list[tuple[int, int, int, int, float]] = []
    whole = np.flatnonzero(parts[:, 2] == len(one))
    if len(whole):
        parts = parts[whole[:1]]  # all else lies within it
    begin, other, size = parts.T.tolist()
    todo = chains(parts, settings.gap)[::-1]
    while todo:
        own = todo.pop()
        a, b = min(begin[k] for k in own), max(begin[k] + size[k] for k in own) - 1
        x, y = min(other[k] for k in own), max(other[k] + size[k] for k in own) - 1
        if b - a + 1 < settings.tokens or any(c <= a and b <= d for c, d, *_ in out):
            continue
        p, q = np.unique(one[a : b + 1]), np.unique(two[x : y + 1])
        shared = len(np.intersect1d(p, q, assume_unique=True))
        similarity = shared / (len(p) + len(q) - shared)
        if similarity >= settings.similarity:
            out.append((a, b, x, y, similarity))
        elif len(own) > 1:
            gaps = [max(begin[n] - begin[k] - size[k], other[n] - other[k] - size[k]) for k, n in zip(own, own[1:], strict=False)]
            k = gaps.index(max(gaps)) + 1
            todo += [own[k:], own[:k]]
    return out


def _verify(settings: Settings):
    names = ["doc_id", "first_word", "n_words", "source_doc_id", "source_first_word", "source_n_words", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, a, b, other, oa, ob, at, begin, one, two in zip(*(batch[n].to_pylist() for n in (*_STRETCH, "at", "other_at", "shingles", "other_shingles")), strict=True):
                to = at - begin
                for x, y, u, v, s in matches(np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32), settings, b - ob - settings.gap - to, a - oa + settings.gap - to):
                    out.append((doc, at + x, y - x + 5, other, begin + u, v - u + 5, s))
            columns = list(map(list, zip(*out, strict=True))) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64())], names)

    return run


def _uncovered(settings: Settings):
    """Those deferred stretches of which more than `gap` places are in no passage found."""

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        cover: dict[int, Cover] = {}
        for d, a, n in zip(*(found[c].to_pylist() for c in ("doc_id", "first_word", "n_words")), strict=True):
            cover.setdefault(d, Cover()).add(a, a + n - 5)
        keep = [d not in cover or cover[d].missing(a, b) > settings.gap for d, a, b in zip(*(asked[c].to_pylist() for c in ("doc", "a", "b")), strict=True)]
        return asked.filter(pa.array(keep, pa.bool_())).select(list(_STRETCH))

    return run


def _alike(stretches: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Passages found in candidate stretches."""
    stretch = F.struct(*_STRETCH)
    side = lambda owner, x, y: F.struct(F.col(owner).alias("owner"), stretch.alias("stretch"), (F.col(x) - settings.tokens).alias("x"), (F.col(y) + settings.tokens).alias("y"))

    def pieces(owner: str, x: str, y: str) -> DataFrame:
        ask = stretches.select(side(owner, x, y).alias("ask")).select("ask.*")
        # a document that very many others ask for is met in several parts
        parts = ask.groupBy("owner").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts"))
        dealt = ask.join(parts, "owner").withColumn("part", F.pmod(F.xxhash64("stretch"), F.col("parts")))
        asks = cut(dealt.groupBy("owner", "part").agg(F.collect_list(F.struct("stretch", "x", "y")).alias("asks")))
        own = among(texts, "doc_id", asks.select(F.col("owner").alias("doc_id"))).join(asks, F.col("doc_id") == F.col("owner"))
        schema = ", ".join(f"{n} bigint" for n in (*_STRETCH, "at"))
        return own.select("text", "asks").mapInArrow(_asked, f"{schema}, shingles binary")

    other = pieces("other", "oa", "ob").withColumnsRenamed({"at": "other_at", "shingles": "other_shingles"})
    return pieces("doc", "a", "b").join(other, list(_STRETCH)).mapInArrow(_verify(settings), _OUT)


def bucket_count(items: float) -> int:
    """A power of two: buckets of about half a million items, of up to 8 million where there are very many."""
    return 1 << max(6, int(np.ceil(np.log2(max(min(items / 5e5, 8192), items / 8e6, 1)))))


def passages(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, first_word, n_words, source_doc_id, source_first_word, source_n_words, similarity of passages that an earlier document (lower doc_id) has too."""
    spark = documents.sparkSession
    texts = documents.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(size / 6)
    hot = spark.sparkContext.broadcast(hot_values(texts, settings))
    sent = texts.mapInArrow(_send(buckets, settings, hot), "bucket int, runs binary, digests binary, near binary, known binary")
    met = sent.groupBy("bucket").applyInArrow(_meet(buckets // 2, settings), "grp int, found binary, pairs binary")
    found = cut(met.groupBy("grp").applyInArrow(_assemble(settings), "turn int, " + ", ".join(f"{n} bigint" for n in _STRETCH)))
    del sent, met
    release(spark)
    exact = found.where("turn = 0").selectExpr("doc doc_id", "a first_word", "b - a + 5 n_words", "other source_doc_id", "oa source_first_word", "ob - oa + 5 source_n_words", "1.0D similarity")
    near = cut(_alike(found.where("turn = 1"), texts, settings))
    later = found.where("turn = 2")
    if not later.isEmpty():
        part = F.pmod(F.xxhash64("doc_id"), F.lit(buckets // 2)).alias("part")
        told = exact.unionByName(near).select(part, "doc_id", "first_word", "n_words").groupBy("part")
        asked = later.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(buckets // 2))).groupBy("part")
        left = cut(asked.cogroup(told).applyInArrow(_uncovered(settings), ", ".join(f"{n} bigint" for n in _STRETCH)))
        near = near.unionByName(cut(_alike(left, texts, settings)))
    near = near.distinct()
    within = near.select(F.col("doc_id").alias("d"), F.col("source_doc_id").alias("s"), F.col("first_word").alias("x"), F.col("n_words").alias("n"))
    inside = (F.col("doc_id") == F.col("d")) & (F.col("source_doc_id") == F.col("s")) & (F.col("x") <= F.col("first_word")) & (F.col("first_word") + F.col("n_words") <= F.col("x") + F.col("n"))
    return exact.distinct().join(within, inside, "left_anti").unionByName(near)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of any document that one of a lower doc_id repeats."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
