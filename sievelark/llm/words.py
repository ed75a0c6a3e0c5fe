"""Word and shingle hashes over whole Arrow batches, without a Python step per word.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums over the batch and then mixed, so
the cost is a few numpy passes however many words there are. Equal words have equal hashes in
every process; different ones differ but for chance (about 2**-58 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes, unless a single text is longer.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Multipliers for the words of a shingle, by position.
_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True
#: As _space, but all ASCII characters that aren't letters or digits divide words too.
_space_or_sign = np.array([not chr(c).isalnum() if c < 128 else False for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which near values fall far apart."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 8 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def text_slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a string array in slices of about `limit` bytes; null texts come as empty ones."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


class Words:
    """The words of some texts: `doc` (row of the text), `hash`, and `start`, `end` (bytes in `data`); `bounds` are where each text's words begin.

    With `signs_divide`, ASCII punctuation divides words as white space does.
    """

    def __init__(self, texts: pa.Array, signs_divide: bool = False):
        texts = texts.fill_null("")
        n = len(texts)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        self.data = _lower[raw]
        self.text_start = ends
        inside = ~(_space_or_sign if signs_divide else _space)[raw]
        size = len(raw)
        edge = np.zeros(size + 1, dtype=bool)
        edge[ends] = True
        before = np.empty(size, dtype=bool)
        if size:
            before[0] = False
            before[1:] = inside[:-1]
            before &= ~edge[:-1]
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(size, dtype=bool)
        if size:
            after[-1] = False
            after[:-1] = inside[1:]
            after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, size), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _power("down", _INVERSE, size + 1)[self.start]
        self._sums = sums
        self.hash = mix(value + (self.end - self.start).astype(np.uint64))
        self.bounds = np.searchsorted(self.start, ends)
        self.doc = np.repeat(np.arange(n), np.diff(self.bounds))
        self.texts = n

    def prefixes(self, size: int) -> np.ndarray:
        """A hash of each word's first `size` bytes (of all, in a shorter word)."""
        end = np.minimum(self.end, self.start + size)
        return mix((self._sums[end] - self._sums[self.start]) * _power("down", _INVERSE, len(self.data) + 1)[self.start] + np.uint64(size << 32))

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words and where each text's begin; a text of fewer words has one, its whole sequence, and one without words none.

        The shingle at place i of a text starts with its word i.
        """
        counts = np.diff(self.bounds)
        have = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(have)])
        at = np.repeat(self.bounds[:-1] - bounds[:-1], have) + np.arange(bounds[-1])
        padded = np.concatenate([self.hash, np.zeros(size, np.uint64)])
        long = np.repeat(counts >= size, have)
        total = np.zeros(len(at), dtype=np.uint64)
        left = np.repeat(counts, have)
        for k in range(size):
            part = mix(padded[at + k] + np.uint64(k)) * _PLACES[k % len(_PLACES)] if size > len(_PLACES) else padded[at + k] * _PLACES[k]
            total += part if k == 0 else np.where(long | (left > k), part, np.uint64(0))
        total += np.where(long, np.uint64(size), left.astype(np.uint64))
        return mix(total), bounds


class Digests:
    """Digests of any runs of a sequence of 64-bit integers, from prefix sums; equal runs have equal ones wherever they are."""

    def __init__(self, values: np.ndarray):
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power("up", _BASE, len(values)), out=self._sums[1:])
        self._down = _power("down", _INVERSE, len(values) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[begin]) * self._down[begin] + (end - begin).astype(np.uint64))


def sorted_sets(hashes: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct hashes in ascending order."""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = np.sort(hashes[a:b])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
