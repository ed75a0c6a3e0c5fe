"""Pairs of lines that share enough words, all of them: prefix filtering over whole Arrow batches.

A line's elements are its words; a word's later occurrences count as elements of their own. Elements have one order for all lines: first words of few
lines, by hash, then the listed frequent ones, the rarest first. Two lines that share `o` elements or more share two at least among the first w - o + 2
of each (w: a line's elements): else the later of the two prefixes would leave room for fewer than `o`. What `o` has to be:

- lines of up to `LONG` characters: half of the elements of the line that has more;
- where either is longer: all but a fifth, which is what an edit similarity of 0.8 in words implies.

Of the shared two, the first is either a word of few lines, and the lines meet on it alone, or it and the second are frequent, and they meet on both
together. So a line's tokens are the rare elements of its prefix and all twos of the frequent ones. Lines of `MANY` words or more meet on single
elements instead (those near that number have both kinds), and two lines of two words on one of them.

The order decides how many pairs are looked at, never which links are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa

from .words import Words, mix, text_slices

#: Lines of more characters are compared by words.
LONG = 128
#: Lines that a word may be in to count as rare, and most rows of a token of which all pairs are made in one place.
RARE = 128
#: Frequent words that are listed, the most frequent ones first; the list orders elements, so its end costs time only.
LISTED = 1 << 18
#: From how many words lines have single tokens.
MANY = 500
#: Longs of a sketch.
LANES = 4
#: Pairs made at a time.
STEP = 1 << 21
#: Bits of a row's number that hold its characters (up to LONG, or one more) and its words (up to 1,023).
SIZE_BITS, WORD_BITS = 8, 10

_ONE, _SECOND, _TWO, _OCCURRENCE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def least_common(longer: np.ndarray, few: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Elements that two lines must share, by the number of the one that has more. few: both have up to LONG characters."""
    edits = longer * (similarity.denominator - similarity.numerator) // similarity.denominator
    return np.where(few, (longer + 1) // 2, longer - edits)


def _sorted_elements(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words' hashes and their elements, by line and hash."""
    order = np.lexsort((words.hash, words.doc))
    own, doc = words.hash[order], words.doc[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(own))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return own, np.where(new, own, mix(own + nth * _OCCURRENCE))


def _twos(ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all twos within groups: `begins` are consecutive places, `ends` where each one's group ends."""
    many = ends - begins - 1
    first = np.repeat(begins, many)
    starts = np.cumsum(many) - many
    return first, np.arange(len(first)) - np.repeat(starts, many) + first + 1


def counts(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words' hashes and in how many of the lines they are."""
    parts = []
    for _, some in text_slices(lines):
        own, element = _sorted_elements(Words(some))
        parts.append(own[own == element])
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sketches(lines: pa.Array) -> np.ndarray:
    """LANES longs per line, of whose bits each is the parity of the elements that are dealt to it: two lines' differ in no more bits than elements."""
    out = np.zeros(len(lines) * LANES, np.uint64)
    for first, some in text_slices(lines):
        own = Words(some)
        _, element = _sorted_elements(own)
        place = mix(element + _ONE)
        lane = ((place >> np.uint64(6)) % np.uint64(LANES)).astype(np.int64)
        np.bitwise_xor.at(out, (own.doc + first) * LANES + lane, np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(len(lines), LANES)


def tokens(lines: pa.Array, sizes: np.ndarray, listed: np.ndarray, rank: np.ndarray, similarity: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, token) of each slice. listed: hashes of frequent words, ascending; rank: their places from 1, of the rarest."""
    for first, some in text_slices(lines):
        words = Words(some)
        own, element = _sorted_elements(words)
        have = np.diff(words.bounds)
        if not len(own):
            continue
        # stable: within one rank, elements stay in the order of their hashes
        if len(listed):
            at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
            place = np.where(listed[at] == own, rank[at], 0)
        else:
            place = np.zeros(len(own), np.int64)
        order = np.argsort((words.doc << 20) | place, kind="stable")
        element, frequent = element[order], place[order] > 0
        few = sizes[first : first + len(some)] <= LONG
        prefix = np.minimum(have - least_common(have, few, similarity) + 2, have)
        inside = np.arange(len(element)) - words.bounds[:-1][words.doc] < prefix[words.doc]
        single = inside & (~frequent | (have * similarity.denominator >= MANY * similarity.numerator)[words.doc])
        yield words.doc[single] + first, mix(element[single] * _ONE)
        both = np.flatnonzero(inside & frequent & (have < MANY)[words.doc])
        i, j = _twos(np.searchsorted(words.doc[both], words.doc[both], "right"), np.arange(len(both)))
        yield words.doc[both[i]] + first, mix(element[both[i]] * _SECOND + element[both[j]])
        two = frequent & (few & (have == 2))[words.doc]
        yield words.doc[two] + first, mix(element[two] * _TWO)


def packed(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One long for a line: its number, characters and words."""
    small = np.minimum(sizes, LONG + 1) << WORD_BITS | np.minimum(words, (1 << WORD_BITS) - 1)
    return ids << (SIZE_BITS + WORD_BITS) | small


def _fit(a: np.ndarray, b: np.ndarray, bits: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether the numbers of characters and words of packed lines, and the bits in which their sketches differ, allow a link."""
    full = (1 << WORD_BITS) - 1
    w, v = a & full, b & full
    n, m = a >> WORD_BITS & ((1 << SIZE_BITS) - 1), b >> WORD_BITS & ((1 << SIZE_BITS) - 1)
    few = np.maximum(n, m) <= LONG
    near = np.minimum(n, m) * similarity.denominator >= np.maximum(n, m) * similarity.numerator
    longer = np.maximum(w, v)
    common = least_common(longer, few, similarity)
    return (~few | near) & ((longer == full) | ((np.minimum(w, v) >= common) & (bits <= w + v - 2 * common)))


def meet(token: np.ndarray, line: np.ndarray, sketch: np.ndarray, similarity: Fraction) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """(None, u, v): numbers u < v of lines that share a token of up to RARE rows, in all pairs; (token, u, u): the rows of the other tokens.

    line: packed; sketch: the lanes of each line's sketch, folded into one.
    """
    order = np.argsort(token, kind="stable")
    token, line, sketch = token[order], line[order], sketch[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(token)))
    end = np.repeat(begin + many, many)
    size = np.repeat(many, many)
    shift = SIZE_BITS + WORD_BITS
    rest = size > RARE
    if rest.any():
        yield token[rest], line[rest] >> shift, line[rest] >> shift
    some = np.flatnonzero((size > 1) & ~rest)
    made = np.cumsum(end[some] - some - 1)
    cuts = np.searchsorted(made, np.arange(STEP, made[-1] + STEP, STEP)) if len(made) else []
    for part in np.split(some, np.unique(cuts)) if len(made) else []:
        i, j = _twos(end[part], part)
        # of signed numbers, numpy counts the bits of the magnitude
        fits = _fit(line[i], line[j], np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)), similarity)
        u, v = line[i[fits]] >> shift, line[j[fits]] >> shift
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]
        if len(u):
            yield None, *_distinct(u, v)


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new], v[new]
