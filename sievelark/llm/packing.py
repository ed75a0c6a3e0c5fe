"""Packing: sum-of-squares online packing of documents into fixed token windows.

Each task packs the documents of its input partition as they come, so there is no shuffle. A document is
its ids and an end id; whole windows are cut off it first, and the rest is placed into the fill
level where the sum over levels of (number of partly filled windows there) squared becomes least
(Csirik et al., "On the sum-of-squares algorithm for bin packing", JACM 2006), ties to the fullest window. Levels are kept in one array of counts.

When a task's input ends, its open windows (few: the rule holds their number low) are joined: the fullest take,
in order, pieces cut from the emptiest. One partly filled window remains at most, and is cut into
sequences of power-of-two length, which need no padding. So padding is nil for any input.

Defined cases: a null or empty text is the end id alone; null doc_ids, repeated rows and texts of any length are packed as
they are; an empty table gives no pieces. Columns other than doc_id and text are not read.
A piece's sequence is unique over all tasks: the input partition's number in the upper bits, a count in the
lower 36. A task that runs anew packs the same rows of its partition into the same numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import default_path, vocabulary

WINDOW = 1024
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Pieces in an output batch.
_BATCH = 20_000

#: doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, np.ndarray, int]


class Levels:
    """Open windows by fill level, and where the next piece goes."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level whose window takes a piece of `size`; 0 is a new window."""
        top = self.window - size
        here = self.count[: top + 1]
        there = 2 * self.count[size:] + 1  # what a window more costs at the level reached
        there[-1] = 0  # full windows are no level
        change = there - (2 * here - 1)
        change[0] = there[0]
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Places a piece; the window, if that filled it."""
        size = len(piece[2])
        level = self.level_for(size)
        if level:
            self.count[level] -= 1
            pieces = self.open[level].pop()
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.count[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def join(self) -> Iterator[list[Piece]]:
        """The open windows, recut so that all but power-of-two ones are full."""
        rest = [p for level in range(self.window, 0, -1) for p in self.open[level]]
        own: list[Piece] = []
        fill, last = 0, len(rest)
        for k, pieces in enumerate(rest):
            if k >= last:
                break
            own, fill = list(pieces), sum(len(p[2]) for p in pieces)
            while fill < self.window and last > k + 1:
                if not rest[last - 1]:
                    last -= 1
                    continue
                doc, start, ids, total = rest[last - 1].pop()
                cut = min(len(ids), self.window - fill)
                own.append((doc, start, ids[:cut], total))
                fill += cut
                if cut < len(ids):
                    rest[last - 1].append((doc, start + cut, ids[cut:], total))
            if fill == self.window:
                yield own
                own, fill = [], 0
        while fill:
            size, part = 1 << (fill.bit_length() - 1), []
            fill -= size
            while size:
                doc, start, ids, total = own.pop(0)
                part.append((doc, start, ids[:size], total))
                if size < len(ids):
                    own.insert(0, (doc, start + size, ids[size:], total))
                size -= len(part[-1][2])
            yield part


def windows(documents: Iterator[tuple[int | None, np.ndarray]], window: int) -> Iterator[list[Piece]]:
    """Sequences of pieces for documents given as ids."""
    levels = Levels(window)
    for doc, ids in documents:
        whole = len(ids) - len(ids) % window
        for start in range(0, whole, window):
            yield [(doc, start, ids[start : start + window], len(ids))]
        if whole < len(ids):
            full = levels.place((doc, whole, ids[whole:].copy(), len(ids)))
            if full:
                yield full
    yield from levels.join()


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row per piece of `documents` (doc_id, text): which ids it holds, and where in which sequence they lie."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        base = TaskContext.get().partitionId() << 36

        def ids() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    yield doc.as_py(), np.append(vocab.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)

        rows: list[tuple] = []
        for k, pieces in enumerate(windows(ids(), window)):
            at = 0
            for doc, start, own, total in pieces:
                rows.append((doc, start, len(own), zlib.crc32(own.tobytes()), total, base + k, at))
                at += len(own)
            if len(rows) >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into windows of 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
