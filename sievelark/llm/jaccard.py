"""N-gram Jaccard join: documents whose sets of word shingles are at least 80 % alike, and their groups.

Rare-first prefix filtering (Chaudhuri et al. 2006; Xiao et al., "Efficient similarity joins for
near-duplicate detection", PPJoin+, 2008): order all shingles by document frequency, rarest first.
Two sets that are alike enough share a shingle among the first few of both, so only those are joined;
length, positional and suffix filters drop most pairs before one verification each.

1. One pass over whole texts hashes shingles (numpy, whole Arrow batches). Each task sends its (shingle, document)
   pairs to buckets by shingle, packed in binary columns in document order (56 bits of the hash, and documents in runs), so the
   shuffle has few rows and under 7 bytes a pair. Copies within a task send their pairs once. A shingle found in many documents of one task is
   hot: one mark goes to its bucket, and its pairs go straight to the documents, so no bucket
   gathers a hot shingle's pairs.
2. A bucket counts document frequencies. Shingles of one document only can't match and go no further; the
   others are told to their documents' groups, as numbers that sort by frequency: 8 bits of its logarithm
   (hot ones last), then 56 bits of the hash.
3. A document whose unshared shingles fill its prefix is done. Documents of equal sets form classes.
   What is left is joined on prefix shingles.
4. Pairs are made in star form: each prefix shingle's most central document against its others. Components of the links
   found are formed, and further rounds make only pairs that join two components: first stars again, at last all
   such pairs. So large groups of near copies cost pairs in proportion to their size, yet every
   link that could join two groups is verified: components are exact.

Hashes stand for shingles (56 bits within a pair of documents); a wrong link needs such collisions in a fifth of a set.

Defined cases: null or empty texts, or those of white space only, have no shingles and link with nothing; fewer than five words are one
shingle; rows that share a doc_id are one document of several texts, linked if any of them links; a null
doc_id gets its own row with its own count and no component but null; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, release
from .linking import band, link
from .words import Words, mix, sorted_sets, text_slices

#: Pairs that a task gathers before it sends them.
FLUSH = 1_000_000
#: A shingle in so many documents of one flush is hot.
HOT = 16
_TOP = np.uint64(255 << 56)


@dataclass(frozen=True)
class Alike:
    """When two sets of a and b shingles with i in common are alike: 100 * i >= percent * (a + b - i)."""

    percent: int = 80
    words: int = 5

    def need(self, a, b):
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n):
        return n - (self.percent * n + 99) // 100 + 1


def planes(x: np.ndarray, width: int = 8) -> bytes:
    """64-bit integers by byte planes, highest first, so that the shuffle's compression finds what is constant or runs. width: how many of the upper bytes go."""
    return x.view(np.uint8).reshape(-1, 8)[:, ::-1][:, :width].T.tobytes()


def from_planes(x: bytes, kind=np.uint64, width: int = 8) -> np.ndarray:
    own = np.frombuffer(x, np.uint8).reshape(width, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, 8 - width :] = own[::-1].T
    return out.view(kind).reshape(-1)


def _joined(column: pa.ChunkedArray, kind=np.uint64, width: int = 8) -> np.ndarray:
    parts = [from_planes(x, kind, width) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bucket_counts(pairs: float) -> tuple[int, int]:
    """How many buckets (a power of two) and document groups hold so many pairs: about a million in a bucket, up to 16 million where there are very many."""
    least = max(64, min(pairs / 1e6, 4096), pairs / 16e6)
    buckets = 1 << math.ceil(math.log2(least))
    return buckets, buckets // 2


def _send(buckets: int, alike: Alike):
    """Texts to one row per flush and bucket: keys and docs of pairs, marks of hot keys, forwarded pairs, and rows of documents."""
    shift = np.uint64(64 - int(math.log2(buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        owners: list[int] = []
        rows: list[tuple[int, int, int, int]] = []
        known: dict[tuple[int, int], int] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            key = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            doc = np.repeat(np.array(owners, np.int64), [len(x) for x in sets]) if sets else np.zeros(0, np.int64)
            sort = np.sort(key)
            first = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]])) if len(key) else np.zeros(0, np.int64)
            marks = sort[first[np.diff(np.append(first, len(key))) >= HOT]]
            near = np.searchsorted(marks, key)
            hot = (marks[np.minimum(near, len(marks) - 1)] == key) if len(marks) else np.zeros(len(key), bool)
            over_key, over_doc = key[hot], doc[hot]
            key, doc = key[~hot], doc[~hot]
            home = (key >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(home, kind="stable")
            key, doc, goes = key[order], doc[order], home[order]
            to = (mix(over_doc.view(np.uint64)) >> shift).astype(np.int64) if shift < 64 else np.zeros(len(over_doc), np.int64)
            order = np.argsort(to, kind="stable")
            over_key, over_doc, to = over_key[order], over_doc[order], to[order]
            table = np.array(rows, np.uint64).reshape(-1, 4)
            home = (mix(table[:, 0].copy()) >> shift).astype(np.int64)
            order = np.argsort(home, kind="stable")
            table, home = table[order], home[order]
            edges = np.arange(buckets + 1)
            cuts = lambda x: np.searchsorted(x, edges)
            a, m, o, r = cuts(goes.astype(np.int64)), cuts((marks >> shift).astype(np.int64)), cuts(to), cuts(home)
            some = [b for b in range(buckets) if a[b + 1] > a[b] or m[b + 1] > m[b] or o[b + 1] > o[b] or r[b + 1] > r[b]]
            cols = [
                pa.array(some, pa.int32()),
                pa.array([planes(key[a[b] : a[b + 1]], 7) for b in some], pa.binary()),
                pa.array([planes(doc[a[b] : a[b + 1]]) for b in some], pa.binary()),
                pa.array([planes(marks[m[b] : m[b + 1]], 7) for b in some], pa.binary()),
                pa.array([planes(over_key[o[b] : o[b + 1]], 7) for b in some], pa.binary()),
                pa.array([planes(over_doc[o[b] : o[b + 1]]) for b in some], pa.binary()),
                pa.array([planes(np.ascontiguousarray(table[r[b] : r[b + 1]].reshape(-1))) for b in some], pa.binary()),
            ]
            for k in range(0, len(some), 256):
                yield pa.RecordBatch.from_arrays([c.slice(k, 256) for c in cols], ["bucket", "keys", "key_docs", "marks", "over", "over_docs", "docs"])
            sets.clear()
            owners.clear()
            rows.clear()
            known.clear()
            held = 0

        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for first, part in text_slices(batch["text"]):
                hashes, bounds = Words(part).shingles(alike.words)
                # the upper 56 bits stand for a shingle from here on
                for k, own in enumerate(sorted_sets(hashes & ~np.uint64(255), bounds)):
                    doc = int(ids[first + k])
                    with np.errstate(over="ignore"):
                        print_ = (int(np.bitwise_xor.reduce(mix(own + np.uint64(1)))), int(np.add.reduce(mix(own ^ _TOP)))) if len(own) else (0, 0)
                    rows.append((doc & 0xFFFFFFFFFFFFFFFF, len(own), *print_))
                    if len(own) and print_ not in known:
                        known[print_] = doc
                        sets.append(own)
                        owners.append(doc)
                        held += len(own)
                if held >= FLUSH:
                    yield from flush()
        if rows:
            yield from flush()

    return run


def _count(groups: int):
    """A bucket's rows to one row per document group: shared pairs as sortable tokens, and rows of documents."""

    def run(table: pa.Table) -> pa.Table:
        key, doc = _joined(table["keys"], width=7), _joined(table["key_docs"], np.int64)
        marks = np.unique(_joined(table["marks"], width=7))
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        # rows that repeat a doc_id don't make a shingle shared
        other = np.zeros(len(key), bool)
        other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        several = np.logical_or.reduceat(other, first) if len(first) else np.zeros(0, bool)
        hot = np.isin(key[first], marks, assume_unique=True)
        kind = np.where(hot, 255, np.minimum(254, np.floor(8 * np.log2(np.maximum(size, 2))))).astype(np.uint64)
        keep = np.repeat(several | hot, size)
        token = (np.repeat(kind, size)[keep] << np.uint64(56)) | (key[keep] >> np.uint64(8))
        over = _TOP | (_joined(table["over"], width=7) >> np.uint64(8))
        token, doc = np.concatenate([token, over]), np.concatenate([doc[keep], _joined(table["over_docs"], np.int64)])
        rows = _joined(table["docs"]).reshape(-1, 4)
        place = lambda d: (mix(d.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        to, home = place(doc), place(np.ascontiguousarray(rows[:, 0]))
        order = np.lexsort((doc, to))
        token, doc, to = token[order], doc[order], to[order]
        order = np.argsort(home, kind="stable")
        rows, home = rows[order], home[order]
        edges = np.arange(groups + 1)
        a, r = np.searchsorted(to, edges), np.searchsorted(home, edges)
        some = [g for g in range(groups) if a[g + 1] > a[g] or r[g + 1] > r[g]]
        return pa.table({
            "grp": pa.array(some, pa.int32()),
            "tokens": pa.array([planes(token[a[g] : a[g + 1]]) for g in some], pa.binary()),
            "token_docs": pa.array([planes(doc[a[g] : a[g + 1]]) for g in some], pa.binary()),
            "docs": pa.array([planes(np.ascontiguousarray(rows[r[g] : r[g + 1]].reshape(-1))) for g in some], pa.binary()),
        })

    return run


_DOCS = "doc_id bigint, n bigint, print1 bigint, print2 bigint, unshared int, central double, tokens array<bigint>"


def _gather(alike: Alike):
    """A document group's rows to one row per row of documents; tokens, rarest first, only where the prefix has a shared one."""

    def run(table: pa.Table) -> pa.Table:
        token, doc = _joined(table["tokens"]), _joined(table["token_docs"], np.int64)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        rows = _joined(table["docs"]).reshape(-1, 4)
        ids = rows[:, 0].copy().view(np.int64)
        n = rows[:, 1].astype(np.int64)
        a, b = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        lists, unshared, central = [], np.zeros(len(ids), np.int32), np.zeros(len(ids))
        for k in range(len(ids)):
            own = token[a[k] : b[k]]
            if len(own):
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            unshared[k] = max(0, n[k] - len(own))
            if len(own) and unshared[k] < alike.prefix(int(n[k])):
                lists.append(own.view(np.int64))
                central[k] = float((own >> np.uint64(56)).sum()) / max(1, n[k])
            else:
                lists.append(None)
        return pa.table({"doc_id": pa.array(ids), "n": pa.array(n), "print1": pa.array(rows[:, 2].copy().view(np.int64)), "print2": pa.array(rows[:, 3].copy().view(np.int64)), "unshared": pa.array(unshared), "central": pa.array(central), "tokens": pa.array(lists, pa.list_(pa.int64()))})

    return run


def token_rows(documents: DataFrame, alike: Alike) -> DataFrame:
    """One row per row of `documents` with its set's size and print, and its shared shingles where they can match."""
    texts = documents.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = bucket_counts(size / 6)
    sent = texts.mapInArrow(_send(buckets, alike), "bucket int, keys binary, key_docs binary, marks binary, over binary, over_docs binary, docs binary")
    counted = sent.groupBy("bucket").applyInArrow(_count(groups), "grp int, tokens binary, token_docs binary, docs binary")
    return counted.groupBy("grp").applyInArrow(_gather(alike), _DOCS)


def verify(pairs: DataFrame, nodes: DataFrame, alike: Alike) -> DataFrame:
    """Those of `pairs` (u, v: node ids) that are alike. nodes: id, n, unshared, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, na, nb, ua, ub = (batch[c].to_numpy() for c in ("u", "v", "na", "nb", "ua", "ub"))
            ta, tb = batch["ta"], batch["tb"]
            av, bv = ta.values.to_numpy().view(np.uint64), tb.values.to_numpy().view(np.uint64)
            ao, bo = ta.offsets.to_numpy(), tb.offsets.to_numpy()
            good = np.zeros(len(u), bool)
            for k in range(len(u)):
                a, b = av[ao[k] : ao[k + 1]], bv[bo[k] : bo[k + 1]]
                need = alike.need(int(na[k]), int(nb[k]))
                most = int(na[k] + nb[k]) - 2 * need  # elements that only one set has
                # suffix filter: where the middle of one set falls in the other bounds what they share
                half = len(b) // 2
                at = int(np.searchsorted(a, b[half])) if len(b) else 0
                if ua[k] + ub[k] + abs(at - half) + abs((len(a) - at) - (len(b) - half)) - 1 > most:
                    continue
                good[k] = len(np.intersect1d(a, b, assume_unique=True)) >= need
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep)], ["u", "v"])

    first = nodes.select(F.col("id").alias("u"), F.col("n").alias("na"), F.col("unshared").alias("ua"), F.col("tokens").alias("ta"))
    second = nodes.select(F.col("id").alias("v"), F.col("n").alias("nb"), F.col("unshared").alias("ub"), F.col("tokens").alias("tb"))
    return pairs.join(second, "v").join(first, "u").mapInArrow(run, "u bigint, v bigint")


def groups(documents: DataFrame, alike: Alike = Alike()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row with a doc_id."""
    docs = cut(token_rows(documents, alike))
    release(documents.sparkSession)
    sets = docs.where("n > 0").groupBy("print1", "print2", "n").agg(F.min("doc_id").alias("id"), F.min(F.when(F.col("tokens").isNotNull(), F.col("doc_id"))).alias("holder"))
    sets = cut(sets)
    small = cut(docs.select("doc_id", "n", "print1", "print2"))
    full = docs.where("tokens is not null").select(F.col("doc_id").alias("holder"), "print1", "print2", "n", "unshared", "central", "tokens")
    nodes = cut(full.join(sets.where("holder is not null"), ["holder", "print1", "print2", "n"]).dropDuplicates(["id", "print1", "print2"]).select("id", "n", "unshared", "central", "tokens"))
    del docs, full  # their files go: what follows needs the sets and these few columns only
    docs = small
    release(documents.sparkSession)
    prefix = F.col("n") - F.floor((alike.percent * F.col("n") + 99) / 100) + 1
    rows = nodes.select("id", "n", "unshared", "central", F.posexplode(F.slice("tokens", F.lit(1), F.least((prefix - F.col("unshared")).cast("int"), F.size("tokens")))).alias("at", "token"))
    rows = rows.select("token", "id", "n", "central", (F.col("at") + F.col("unshared")).alias("pos"), band(F.col("n"), alike.percent / 100).alias("band"))
    # rows sharing a doc_id are one document: their classes link
    several = docs.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    same = docs.join(several, "doc_id").join(sets, ["print1", "print2", "n"]).select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    def fits(a, b):  # length and positional filters
        small, large = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
        rest = F.least(a("n") - a("pos"), b("n") - b("pos"))
        return (100 * small >= alike.percent * large) & ((100 + alike.percent) * rest >= alike.percent * (small + large))

    label = link(rows, fits, lambda pairs: verify(pairs, nodes, alike), given=None if same.isEmpty() else same)
    member = docs.join(sets.select("print1", "print2", "n", "id"), ["print1", "print2", "n"], "left")
    out = member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("node")).join(label, "node", "left")
    known = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return known.unionByName(_unnamed(documents, alike))


def _unnamed(documents: DataFrame, alike: Alike) -> DataFrame:
    """Rows without a doc_id: their set's size, and no component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch["text"]):
                sizes = [len(x) for x in sorted_sets(*Words(part).shingles(alike.words))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sizes), pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(sizes), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is null").mapInArrow(run, "doc_id bigint, n_shingles bigint, component_id bigint")


def one_of_each(documents: DataFrame, alike: Alike = Alike()) -> DataFrame:
    """`documents`, all columns, without those whose group has a document of a smaller doc_id; of rows that share a doc_id, one."""
    found = cut(groups(documents, alike).where("doc_id is not null"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    if found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
