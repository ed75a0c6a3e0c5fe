"""Approximate nearest neighbours: an NN-descent graph, built and searched by joins.

Dong, Moses and Li, "Efficient k-nearest neighbor graph construction for generic similarity measures",
WWW 2011. Each vector keeps its `k` best neighbours so far. A round joins, at every vector, its neighbours and
some of the vectors it is a neighbour of (the local join): any two of them are candidates for each
other, being neighbours of neighbours. Vectors travel as 16-bit floats, some seventy to a local join; each member gets the best
few candidates back, and one grouping merges them. The first neighbours come from blocks of `block` vectors with like
signs of random projections: a code with too many vectors is split over further blocks at random, so no block is larger.

Queries are rows of the graph: search starts at a query's own neighbours and is greedy: each step expands the best
`width` not yet expanded, fetching their neighbours' vectors by joins, and keeps the best `beam`. Final scores are double-precision
products of the original vectors.

Reverse neighbours beyond `reverse` are sampled by hash: part of the method, it bounds a hub's local join. All vectors are in the
graph; none is left out as a candidate by that sample, which only limits through whom they meet.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no part; null vec_ids take no part; rows that repeat a vec_id count once (the least
vector); vectors of another length than the most frequent one are compared over the components both have, missing ones counting 0; with fewer candidates than asked for, all are
returned; an empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, discard, release
from .topk import finite


@dataclass(frozen=True)
class Settings:
    #: Neighbours of a vector in the graph.
    k: int = 40
    #: Reverse neighbours that a local join takes.
    reverse: int = 30
    #: Candidates that a member of a local join gets back.
    offers: int = 15
    #: Local-join rounds.
    rounds: int = 6
    #: Random projections that vectors are first blocked by, and vectors in a block.
    tables: int = 3
    block: int = 512
    #: Search: candidates kept, expanded in a step, steps.
    beam: int = 200
    width: int = 40
    steps: int = 5


def _rows(column) -> np.ndarray:
    """A matrix of vectors packed as 16-bit floats; shorter ones are filled with zeros."""
    parts = [np.frombuffer(x, np.float16) for x in column.to_pylist()]
    size = max(map(len, parts), default=0)
    out = np.zeros((len(parts), size), np.float32)
    for i, x in enumerate(parts):
        out[i, : len(x)] = x
    return out


def _scores(m: np.ndarray) -> np.ndarray:
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    return s


def _offers(ids: np.ndarray, m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member's best others and their scores, `most` at most."""
    s = _scores(m)
    most = min(most, len(ids) - 1)
    top = np.argpartition(-s, most - 1, axis=1)[:, :most]
    return ids[top], np.take_along_axis(s, top, 1)


_OFFER = "id bigint, others binary, scores binary"


def _packed(vectors: DataFrame) -> DataFrame:
    """id, v: vectors as 16-bit floats, scaled to length 1 at most for the graph's table range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch["v"].values.to_numpy(zero_copy_only=False), batch["v"].offsets.to_numpy()
            own = [flat[a:b].astype(np.float64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([np.clip(x, -6e4, 6e4).astype(np.float16).tobytes() for x in own], pa.binary())], ["id", "v"])

    return vectors.mapInArrow(run, "id bigint, v binary")


def _table(ids, others, scores) -> pa.Table:
    return pa.table([pa.array(ids, pa.int64()), pa.array(others, pa.binary()), pa.array(scores, pa.binary())], names=["id", "others", "scores"])


def _block_offers(most: int):
    def run(rows: pa.Table) -> pa.Table:
        if rows.num_rows < 2:
            return _table([], [], [])
        rows = rows.sort_by("id")
        ids = rows["id"].to_numpy()
        other, score = _offers(ids, _rows(rows["v"]), most)
        return _table(ids, [x.astype("<i8").tobytes() for x in other], [x.astype("<f4").tobytes() for x in score])

    return run


def _best(k: int):
    """Offers to one vector, merged: its k best neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offers, scores = batch["id"], batch["others"].to_pylist(), batch["scores"].to_pylist()
            lists, firsts, all_scores = [], [], []
            for o, s in zip(offers, scores, strict=True):
                i, x = np.frombuffer(b"".join(o), "<i8"), np.frombuffer(b"".join(s), "<f4")
                order = np.lexsort((i, -x))
                i, x = i[order], x[order]
                first = np.sort(np.unique(i, return_index=True)[1])[:k]
                lists.append(i[first])
                all_scores.append(x[first].astype("<f4").tobytes())
                firsts.append(i[first].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(firsts, pa.binary()), pa.array(all_scores, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["id", "others", "scores", "near"])

    return run


def _merged(offers: DataFrame, k: int) -> DataFrame:
    """id, others, scores, near (array) of each vector's k best."""
    own = offers.groupBy("id").agg(F.collect_list("others").alias("others"), F.collect_list("scores").alias("scores"))
    return own.mapInArrow(_best(k), "id bigint, others binary, scores binary, near array<bigint>")


def _first(vectors: DataFrame, settings: Settings, count: int, size: int) -> DataFrame:
    """Offers within blocks of like vectors."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / settings.block)))))
    out = None
    for table in range(settings.tables):
        planes = np.random.default_rng(table).normal(size=(size, bits)).astype(np.float32)

        def code(batches: Iterator[pa.RecordBatch], planes=planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = np.zeros((batch.num_rows, len(planes)), np.float32)
                own = _rows(batch["v"])[:, : len(planes)]
                m[:, : own.shape[1]] = own
                side = (m @ planes > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64)) if planes.shape[1] else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(side, pa.int64())], ["id", "v", "code"])

        coded = cut(vectors.mapInArrow(code, "id bigint, v binary, code bigint"))
        sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("parts"))
        dealt = coded.join(cut(sizes), "code").withColumn("part", F.pmod(F.xxhash64("id", F.lit(table)), F.col("parts")))
        offers = dealt.select("code", "part", "id", "v").groupBy("code", "part").applyInArrow(_block_offers(settings.k), _OFFER)
        out = offers if out is None else out.unionByName(offers)
    return out


def _local_joins(graph: DataFrame, vectors: DataFrame, settings: Settings) -> DataFrame:
    """Offers among the neighbours and reverse neighbours of every vector."""
    edge = graph.select(F.col("id").alias("at"), F.explode("near").alias("id"))
    # a hub's reverse neighbours: the lowest by hash, kept by the window's own limit
    order = Window.partitionBy("id").orderBy(F.xxhash64("at", "id"))
    back = edge.withColumn("n", F.row_number().over(order)).where(F.col("n") <= settings.reverse).select(F.col("id").alias("at"), F.col("at").alias("id"))
    both = edge.unionByName(back).distinct()
    met = both.join(vectors, "id")

    return met.groupBy("at").applyInArrow(_block_offers(settings.offers), _OFFER)


def build(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The graph: id, others, scores (packed), near (array of ids, nearest first). vectors: id, v (packed 16-bit floats)."""
    count, size = vectors.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    graph = cut(_merged(_first(vectors, settings, count, (size or 0) // 2), settings.k))
    release(graph.sparkSession)
    for _ in range(settings.rounds if count > settings.k + 1 else 0):
        offers = _local_joins(graph, vectors, settings).unionByName(graph.select("id", "others", "scores"))
        graph, last = cut(_merged(offers, settings.k)), graph
        # a round's shuffles are its largest files
        discard(last)
        del offers
        release(graph.sparkSession)
    return graph


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, settings: Settings = Settings(), k: int = 20) -> DataFrame:
    """query_id, vec_id of each query's candidates after greedy search. queries: id, v (packed)."""
    beam = graph.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("q"), F.explode("near").alias("id")).withColumn("open", F.lit(True))
    back = graph.select(F.col("id").alias("q"), F.explode("near").alias("id"))
    # those whose neighbour the query is, by the same hash limit as in the joins
    order = Window.partitionBy("q").orderBy(F.xxhash64("id"))
    back = back.select(F.col("id").alias("q"), F.col("q").alias("id")).join(queries.select(F.col("id").alias("q")), "q", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= settings.k).select("q", "id", F.lit(True).alias("open"))
    beam = cut(beam.unionByName(back).distinct())
    query = queries.select(F.col("id").alias("q"), F.col("v").alias("qv"))

    def rank(key, rows):
        q = rows["qv"][0].as_py()
        opened: dict[int, bool] = {}
        ids, is_open = rows["id"].to_numpy(), rows["open"].to_numpy()
        first = {}
        for i, (x, o) in enumerate(zip(ids.tolist(), is_open.tolist(), strict=True)):
            opened[x] = opened.get(x, True) and o
            first.setdefault(x, i)
        at = np.array(sorted(first.values()))
        m = _rows(pa.chunked_array([pa.concat_arrays([pa.array([q], pa.binary()), rows["v"].combine_chunks().take(pa.array(at))])]))
        s = m[1:] @ m[0]
        order = np.lexsort((ids[at], -s))[: settings.beam]
        kept = ids[at][order]
        return pa.table([pa.array([rows["q"][0].as_py()] * len(kept), pa.int64()), pa.array(kept, pa.int64()), pa.array([opened[x] for x in kept.tolist()], pa.bool_()), pa.array(range(len(kept)), pa.int32())], names=["q", "id", "open", "place"])

    schema = "q bigint, id bigint, open boolean, place int"
    score = lambda b: b.where("q <> id").join(vectors, "id").join(query, "q").groupBy("q").applyInArrow(rank, schema)
    beam = cut(score(beam))
    for _ in range(settings.steps):
        turn = Window.partitionBy("q").orderBy("place")
        go = beam.where("open").withColumn("n", F.row_number().over(turn)).where(F.col("n") <= settings.width).select("q", "id")
        found = go.join(graph.select("id", "near"), "id").select("q", F.explode("near").alias("id")).distinct().withColumn("open", F.lit(True))
        shut = beam.join(go.withColumn("went", F.lit(True)), ["q", "id"], "left").select("q", "id", (F.col("open") & F.col("went").isNull()).alias("open"))
        beam, last = cut(score(shut.unionByName(found))), beam
        discard(last)
        del go, found, shut
        release(graph.sparkSession)
    return beam.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"))


def nearest(table: DataFrame, is_query, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `is_query` (a condition on vec_id) holds.

    table: vec_id, embedding.
    """
    fine = table.where("vec_id is not null").where(finite("embedding")).select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = cut(fine.where(F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v")))
    vectors = cut(_packed(fine))
    graph = build(vectors, settings)
    found = search(vectors.where(is_query), graph, vectors, settings, k)
    ends = found.join(fine.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").join(fine.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ends.select("query_id", "vec_id", product.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of every vec_id divisible by 20, among all other rows of `embeddings`."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
