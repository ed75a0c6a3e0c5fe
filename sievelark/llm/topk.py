"""Exact top-k search: no-random-access aggregation (NRA) over sorted component lists.

Fagin, Lotem and Naor, "Optimal aggregation algorithms for middleware", 2001. The score of a row for a query is the sum
of 64 products, one per component; each component has a list of rows sorted by product. Reading all lists to
a depth shows every product that is at least the list's value there. A row's lower bound adds the products seen
and, for lists where it wasn't, the list's last value; its upper bound adds the value at the depth reached. A row whose
upper bound is under the k-th lower bound is an outsider and is dropped; reading goes deeper until few rows are left, whose scores
are then resolved. Ties stay in, so results are exact. Lists cover 1,024 rows at a time, and resolved scores bound the next ones: in 64
dimensions, bounds without them stay loose until lists are nearly read. All products of a list's rows are made before it is read, at two depths only, so
this is the method's pruning without its saving of products.

Rows and queries meet in blocks: a block of rows (about `rows_per_block`, by hash of the id) sorts its lists once and serves a block of
queries; best rows of each block are merged per query. Blocks have a bounded size, so neither many queries nor many rows meet in one
task, and each row is copied once per block of queries only.

Defined cases: vectors that are null, empty, or hold null, NaN or infinite components take no part, as query or as candidate;
a query's own row is any with its vec_id; rows that repeat a vec_id count once (the least vector); vectors of another length than a query's are no candidates of it; null
vec_ids take no part; an empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows whose lists are read together; the k-th score so far bounds what is read after.
READ = 1024


def finite(vector: str) -> Column:
    """Whether a vector can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


class Lists:
    """Sorted lists over the components of some rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.sorted = np.sort(rows, axis=0)
        self.ones = np.ones(rows.shape[1], rows.dtype)

    def depth(self, query: np.ndarray, t: int) -> np.ndarray:
        """Each list's product at depth t (from 1), for lists sorted by product, highest first."""
        return query * np.where(query >= 0, self.sorted[len(self.rows) - t], self.sorted[t - 1])

    def best(self, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of rows that may be among the k best, all those with a score of `floor` at least among them; the own row left out.

        floor: a k-th lower bound known from rows read before.
        """
        n = len(self.rows)
        product = self.rows * query
        alive = np.flatnonzero(self.ids != own)
        last = self.depth(query, n)
        for t in (n // 2, 3 * n // 4):
            if len(alive) <= 4 * k or not t:
                break
            here, part = self.depth(query, t), product if len(alive) == n else product[alive]
            if floor == -np.inf:
                lower = np.where(part >= here, part, last) @ self.ones
                low = np.partition(lower, len(lower) - k)[len(lower) - k]
            else:
                low = floor
            alive = alive[np.maximum(part, here) @ self.ones >= low]
        return self.ids[alive], product[alive] @ self.ones


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rows_per_block: int = 8192, queries_per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of highest integer inner product.

    vectors, queries: id, v (array of bigint).
    """
    blocks = max(1, -(-vectors.count() // rows_per_block))
    parts = max(1, -(-queries.count() // queries_per_block))
    row = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "v")
    query = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v")

    def run(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("id")
            ids, own = rows["id"].to_numpy(), _matrix(rows["v"])
            by_length: dict[int, list[int]] = {}
            for i in range(len(ids)):
                by_length.setdefault(len(own[i]), []).append(i)
            lists: dict[int, list[Lists]] = {}
            for size, at in by_length.items():
                table = np.array([own[i] for i in at], np.int64)
                if np.abs(table).max() < 1 << 20:
                    table = table.astype(np.float64)  # whole numbers: sums of products stay exact, far under 2**53
                lists[size] = [Lists(ids[at[i : i + READ]], table[i : i + READ]) for i in range(0, len(at), READ)]
            for q, v in zip(asked["id"].to_pylist(), _matrix(asked["v"]), strict=True):
                found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for some in lists.get(len(v), []):
                    exact = some.rows.dtype == np.float64 and np.abs(v).max() < 1 << 20
                    low = score[-1] if len(score) == k else -np.inf
                    ids_, score_ = some.best(v.astype(some.rows.dtype if exact else np.int64), q, k, low)
                    found, score = np.append(found, ids_), np.append(score, score_.astype(np.int64))
                    order = np.lexsort((found, -score))[:k]
                    found, score = found[order], score[order]
                out += [(q, int(i), int(s)) for i, s in zip(found, score, strict=True)]
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], [], []], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    met = query.groupBy("block", "part").cogroup(row.groupBy("block", "part"))
    found = met.applyInArrow(lambda key, q, r: run(key, r, q), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score for every vec_id divisible by 100 over all `embeddings`, components as floor(1024 * x)."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null").where(finite("embedding"))
    whole = table.select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double"))).alias("v"))
    whole = whole.groupBy("id").agg(F.min("v").alias("v"))
    return search(whole, whole.where("id % 100 = 0"))


ORACLE = """WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)::BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""
