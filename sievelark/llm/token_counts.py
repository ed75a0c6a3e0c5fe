"""Token counts: an exact histogram of encoded lengths that answers every context limit.

One pass encodes the documents and sums the number of documents of each length within the task; the shuffle moves
a row per task and length. Suffix sums over the histogram then give, for any limit L, the documents
and tokens at or over L, the tokens left when texts are cut at L, and the share of documents that fit.

The histogram has as many rows as there are different lengths, not documents. Suffix sums run in two steps (within blocks
of 64 lengths, then over blocks), so no task holds more than a block or the list of blocks.

Defined cases: a null or empty text has length 0 (with `end_id`, 1); doc_id is not read, so null and repeated ids
count like any row; an empty table gives no rows. Columns other than `text` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, vocabulary
from .lineage import cut

_BLOCK = 64


def histogram(documents: DataFrame, tokenizer: str | None = None, with_end: bool = False) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, found = vocabulary(path), Counter()
        for batch in batches:
            found.update(len(vocab.ids(text.as_py() or "")) + with_end for text in batch["text"])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["n_tokens", "n_docs"])

    return documents.select("text").mapInArrow(run, "n_tokens bigint, n_docs bigint").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """Adds, for each length L as limit: docs_at_least, tokens_at_least (of documents of L tokens or more), tokens_truncated (all texts cut at L) and fit_fraction (documents of L tokens at most).

    lengths: n_tokens, n_docs, one row per length.
    """
    rows = lengths.withColumn("block", F.floor(F.col("n_tokens") / _BLOCK))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = sums.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    joined = rows.join(offsets, "block")
    docs = F.sum("n_docs").over(within) + F.col("d_after")
    tokens = F.sum(F.col("n_docs") * F.col("n_tokens")).over(within) + F.col("t_after")
    out = joined.select("n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "d_all", "t_all")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_truncated"),
        ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("fit_fraction"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """n_tokens: the smallest length that at least `share` of the documents don't exceed."""
    return sums.where(F.col("fit_fraction") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """docs_over, tokens_truncated for a context limit, whether or not a document has that very length."""
    at = sums.where(F.col("n_tokens") >= limit).agg(F.max("docs_at_least").alias("docs"), F.max("tokens_at_least").alias("tokens"))
    total = sums.agg(F.max("tokens_at_least").alias("all"), F.max("docs_at_least").alias("n"))
    return at.crossJoin(total).select(  # one row by one row
        F.coalesce("docs", F.lit(0)).alias("docs_over"),
        (F.col("all") - F.coalesce("tokens", F.lit(0)) + F.coalesce("docs", F.lit(0)) * limit).alias("tokens_truncated"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram over all documents with its suffix sums: one row per encoded length."""
    return suffix_sums(cut(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))))  # as many rows as lengths; read twice
