"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs between white space and ASCII signs. A text's features are its
distinct words, word beginnings (four bytes), word pairs and pairs with one word left out, hashed
to 2**bits places. FTRL-proximal
(McMahan et al., "Ad click prediction: a view from the trenches", KDD 2013) keeps a learning rate
for each coordinate, and its L1 term leaves most weights at exactly zero, so what goes to the
executors is a short list of places and weights (8 MB at most, for 2**20 places).

The fit reads a bounded sample of labelled rows (`Settings.rows` of each class at most, those with
the smallest hash of doc_id) in one task. Scoring is one pass over all documents without a shuffle.

Defined cases: a null or empty text has the score of the bias alone; a null doc_id is scored and
never learnt from; contradicting labels of a doc_id count as toxic; repeated rows are scored each;
with no labelled rows, or none toxic, every score is the bias's. Columns other than those named
here are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Words, mix, text_slices


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Labelled rows of each class that the fit reads at most.
    rows: int = 9_000
    epochs: int = 3
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    #: Features in fewer of the sample's texts are left out of the fit.
    least_texts: int = 10


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def places(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of every feature occurrence and the row of its text, in no order."""
    w = Words(pc.utf8_lower(texts.fill_null("")), signs_divide=True)
    rows, found = [w.doc, w.doc], [mix(w.hash), w.prefixes(4)]
    for gap, salt in ((1, 0x51), (2, 0x52)):
        same = w.doc[gap:] == w.doc[:-gap] if len(w.doc) > gap else np.zeros(0, bool)
        rows.append(w.doc[: len(same)][same])
        found.append(mix(w.hash[: len(same)][same] * np.uint64(0x9FB21C651E98DF25) + w.hash[gap:][same] + np.uint64(salt)) if len(same) else np.zeros(0, np.uint64))
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def fit_arrays(texts: list[np.ndarray], toxic: np.ndarray, settings: Settings) -> Model:
    """FTRL-proximal over texts given as arrays of distinct places."""
    size = 1 << settings.bits
    seen = np.zeros(size, np.int32)
    for x in texts:
        seen[x] += 1
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(7)
    kept = [np.append(x[seen[x] >= settings.least_texts], size) for x in texts]
    for _ in range(settings.epochs):
        for i in rng.permutation(len(kept)):
            x = kept[i]
            zx, nx = z[x], n[x]
            wx = np.where(np.abs(zx) <= settings.l1, 0.0, -(zx - np.sign(zx) * settings.l1) / ((settings.beta + np.sqrt(nx)) / settings.alpha + settings.l2))
            wx[-1] = -zx[-1] / ((settings.beta + np.sqrt(nx[-1])) / settings.alpha)  # the bias has no penalty
            g = 1 / (1 + np.exp(-np.clip(wx.sum(), -35, 35))) - toxic[i]
            root = (np.sqrt(nx + g * g) - np.sqrt(nx)) / settings.alpha
            z[x] = zx + g - root * wx
            n[x] = nx + g * g
    w = np.where(np.abs(z) <= settings.l1, 0.0, -(z - np.sign(z) * settings.l1) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2))
    bias = float(-z[-1] / ((settings.beta + np.sqrt(n[-1])) / settings.alpha)) if len(texts) else -3.0
    found = np.flatnonzero(w[:-1])
    return Model(found.astype(np.int32), w[found].astype(np.float32), bias, settings.bits)


def score_arrays(texts: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    """Scores of texts; `table` has the model's weights by place."""
    out = np.full(len(texts), model.bias)
    for first, part in text_slices(texts):
        at, row = places(part, model.bits)
        hit = table[at] != 0
        pair = np.unique(row[hit] << model.bits | at[hit])  # each feature counts once a text
        np.add.at(out, first + (pair >> model.bits), table[pair & ((1 << model.bits) - 1)])
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of `labels.toxic` from texts of `documents`. labels: doc_id, toxic; every row given may be learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order).limit(settings.rows).unionByName(known.where("toxic = 0").orderBy(order).limit(settings.rows))
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")  # at most 2 * settings.rows numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch["text"]):
                at, row = places(part, settings.bits)
                pair = np.unique(row << settings.bits | at)
                ends = np.searchsorted(pair >> settings.bits, np.arange(len(part) + 1))
                own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pair & ((1 << settings.bits) - 1), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(part)), batch["toxic"].slice(first, len(part)), own], ["doc_id", "toxic", "places"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("places", pa.list_(pa.int32()))]))
        table = table.sort_by("doc_id")  # the same order however rows came
        if not table.num_rows:
            return
        texts = [x.values.to_numpy()[0:] for chunk in table["places"].chunks for x in chunk]
        model = fit_arrays(texts, table["toxic"].to_numpy(), settings)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.places, -1), pa.int32()), pa.array(np.append(model.weights, model.bias), pa.float64())], ["place", "weight"])

    learnt = rows.mapInArrow(features, "doc_id bigint, toxic int, places array<int>").repartition(1).mapInArrow(train, "place int, weight double").toPandas()  # 2**bits + 1 rows at most
    inner = learnt[learnt.place >= 0].sort_values("place")
    bias = learnt[learnt.place < 0].weight
    return Model(inner.place.to_numpy(np.int32), inner.weight.to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else -3.0, settings.bits)


def _scored(batches: Iterator[pa.RecordBatch], shared, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    model = shared.value
    table = np.zeros(1 << model.bits, np.float32)
    table[model.places] = model.weights
    for batch in batches:
        yield batch, score_arrays(batch[column], model, table)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, s in _scored(batches, shared, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s)], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def reject(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `documents`, all columns, whose score is under the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, s in _scored(batches, shared, "text"):
            yield batch.filter(pa.array(s < threshold))

    return documents.mapInArrow(run, documents.schema)


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows whose crc32(doc_id) mod 4 is 2 are never learnt from."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out())
    model = fit(documents, labels)
    return score(documents, model).select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
