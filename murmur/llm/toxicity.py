"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import bounded_batches, unused

BITS = 20  # size of the feature space: a dense weight table is 4 MB
MEMO_WORDS = 200_000
EPOCHS = 3  # times that each row is learnt from
# Letters, digits and everything beyond ASCII make words; A-Z are lower-cased.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class WordHashes(dict):
    """Hashes of words, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh32_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def features(data: bytes | None, memo: WordHashes, bits: int = BITS) -> np.ndarray:
    """The distinct hashed features of a text: words, pairs, pairs with one word skipped."""
    words = (data or b"").translate(_TABLE).split()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    skips = h[:-2] * np.uint64(0xC2B2AE3D) + h[2:] * np.uint64(0x27D4EB2F) + np.uint64(2)
    every = np.concatenate([h * np.uint64(0x165667B1), pairs, skips])
    every ^= every >> np.uint64(29)
    return np.unique((every & np.uint64((1 << bits) - 1)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """Sparse weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits, np.float32)
        table[self.index] = self.weight
        return table


def fit(rows: Iterable[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0,
        l1: float = 4.0, l2: float = 0.1, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal: each coordinate has its own learning rate, and L1 keeps small ones at zero.

    With one epoch ``rows`` may be a stream, of which only the row at hand is held. The last coordinate is the bias, which is not held down by L1. No rows give a model
    that scores everything 0.5.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    shrink = np.full(z.size, l1)
    shrink[bias] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        value = z[i]
        return np.where(
            np.abs(value) <= shrink[i], 0.0,
            -(value - np.sign(value) * shrink[i]) / ((beta + np.sqrt(n[i])) / alpha + l2),
        )

    for active, label in chain.from_iterable(repeat(rows, epochs)):
        i = np.append(active, bias)
        w = weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
        z[i] += g - sigma * w
        n[i] += g * g
    every = weights(np.arange(z.size))
    index = np.flatnonzero(every[:-1])
    return Model(index.astype(np.int32), every[index].astype(np.float32), float(every[-1]), bits)


def train(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = 16_384,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest hash of their id.

    Only rows for which ``learn`` (a condition on the id column) holds are used. The texts stay
    in the executors: one task reads the features of the bounded sample, once for each epoch in a sort that
    Spark spills if need be, and returns the weights that are not zero. It holds the tables of the
    fit and one batch, at most 4 MB a row, however long the texts are. Rows with a null id, text or label are not learnt from; an
    id with labels that contradict each other is learnt from as toxic.
    """
    spark = docs.sparkSession
    key = F.col("_id")
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    named = named.where(learn) if learn is not None else named
    chosen = (
        named.groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(key), key).limit(max_rows)
    )
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).dropna()
        .join(F.broadcast(chosen), "_id")  # max_rows ids and labels at most
        .groupBy("_id", "label").agg(F.min("text").alias("text")).select("_id", "text", "label")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [features(t, memo).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["_id", "label", "active"])

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit((
            (np.frombuffer(active, np.int32), label)
            for batch in batches
            for active, label in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
        ), epochs=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.index.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.bias])],
            ["index", "weight", "bias"])

    bounded_batches(spark)
    id_type = dict(rows.dtypes)["_id"]
    found = rows.select("_id", "text", "label").mapInArrow(extract, f"_id {id_type}, label int, active binary")
    epochs = F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch")  # after the shuffle, which moves each row once
    fitted = (
        found.repartition(1).select("*", epochs).sortWithinPartitions("epoch", F.xxhash64(key), key).select("label", "active")
        .mapInArrow(learn_all, "index binary, weight binary, bias double").collect()
    )
    if not fitted:
        return fit([])
    row = fitted[0]
    return Model(np.frombuffer(row["index"], np.int32), np.frombuffer(row["weight"], np.float32), row["bias"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, score)`` for every row, from its whole text; ``keep`` names columns to add.

    A null or blank text has no features and gets the bias alone. Rows may repeat, ids may be
    null, an empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2^20 weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, memo = shared.value.dense(), shared.value.bias, WordHashes()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            sums = np.array([weights[features(t, memo)].sum(dtype=np.float64) for t in texts]) + bias
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*names, "score"])

    bounded_batches(spark)
    [own] = unused(docs, "_scored")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(keep or []), F.col(text).cast("string").alias(own))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(scan, f"{schema}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents scored below the threshold, with all their columns, whatever their names.

    A null or blank text is judged by the bias alone. Rows may repeat and ids be null: each row is judged
    by its own text. An empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, memo = shared.value.dense(), shared.value.bias, WordHashes()
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            sums = np.array([weights[features(t, memo)].sum(dtype=np.float64) for t in texts]) + bias
            yield batch.filter(pa.array(sums < limit))

    bounded_batches(spark)
    return docs.mapInArrow(scan, docs.schema)
