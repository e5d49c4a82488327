"""Toxicity scores: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Training uses a bounded, deterministic sample of the labelled rows (``class_rows`` of either class at
most, by a hash of the id), with whole texts; it is joined by broadcast, about half a megabyte. FTRL
learns row after row, so one task sees that sample, as sets of feature slots made by all tasks. They come
in order out of a sorted shuffle, once for each epoch, so the task holds one batch of rows and the model.
Per-coordinate rates learn rare words fast and L1 leaves few weights: the vector has ``2 ** BITS``
slots at most (4 MB), which bounds the broadcast. Scoring reads every whole text and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import bound_batches, forget, fresh, id_fold, text_or_empty, word_hashes, words
from gridloom.llm.lm import mix

BITS = 20
#: Words between the two of a skip-gram, at most.
SKIP = 2
#: Labelled rows of each class that are learnt from, at most.
CLASS_ROWS = 8_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1


def features(ws: list[bytes]) -> np.ndarray:
    """Distinct slots of a text's words, bigrams and skip-grams, slot 0 (the bias) first."""
    h = np.fromiter(map(word_hashes.__getitem__, ws), np.uint64, len(ws))
    grams = [h] + [mix(h[: -1 - k], h[1 + k :] + np.uint64(k)) for k in range(SKIP + 1) if len(h) > 1 + k]
    slots = np.unique(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([[0], slots[slots > 0]])


class Ftrl:
    """Per-coordinate FTRL-proximal: ``z`` gathers gradients, ``n`` their squares."""

    def __init__(self, size: int = 1 << BITS) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = sigmoid(float(w.sum())) - label
        more = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = more


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -60.0), 60.0)))


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, class_rows: int = CLASS_ROWS) -> np.ndarray:
    """Weights from labelled rows whose id's crc32 is no multiple of ``parts``; zeros without any."""
    named = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
    usable = named.where(id_fold(F.col("doc_id"), parts) != 0)
    by_class = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows) for k in (0.0, 1.0)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    rows = texts.join(F.broadcast(by_class[0].unionByName(by_class[1])), "doc_id")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes)
        for b in batches:
            found = [features(words(x)).astype("<i4").tobytes() for x in b.column("text").to_pylist()]
            turns = [hash_turn(x) for x in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int64()), b.column("doc_id"), b.column("label"), pa.array(found, pa.binary())], ["turn", "doc_id", "label", "slots"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for b in batches:
            for at, label in zip(b.column("slots").to_pylist(), b.column("label").to_pylist()):
                model.learn(np.frombuffer(at, "<i4"), label)
        w = model.weights()
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used])], ["slot", "w"])

    found = rows.select("doc_id", "label", "text").mapInArrow(slots, "turn long, doc_id long, label double, slots binary")
    epochs = found.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", "turn", "doc_id", "slots")  # a bounded sample
    fitted = ordered.select("slots", "label").mapInArrow(fit, "slot long, w double").toPandas()
    out = np.zeros(1 << BITS, np.float32)
    out[fitted["slot"].to_numpy(np.int64)] = fitted["w"].to_numpy()
    return out


def hash_turn(doc_id: int) -> int:
    """A fixed shuffle of the training order, as a signed number."""
    return ((doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with the score in [0, 1] as column ``name``, which it must not have; null text is empty."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes)
        w = shared.value
        for b in batches:
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            got = [sigmoid(float(w[features(words(x))].sum(dtype=np.float64))) for x in text]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5 after learning from ``labels``; all columns, whatever their names.

    Null and empty texts score the bias alone; rows that repeat an id, or are equal, are scored each; an
    empty table stays empty. A model that has learnt nothing (no labels) rejects nothing.
    """
    weights = train(docs, labels)
    if not weights.any():
        return docs
    name = fresh("score", docs.columns)
    return score(docs, weights, name).where(F.col(name) < 0.5).drop(name)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Rows without a text score the bias alone. Repeated ids are scored each; an id labelled twice
    counts as toxic if either label is. Null ids are scored and never learnt from.
    """
    weights = train(docs, labels)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), text_or_empty(F.col("text")).alias("text"))
    return score(src, weights).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
