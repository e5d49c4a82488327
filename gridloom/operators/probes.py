"""Probes on frozen embeddings and the evaluation protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.pixels import clipped_sigmoid
from gridloom.operators.evaluation import best_threshold, binary_metrics, ranking_metrics

#: Hidden layers of the perceptron probes by name.
HIDDEN = {"mlp": [128], "mlp2": [128, 64], "wide": [256, 128]}


def fit_probe(rows: DataFrame, kind: str = "linear", seed: int = 7):
    """A classifier on (features array<double>, label 0/1); the perceptrons have sigmoid units and no dropout."""
    data = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    if kind == "linear":
        return LogisticRegression(maxIter=100, regParam=1e-4).fit(data)
    dims = len(data.first()["features"])
    return MultilayerPerceptronClassifier(layers=[dims, *HIDDEN[kind], 2], seed=seed, maxIter=100).fit(data)


def scored(model, rows: DataFrame) -> DataFrame:
    """Rows with ``score``, the positive class's probability, and ``logit``."""
    out = model.transform(rows.withColumn("features", array_to_vector("features")))
    p = F.get(vector_to_array("probability"), F.lit(1))
    clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return out.withColumn("score", p).withColumn("logit", F.log(clipped / (1 - clipped))).drop("features", "rawPrediction", "probability", "prediction")


def weights_of(model) -> tuple[list[float], float]:
    """Weights and bias of a linear probe, to be kept or applied elsewhere."""
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def linear_scored(rows: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """Rows with ``logit`` and ``score`` of a linear probe with the given weights; features of another length are an error."""
    product = F.aggregate(F.zip_with("features", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda a, t: a + t)
    size = F.raise_error(F.concat(F.lit(f"features of {len(weights)} values expected, not "), F.size("features").cast("string"))).cast("double")
    return rows.withColumn("logit", F.when(F.size("features") == len(weights), product + bias).otherwise(size)).withColumn("score", clipped_sigmoid(F.col("logit")))


def evaluate(rows: DataFrame, kind: str = "linear", seed: int = 7) -> DataFrame:
    """One row: fit on the train split, threshold on val, metrics on test. ``rows``: features, label, split."""
    model = fit_probe(rows.where("split = 'train'"), kind, seed)
    found = scored(model, rows.where("split <> 'train'"))
    threshold = best_threshold(found.where("split = 'val'")).first()["threshold"]
    test = found.where("split = 'test'")
    return binary_metrics(test, threshold).crossJoin(ranking_metrics(test)).withColumn("threshold", F.lit(threshold))  # one-row reports


def encoded(tiles: DataFrame, make_encoder: Callable[[], Callable], dims: int) -> DataFrame:
    """(patch_id, month, embedding, problem) from a caller's encoder, loaded once per task.

    ``make_encoder`` returns a function: list of value arrays -> array (n, dims).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = make_encoder()
        for pdf in batches:
            out = np.asarray(encode(pdf["values"].to_list()), dtype=float)
            if out.shape != (len(pdf), dims):
                raise ValueError(f"encoder returned {out.shape}, expected {(len(pdf), dims)}")
            yield pd.DataFrame({"patch_id": pdf["patch_id"], "month": pdf["month"], "embedding": list(out), "problem": [None if np.isfinite(x).all() else "not_finite" for x in out]})

    kind = tiles.schema["patch_id"].dataType.simpleString()
    return tiles.select("patch_id", "month", "values").mapInPandas(run, f"patch_id {kind}, month int, embedding array<double>, problem string")
