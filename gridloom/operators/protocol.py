"""The evaluation protocol: a probe is bound to what it was learnt on, and scores nothing else.

Training takes one fold, its few-shot patches, learns the probe, chooses the threshold on the validation split and stores
with the model the digests of data, labels, fold and training patches. Scoring takes the digests of what it is
given first; where one differs it refuses and names it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.evaluation import best_threshold, binary_metrics, positive_patches, ranking_metrics
from gridloom.operators.membership import content_digest
from gridloom.operators.probes import fit_probe, scored
from gridloom.operators.sampling import few_shot
from gridloom.sources.records import load_fold

VERSION = 1
#: What is compared before scoring.
BOUND = ("dataset", "labels", "folds", "training_patches")
STATE = "version int, kind string, fold int, shot int, seed int, threshold double, threshold_source string, train_patches long, " + ", ".join(f"{n} string" for n in BOUND)


class IdentityError(ValueError):
    """Inputs are not those that a probe was learnt on; ``names`` says which."""

    def __init__(self, names: list[str]) -> None:
        super().__init__(f"not what the probe was learnt on: {', '.join(names)}")
        self.names = names


def training_patches(rows: DataFrame, members: DataFrame, fold: int, shot: int | None, seed: int) -> DataFrame:
    """(patch_id) of the train split: all, or ``shot`` positive and as many negative ones by hash."""
    train = members.where("split = 'train'").select("patch_id")
    if shot is None:
        return train
    return few_shot(positive_patches(rows.join(train, "patch_id", "left_semi")), fold, seed, shot).select("patch_id")


def members_of(rows: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """The fold's (fold, split, patch_id); patches without a row or in two splits are an error."""
    members = load_fold(folds, fold)
    absent = members.join(rows.select("patch_id").distinct(), "patch_id", "left_anti")
    if (missing := absent.first()) is not None:
        raise ValueError(f"fold {fold} names patch {missing['patch_id']}, which has no rows")
    twice = members.groupBy("patch_id").agg(F.count_distinct("split").alias("n")).where("n > 1")
    if (leak := twice.first()) is not None:
        raise ValueError(f"patch {leak['patch_id']} is in two splits of fold {fold}")
    return members


def fingerprints(rows: DataFrame, members: DataFrame, chosen: DataFrame) -> dict[str, str]:
    """SHA-256 of each bound input, independent of the order of its rows. ``rows``: patch_id, pixel, features, label."""
    parts = {"dataset": (rows, ["patch_id", "pixel", "features"]), "labels": (rows, ["patch_id", "pixel", "label"]), "folds": (members, ["fold", "split", "patch_id"]), "training_patches": (chosen, ["patch_id"])}
    return {name: content_digest(df, columns).first()["digest"] for name, (df, columns) in parts.items()}


def train(rows: DataFrame, folds: DataFrame, fold: int, root: str, shot: int | None = None, seed: int = 7, kind: str = "linear") -> None:
    """Learns a probe and writes it with its state under ``root``, which must be new; the state comes last."""
    spark = rows.sparkSession
    members = members_of(rows, folds, fold)
    chosen = training_patches(rows, members, fold, shot, seed)
    model = fit_probe(rows.join(chosen, "patch_id", "left_semi"), kind, seed)
    validation = scored(model, rows.join(members.where("split = 'val'").select("patch_id"), "patch_id", "left_semi"))
    threshold = float(best_threshold(validation).first()["threshold"])
    model.write().save(f"{root}/model")
    state = (VERSION, kind, fold, shot, seed, threshold, "validation", chosen.count(), *[fingerprints(rows, members, chosen)[n] for n in BOUND])
    spark.createDataFrame([state], STATE).coalesce(1).write.mode("errorifexists").json(f"{root}/state")


def evaluate(rows: DataFrame, folds: DataFrame, root: str) -> DataFrame:
    """One row: metrics of the test split at the stored threshold, with fold, shot, training patches and test rows.

    All digests are taken from ``rows`` and ``folds`` and compared with the stored ones before anything is scored.
    """
    spark = rows.sparkSession
    state = spark.read.schema(STATE).json(f"{root}/state").first()
    if state is None or state["version"] != VERSION or state["threshold_source"] != "validation":
        raise ValueError(f"no probe of this protocol under {root}")
    members = members_of(rows, folds, state["fold"])
    chosen = training_patches(rows, members, state["fold"], state["shot"], state["seed"])
    now = fingerprints(rows, members, chosen)
    if wrong := [n for n in BOUND if now[n] != state[n]]:
        raise IdentityError(wrong)
    loader = LogisticRegressionModel if state["kind"] == "linear" else MultilayerPerceptronClassificationModel
    test = scored(loader.load(f"{root}/model"), rows.join(members.where("split = 'test'").select("patch_id"), "patch_id", "left_semi"))
    counted = test.agg(F.count(F.lit(1)).alias("test_rows"))
    report = binary_metrics(test, state["threshold"]).crossJoin(ranking_metrics(test)).crossJoin(counted)  # one-row reports
    told = {k: F.lit(state[k]).cast("int" if k in ("fold", "shot") else "long" if k == "train_patches" else "string") for k in ("fold", "shot", "train_patches", "labels", "folds")}
    return report.withColumns({"threshold": F.lit(state["threshold"]), **told})
