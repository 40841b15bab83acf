"""A prepared dataset to a fitted model and a nested report."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from anomaloom.operators.classes import class_counts, class_table, inverse_frequency_weights, with_class_weight
from anomaloom.operators.evaluation import ClassificationReport, infer_class_count
from anomaloom.operators.models import (
    evaluate_split,
    fit_classifier,
    resolve_class_names,
    select_best,
    sequence_features,
    window_features,
)
from anomaloom.operators.splits import DEFAULT_SEED, balanced_resample
from anomaloom.session import in_staging, stage
from anomaloom.sources.datasets import PAD_ID, load_split, read_dataset

#: Settings that are tried in turn, each a mapping of estimator parameters.
DEFAULT_SETTINGS = ({"regParam": 0.0}, {"regParam": 0.01}, {"regParam": 0.1})
BALANCE = ("none", "weights", "resample")


@dataclass(frozen=True)
class TrainingResult:
    """The model of the best setting, and the report that was written."""

    model: PipelineModel
    report: dict


def report_document(report: ClassificationReport, names: Sequence[str]) -> dict:
    """Summary, classes and confusion of a report in one nested document (classes squared in size)."""
    matrix = [[0] * len(names) for _ in names]
    for row in report.confusion.collect():
        matrix[row["label"]][row["prediction"]] = row["n"]
    per_class = {
        row["class_name"]: {key: row[key] for key in ("precision", "recall", "f1", "support")}
        for row in report.per_class.orderBy("class_index").collect()
    }
    summary = {row["metric"]: row["value"] for row in report.summary.collect()}
    return {**summary, "per_class": per_class, "confusion_matrix": matrix}


@in_staging
def train_and_evaluate(
    spark: SparkSession,
    dataset: str,
    output: str,
    ids: Sequence[str],
    windows: bool = False,
    settings: Sequence[Mapping] = DEFAULT_SETTINGS,
    kind: str = "logistic",
    balance: str = "none",
    class_names: Sequence[str] | None = None,
    default_names: Sequence[str] = ("Normal", "Anomaly"),
    normal_index: int = 0,
    seed: int = DEFAULT_SEED,
) -> TrainingResult:
    """Fit a classifier per setting on the train split, keep the one of the best validation macro-F1 (the
    earlier of equal ones), report it on the test split, write model and report under ``output``.

    ``dataset`` is a folder that a preparation job wrote: token-id sequences, or ``windows`` of
    feature rows. ``ids`` name its rows. ``balance``: class ``weights``, or a balanced ``resample`` of the
    train rows. Class names are those given, else the stored ones, else the default.
    """
    if balance not in BALANCE:
        raise ValueError(f"balance must be one of {BALANCE}")
    if not settings:
        raise ValueError("no setting to try")
    rows = read_dataset(spark, f"{dataset}/data")
    stored = spark.read.parquet(f"{dataset}/classes").orderBy("class_index").collect()
    n_classes = infer_class_count(rows, "y").first()[0] or 0
    names = resolve_class_names(
        class_names, [row["class_name"] for row in stored], default_names, max(n_classes, len(stored))
    )
    classes = class_table(spark, names)
    prepared = rows.select(
        F.concat_ws("/", *(F.col(name).cast("string") for name in ids)).alias("id"), "y", "split", _inputs(windows)
    )
    prepared = stage(prepared, "training")
    train, weight = _balanced(load_split(prepared, "train"), classes, balance, seed)
    stages = () if windows else sequence_features()

    history, reports, models = [], [], []
    for number, setting in enumerate(settings, start=1):
        model = fit_classifier(train, "y", stages=stages, kind=kind, weight=weight, **setting)
        val = report_document(evaluate_split(prepared, "val", model, classes, names, normal_index), names)
        history.append({"epoch": number, "setting": dict(setting), "val": val})
        reports.append((number, val["macro_f1"]))
        models.append(model)
    best = select_best(spark.createDataFrame(reports, "epoch int, macro_f1 double")).first()
    model = models[best["epoch"] - 1]
    test = report_document(evaluate_split(prepared, "test", model, classes, names, normal_index), names)
    report = {
        "best_epoch": best["epoch"],
        "best_macro_f1": best["macro_f1"],
        "class_names": names,
        "metrics": {"best_val": history[best["epoch"] - 1]["val"], "test": test, "history": history},
        "config": {"dataset": dataset, "kind": kind, "balance": balance, "normal_class_index": normal_index},
    }
    model.write().overwrite().save(f"{output}/model")
    document = spark.createDataFrame([(json.dumps(report),)], "value string")
    document.coalesce(1).write.mode("overwrite").text(f"{output}/report")
    return TrainingResult(model, report)


def _inputs(windows: bool) -> Column:
    if windows:
        return window_features(F.col("X")).alias("features")
    kept = F.filter("X", lambda token: token != PAD_ID)
    return F.transform(kept, lambda token: token.cast("string")).alias("tokens")


def _balanced(train: DataFrame, classes: DataFrame, balance: str, seed: int) -> tuple[DataFrame, str | None]:
    if balance == "none":
        return train, None
    weights = inverse_frequency_weights(class_counts(train, classes))
    if balance == "weights":
        return with_class_weight(train, weights), "weight"
    by_class = weights.select(F.col("class_index").cast("bigint").alias("y"), "weight")
    drawn = balanced_resample(train.select("id", "y"), "y", ["id"], by_class, seed=seed)
    return drawn.drop("draw").join(train.drop("y"), "id"), None
