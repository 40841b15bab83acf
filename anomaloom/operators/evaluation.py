"""Evaluation metrics as aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from anomaloom.functions.numeric import argmax, let, safe_ratio, softmax
from anomaloom.operators.joins import lookup_join
from anomaloom.operators.ranking import average_ranks, prefix_sums
from anomaloom.operators.score_counts import roc_auc_of_counts
from anomaloom.session import stage

MIN_SUPPORT = 20


def class_probabilities(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add ``probabilities`` and ``prediction`` (first maximum)."""
    scored = df.withColumn("probabilities", softmax(F.col(logits)))
    return scored.withColumn("prediction", argmax(F.col("probabilities")))


def confusion_matrix(
    df: DataFrame, n_classes: int, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``label, prediction, n`` for all pairs of classes; rows outside them are ignored."""
    pair = (F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    return filled_confusion(df.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")), n_classes)


def filled_confusion(counts: DataFrame, n_classes: int) -> DataFrame:
    """Counted pairs (``label, prediction, n``) of the classes, with zeros for those that do not occur."""
    inside = F.col("label").between(0, n_classes - 1) & F.col("prediction").between(0, n_classes - 1)
    counted = (
        counts.where(inside)
        .groupBy(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
        .agg(F.sum("n").alias("n"))
    )
    cells = counts.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("label"),
        (F.col("id") % n_classes).cast("int").alias("prediction"),
    )
    return cells.join(counted, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of right predictions over all rows; 0 without rows."""
    right = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def per_class_metrics(confusion: DataFrame, classes: DataFrame) -> DataFrame:
    """``class_index, class_name, precision, recall, f1, support`` from a confusion matrix."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")

    def side(class_index: str, real: Column, said: Column, right: Column) -> Column:
        return F.struct(
            F.col(class_index).alias("class_index"), real.alias("real"), said.alias("said"), right.alias("hit")
        )

    n = F.col("n")
    sides = confusion.select(
        F.inline(F.array(side("label", n, none, hit), side("prediction", none, n, none)))
    )
    sums = sides.groupBy("class_index").agg(
        F.sum("real").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    )
    precision = safe_ratio(F.col("hit"), F.col("said"))
    recall = safe_ratio(F.col("hit"), F.col("support"))
    rated = sums.withColumns({"precision": precision, "recall": recall})
    f1 = safe_ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.join(classes, "class_index").select(
        "class_index", "class_name", "precision", "recall", f1.alias("f1"), "support"
    )


def macro_f1(per_class: DataFrame) -> DataFrame:
    """Plain mean of F1 over all classes."""
    return per_class.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-likelihood of the label under the softmax of the logits."""

    def loss(values: Column, top: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.ln(total) + top - F.get(values, label.cast("int"))

    return let(logits, lambda values: let(F.array_max(values), lambda top: loss(values, top)))


def log_loss(df: DataFrame, logits: str = "logits", label: str = "label", weight: str | None = None) -> DataFrame:
    """Mean cross-entropy; with ``weight`` the weighted mean over all rows."""
    loss = cross_entropy(F.col(logits).cast("array<double>"), F.col(label))
    if weight is None:
        mean = F.avg(loss)
    else:
        mean = safe_ratio(F.sum(loss * F.col(weight)), F.sum(weight))
    return df.agg(F.coalesce(mean, F.lit(0.0)).alias("loss"))


def anomaly_columns(df: DataFrame, normal_index: int = 0, label: str = "label") -> DataFrame:
    """Add ``anomaly`` (0/1) and ``anomaly_score``: 1 − p(normal), or the largest probability where
    the index is no class."""
    p = F.col("probabilities")
    valid = F.lit(normal_index >= 0) & (F.lit(normal_index) < F.size(p))
    score = F.when(valid, 1.0 - F.get(p, F.lit(max(normal_index, 0)))).otherwise(F.array_max(p))
    return df.withColumns(
        {"anomaly": (F.col(label) != normal_index).cast("int"), "anomaly_score": score}
    )


def roc_auc(df: DataFrame, truth: str = "anomaly", score: str = "anomaly_score", **sizes: int) -> DataFrame:
    """Area under the ROC curve by ranks, ties averaged; null if a class is absent.

    Rows are first merged by score value, then ranked bucket by bucket.
    """
    per_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 1).alias("positives")
    )
    return roc_auc_of_counts(per_score, **sizes)


def average_precision(
    df: DataFrame, truth: str = "anomaly", score: str = "anomaly_score", order: str = "id", **sizes: int
) -> DataFrame:
    """Mean precision at each positive, by falling score, ties by ``order``; null without positives."""
    rows = df.select(
        (-F.col(score)).alias("falling"),
        F.col(order).alias("tie"),
        F.lit(1).cast("bigint").alias("one"),
        (F.col(truth) == 1).cast("bigint").alias("positive"),
    )
    running = prefix_sums(
        rows, [F.col("falling"), F.col("tie")], {"one": "seen", "positive": "found"}, **sizes
    )
    sums = running.where(F.col("positive") == 1).agg(
        F.sum(F.col("found") / F.col("seen")).alias("s"), F.count(F.lit(1)).alias("p")
    )
    return sums.select(F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))


def support_warnings(per_class: DataFrame, minimum: int = MIN_SUPPORT) -> DataFrame:
    """A warning text for every class with too few rows."""
    return per_class.where(F.col("support") < minimum).select(
        "class_index",
        F.format_string(
            "Very low support for class '%s' in evaluation split (support=%d). "
            "Metrics for this class are unstable.",
            "class_name",
            "support",
        ).alias("warning"),
    )


def infer_class_count(df: DataFrame, label: str = "label") -> DataFrame:
    """``n_classes``: largest label + 1."""
    return df.agg((F.max(label) + 1).cast("int").alias("n_classes"))


def default_class_names(df: DataFrame) -> DataFrame:
    """``class_index, class_name`` with names class_0, class_1, … for an ``n_classes`` row."""
    return df.select(F.explode(F.sequence(F.lit(0), F.col("n_classes") - 1)).alias("class_index")).select(
        "class_index", F.concat(F.lit("class_"), F.col("class_index").cast("string")).alias("class_name")
    )


def dataset_summary(df: DataFrame, split: str = "split", label: str = "y") -> DataFrame:
    """Rows per split and class, and per split."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("split_size", F.sum("n").over(Window.partitionBy(split)))


@dataclass(frozen=True)
class ClassificationReport:
    """Summary (``metric, value``), per-class table and confusion matrix."""

    summary: DataFrame
    per_class: DataFrame
    confusion: DataFrame


def classification_report(
    df: DataFrame,
    classes: DataFrame,
    n_classes: int,
    normal_index: int = 0,
    label: str = "label",
    logits: str = "logits",
    order: str = "id",
) -> ClassificationReport:
    """All metrics of labelled logits (``order`` breaks ties of the average precision).

    The model behind the logits runs once: its thin output is staged. Loss, accuracy and confusion come
    from one pass, grouped by class pair; the ranks from the two others.
    """
    scored = anomaly_columns(class_probabilities(df, logits), normal_index, label)
    loss = cross_entropy(F.col(logits).cast("array<double>"), F.col(label))
    thin = stage(
        scored.select(
            F.col(order).alias("id"), F.col(label).alias("label"), "prediction", loss.alias("loss"), "anomaly", "anomaly_score"
        ),
        "scored",
    )
    cells = stage(
        thin.groupBy("label", "prediction").agg(
            F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.count("loss").alias("losses")
        ),
        "cells",
    )
    confusion = filled_confusion(cells, n_classes)
    per_class = per_class_metrics(confusion, classes)
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    parts = (
        cells.agg(F.coalesce(safe_ratio(F.sum("loss"), F.sum("losses")), F.lit(0.0)).alias("loss")),
        cells.agg(F.coalesce(safe_ratio(right, F.sum("n")), F.lit(0.0)).alias("accuracy")),
        macro_f1(per_class),
        roc_auc(thin),
        average_precision(thin),
    )
    summary = reduce(DataFrame.unionByName, (_as_metric(part) for part in parts))
    return ClassificationReport(summary, per_class, confusion)


def _as_metric(one_row: DataFrame) -> DataFrame:
    name = one_row.columns[0]
    return one_row.select(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))


def with_average_rank(df: DataFrame, value: str, output: str = "avg_rank") -> DataFrame:
    """Rows with the average rank of their value; a frequent value is no hot join key."""
    return lookup_join(df, average_ranks(df, value, output).drop("n"), [value], "inner")
