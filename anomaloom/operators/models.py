"""Classifiers on Spark ML: features, fit, score, evaluate, select."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.feature import IDF, HashingTF, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from anomaloom.functions.batches import array_column, regular_windows
from anomaloom.functions.numeric import argmax, clamp_score, let, softmax
from anomaloom.operators.evaluation import ClassificationReport, classification_report
from anomaloom.sources.datasets import load_split

NORMAL_NAMES = ("Benign", "Normal")


def sequence_features(
    tokens: str = "tokens", output: str = "features", buckets: int = 4096, bigrams: bool = True
) -> list[Transformer | Estimator]:
    """Stages from a token array to weighted counts of tokens (and neighbour pairs)."""
    stages: list[Transformer | Estimator] = [HashingTF(inputCol=tokens, outputCol="__tf1", numFeatures=buckets)]
    parts = ["__tf1"]
    if bigrams:
        stages += [
            NGram(n=2, inputCol=tokens, outputCol="__pairs"),
            HashingTF(inputCol="__pairs", outputCol="__tf2", numFeatures=buckets),
        ]
        parts.append("__tf2")
    return [
        *stages,
        VectorAssembler(inputCols=parts, outputCol="__tf"),
        IDF(inputCol="__tf", outputCol=output),
        SQLTransformer(statement="SELECT * EXCEPT(__tf1, __tf" + (", __tf2, __pairs" if bigrams else "") + ") FROM __THIS__"),
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def _regular_features(windows: pa.Array) -> pa.Array:
    """The values of :func:`window_features` for the regular windows of a batch, null for the others."""
    at, x = regular_windows(windows)
    if not len(at):
        return pa.nulls(len(windows), pa.list_(pa.float64()))
    # Rows are added one after the other, as the expressions do.
    total, squares = np.zeros((2, len(at), x.shape[2]))
    with np.errstate(all="ignore"):
        for t in range(x.shape[1]):
            total += x[:, t]
        mean = total / x.shape[1]
        for t in range(x.shape[1]):
            gap = x[:, t] - mean
            squares += gap * gap
        parts = [mean, np.sqrt(squares / x.shape[1]), x[:, -1], x[:, -1] - x[:, 0]]
    return array_column(len(windows), at, np.concatenate(parts, axis=1))


def window_features(window: Column) -> Column:
    """Vector of a window (array of feature arrays): mean, deviation, last value and last minus
    first, per feature.

    Windows of a batch are computed side by side; those with nulls or of another shape than the
    batch's first one are left to expressions, with the same results.
    """
    n = F.size(window).cast("double")
    first, last = F.element_at(window, 1), F.element_at(window, -1)
    zeros = F.transform(first, lambda _: F.lit(0.0))
    total = F.aggregate(window, zeros, lambda acc, row: F.zip_with(acc, row, lambda a, x: a + x))

    def around(mean: Column) -> Column:
        def add(acc: Column, row: Column) -> Column:
            gaps = F.zip_with(row, mean, lambda x, m: (x - m) * (x - m))
            return F.zip_with(acc, gaps, lambda a, gap: a + gap)

        deviation = F.transform(F.aggregate(window, zeros, add), lambda s: F.sqrt(s / n))
        change = F.zip_with(last, first, lambda z, a: (z - a).cast("double"))
        return F.concat(mean, deviation, last.cast("array<double>"), change)

    plain = let(F.transform(total, lambda t: t / n), around)
    return array_to_vector(F.coalesce(_regular_features(window), plain))


def fit_classifier(
    train: DataFrame,
    label: str = "y",
    features: str = "features",
    stages: Sequence[Transformer | Estimator] = (),
    kind: str = "logistic",
    weight: str | None = None,
    **params,
) -> PipelineModel:
    """Fit ``logistic`` (default), ``boosted`` trees (one against the rest for several classes) or a
    ``perceptron`` (needs ``layers``) on labelled rows, weighted by a column if given."""
    columns = {"labelCol": label, "featuresCol": features}
    weights = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        estimator = LogisticRegression(**columns, **weights, **params)
    elif kind == "boosted":
        trees = GBTClassifier(**columns, **weights, **params)
        estimator = OneVsRest(classifier=trees, **columns, **weights)
    elif kind == "perceptron":
        if weight:
            raise ValueError("the perceptron takes no weights; use balanced_resample")
        estimator = MultilayerPerceptronClassifier(**columns, **params)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    return Pipeline(stages=[*stages, estimator]).fit(train)


def prediction_column(probabilities: Column, class_names: Sequence[str], expert: str) -> Column:
    """Prediction struct: class of the first maximum, its probability, anomaly score, all
    probabilities by name. The anomaly score is 1 − p(Benign or Normal), else the largest p."""
    names = F.array(*(F.lit(name) for name in class_names))
    normal = [name for name in NORMAL_NAMES if name in class_names]
    top = F.array_max(probabilities)
    if normal:
        score = 1.0 - F.get(probabilities, F.lit(list(class_names).index(normal[0])))
    else:
        score = top
    return F.struct(
        F.lit(expert).alias("expert_name"),
        clamp_score(score).alias("anomaly_score"),
        F.get(names, argmax(probabilities)).alias("predicted_class"),
        top.alias("confidence"),
        F.map_from_arrays(names, probabilities).alias("class_probabilities"),
    )


def score(
    df: DataFrame, model: PipelineModel, class_names: Sequence[str], expert: str = "system_expert"
) -> DataFrame:
    """Add the ``prediction`` struct of a fitted model."""
    columns = df.columns
    scored = model.transform(df)
    probabilities = vector_to_array("probability")
    return scored.select(*columns, prediction_column(probabilities, class_names, expert).alias("prediction"))


def score_external(
    df: DataFrame,
    predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    inputs: str,
    shape: Sequence[int],
    class_names: Sequence[str],
    expert: str = "external_expert",
    batch_size: int = 512,
) -> DataFrame:
    """Add the ``prediction`` struct of a user model: ``predict`` builds, once per worker, a function
    from a batch of arrays of ``shape`` to a batch of logits."""
    run = predict_batch_udf(
        predict, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )
    scored = df.withColumn("__p", softmax(run(F.col(inputs))))
    return scored.select(*df.columns, prediction_column(F.col("__p"), class_names, expert).alias("prediction"))


def model_logits(df: DataFrame, model: PipelineModel, output: str = "logits") -> DataFrame:
    """Add the raw scores of a fitted model; their softmax is its probability."""
    scored = model.transform(df)
    p = vector_to_array("probability")
    return scored.select(*df.columns, F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(1e-300)))).alias(output))


def evaluate_split(
    dataset: DataFrame,
    split: str,
    model: PipelineModel,
    classes: DataFrame,
    class_names: Sequence[str],
    normal_index: int = 0,
    label: str = "y",
    order: str = "id",
) -> ClassificationReport:
    """Report of a fitted model on one split."""
    rows = model_logits(load_split(dataset, split), model)
    return classification_report(rows, classes, len(class_names), normal_index, label, "logits", order)


def select_best(reports: DataFrame, metric: str = "macro_f1", epoch: str = "epoch") -> DataFrame:
    """The report with the best metric, the earliest on ties."""
    best = F.max_by(F.struct("*"), F.struct(F.col(metric), -F.col(epoch)))
    return reports.agg(best.alias("best")).select("best.*")


def search_classifier(
    train: DataFrame,
    label: str = "y",
    features: str = "features",
    regularisation: Sequence[float] = (0.0, 0.01, 0.1),
    train_ratio: float = 0.85,
    seed: int = 42,
):
    """Logistic regression with the regularisation of the best F1 on held-out rows."""
    estimator = LogisticRegression(labelCol=label, featuresCol=features)
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(regularisation)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    search = TrainValidationSplit(
        estimator=estimator, estimatorParamMaps=grid, evaluator=judge, trainRatio=train_ratio, seed=seed
    )
    return search.fit(train)


def resolve_class_names(
    explicit: Sequence[str] | None,
    stored: Sequence[str],
    default: Sequence[str],
    n_classes: int | None = None,
) -> list[str]:
    """Explicit names, else the stored ones, else the default; numbered names where the default does
    not fit the class count, an error where the others do not."""
    own = explicit is not None or bool(stored)
    names = list(explicit if explicit is not None else stored or default)
    if n_classes is None or n_classes <= 0 or len(names) == n_classes:
        return names
    if own:
        raise ValueError(f"{len(names)} class names for a model of {n_classes} classes")
    return [f"class_{index}" for index in range(n_classes)]


def normal_class_name(class_names: Sequence[str], normal_index: int) -> str:
    if 0 <= normal_index < len(class_names):
        return class_names[normal_index]
    return "Normal" if "Normal" in class_names or not class_names else class_names[0]
