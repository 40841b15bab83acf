import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from anomaloom.functions import numeric
from anomaloom.operators import classes, evaluation, models

LOGITS = [[3.0, 1.0, 0.2], [0.2, 2.5, 1.0], [0.1, 0.5, 2.2], [2.4, 0.3, 0.2]]
NAMES = ["Normal", "AttackA", "AttackB"]


@pytest.fixture(scope="module")
def rows(spark):
    data = list(zip(range(4), [0, 1, 2, 0], LOGITS))
    return spark.createDataFrame(data, "id int, label int, logits array<double>")


def test_report(spark, rows):
    report = evaluation.classification_report(rows, classes.class_table(spark, NAMES), 3)
    values = {r.metric: r.value for r in report.summary.collect()}
    p = np.exp(LOGITS) / np.exp(LOGITS).sum(axis=1, keepdims=True)
    assert values["loss"] == pytest.approx(-np.log(p[range(4), [0, 1, 2, 0]]).mean())
    assert values["accuracy"] == values["macro_f1"] == values["roc_auc"] == values["average_precision"] == 1.0
    assert report.per_class.count() == 3 and report.confusion.count() == 9


def test_published_confusion_matrix(spark):
    cells = spark.createDataFrame([(0, 0, 83723), (0, 1, 11), (1, 0, 18), (1, 1, 2509)], "label int, prediction int, n bigint")
    rated = evaluation.per_class_metrics(cells, classes.class_table(spark, ["Normal", "Anomaly"]))
    got = {r.class_name: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.support) for r in rated.collect()}
    assert got == {"Normal": (0.999785, 0.999869, 0.999827, 83734), "Anomaly": (0.995635, 0.992877, 0.994254, 2527)}
    assert round(evaluation.macro_f1(rated).first()[0], 6) == 0.997040
    assert evaluation.support_warnings(rated).count() == 0


def test_rows_outside_the_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (7, 1), (1, 0)], "label int, prediction int")
    cells = {(r.label, r.prediction): r.n for r in evaluation.confusion_matrix(df, 3).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 2 and cells[0, 0] == cells[1, 0] == 1
    assert evaluation.accuracy(df).first()[0] == 0.25
    assert evaluation.accuracy(df.limit(0)).first()[0] == 0.0
    rated = evaluation.per_class_metrics(evaluation.confusion_matrix(df, 3), classes.class_table(spark, NAMES))
    empty = rated.where("class_index = 2").first()
    assert (empty.precision, empty.recall, empty.f1, empty.support) == (0.0, 0.0, 0.0, 0)
    text = evaluation.support_warnings(rated).where("class_index = 2").first().warning
    assert text == (
        "Very low support for class 'AttackB' in evaluation split (support=0). Metrics for this class are unstable."
    )


def test_softmax_of_large_values(spark):
    got = spark.range(1).select(numeric.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert got == [0.5, 0.5]
    first = spark.range(1).select(numeric.argmax(F.array(F.lit(0.4), F.lit(0.6), F.lit(0.6)))).first()[0]
    assert first == 1


def test_weighted_loss(rows):
    weighted = rows.withColumn("w", F.when(F.col("label") == 0, 3.0).otherwise(1.0))
    p = np.exp(LOGITS) / np.exp(LOGITS).sum(axis=1, keepdims=True)
    loss = -np.log(p[range(4), [0, 1, 2, 0]])
    w = np.array([3, 1, 1, 3])
    assert evaluation.log_loss(weighted, weight="w").first()[0] == pytest.approx((loss * w).sum() / w.sum())


def test_anomaly_score_without_normal_class(rows):
    scored = evaluation.anomaly_columns(evaluation.class_probabilities(rows), -1).first()
    assert scored.anomaly == 1 and scored.anomaly_score == max(scored.probabilities)


def test_prediction_struct(spark):
    p = F.array(F.lit(0.3), F.lit(0.5), F.lit(0.2))

    def predicted(names):
        return spark.range(1).select(models.prediction_column(p, names, "x").alias("p")).first().p

    normal = predicted(["Normal", "A", "B"])
    assert (normal.predicted_class, normal.confidence, normal.anomaly_score) == ("A", 0.5, 0.7)
    assert predicted(["Normal", "Benign", "B"]).anomaly_score == 0.5
    assert predicted(["A", "B", "C"]).anomaly_score == 0.5
    assert normal.class_probabilities == {"Normal": 0.3, "A": 0.5, "B": 0.2}


def test_select_best(spark):
    reports = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1)], "epoch int, macro_f1 double")
    assert models.select_best(reports).first().epoch == 2


def test_class_names():
    assert models.resolve_class_names(None, [], ["a", "b"], 2) == ["a", "b"]
    assert models.resolve_class_names(None, [], ["a", "b"], 3) == ["class_0", "class_1", "class_2"]
    assert models.resolve_class_names(["x"], ["y"], ["z"]) == ["x"]
    with pytest.raises(ValueError):
        models.resolve_class_names(None, ["y"], ["z"], 2)
    assert models.normal_class_name(["Attack", "Normal"], 7) == "Normal"
    assert models.normal_class_name(["Benign", "Normal"], 0) == "Benign"


def test_window_features(spark):
    window = [[1.0, 10.0], [3.0, 10.0], [8.0, 40.0]]
    df = spark.createDataFrame([(window,)], "w array<array<float>>")
    got = df.select(vector_to_array(models.window_features(F.col("w")))).first()[0]
    x = np.array(window)
    assert got == pytest.approx([*x.mean(axis=0), *x.std(axis=0), *x[-1], *(x[-1] - x[0])])


@pytest.mark.parametrize("kind", ["logistic", "boosted", "perceptron"])
def test_fit_and_score(spark, kind):
    data = [(i, i % 2, [float(i % 2) * 4 + math.sin(i), float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(data, "id int, y int, x array<double>")
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("features", array_to_vector("x")).withColumn("split", F.lit("test"))
    params = {"logistic": {}, "boosted": {"maxIter": 3}, "perceptron": {"layers": [2, 3, 2], "seed": 1}}[kind]
    model = models.fit_classifier(rows, kind=kind, **params)
    if kind == "boosted":
        right = model.transform(rows).where("prediction = y").count()
    else:
        scored = models.score(rows, model, ["Normal", "Anomaly"])
        right = scored.where((F.col("prediction.predicted_class") == "Anomaly") == (F.col("y") == 1)).count()
        table = classes.class_table(spark, ["Normal", "Anomaly"])
        report = models.evaluate_split(rows, "test", model, table, ["Normal", "Anomaly"])
        values = {r.metric: r.value for r in report.summary.collect()}
        assert values["roc_auc"] > 0.9
        with pytest.raises(KeyError):
            models.evaluate_split(rows, "val", model, table, ["Normal", "Anomaly"])
    assert right >= 54


def test_window_features_of_odd_windows(spark):
    """A batch holds windows of several shapes, nulls and no rows; all but nulls are as plain Python has them."""
    windows = [[[1.0, 10.0], [3.0, 10.0]], None, [[2.0, 5.0]], [[4.0, None], [1.0, 1.0]], [[1.5, -2.0], [9.0, 8.0]], [[7.0], [9.0]]]
    df = spark.createDataFrame(list(enumerate(windows)), "id int, w array<array<float>>").coalesce(1)
    found = df.where("id not in (1, 3)").select("id", vector_to_array(models.window_features(F.col("w"))).alias("x"))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        x = np.array(windows[row.id])
        assert row.x == pytest.approx([*x.mean(axis=0), *x.std(axis=0), *x[-1], *(x[-1] - x[0])])
    assert found.count() == 4
