"""The training job on small written datasets: both inputs, all balances, the nested report."""

import json
import random

import pytest
from pyspark.ml import PipelineModel

from anomaloom.operators.classes import class_table
from anomaloom.plans.training import train_and_evaluate
from anomaloom.sources.datasets import write_dataset


def rows_of(windows):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        y = int(i % 5 == 0)
        split = ("train", "train", "train", "val", "test")[(i // 5) % 5]
        if windows:
            x = [[rng.gauss(3.0 * y, 1.0), rng.random()] for _ in range(4)]
        else:
            x = [0, 0] + [rng.choice((7, 8) if y and rng.random() < 0.7 else (2, 3, 4)) for _ in range(6)]
        rows.append((i, x, y, split))
    return rows


@pytest.mark.parametrize("windows,balance", [(False, "none"), (False, "resample"), (True, "weights")])
def test_training_job(spark, tmp_path, windows, balance):
    kind = "array<array<double>>" if windows else "array<int>"
    rows = rows_of(windows)
    df = spark.createDataFrame(rows, f"id bigint, X {kind}, y bigint, split string")
    write_dataset(df, f"{tmp_path}/data", {"classes": class_table(spark, ["Normal", "Anomaly"])})
    result = train_and_evaluate(
        spark, f"{tmp_path}/data", f"{tmp_path}/out", ["id"], windows, ({"regParam": 10.0}, {"regParam": 0.01}), balance=balance
    )
    report = result.report
    assert report["best_macro_f1"] == max(h["val"]["macro_f1"] for h in report["metrics"]["history"]) >= 0.9
    test = report["metrics"]["test"]
    supports = [sum(1 for r in rows if r[3] == "test" and r[2] == y) for y in (0, 1)]
    assert [test["per_class"][name]["support"] for name in ("Normal", "Anomaly")] == supports
    assert [sum(line) for line in test["confusion_matrix"]] == supports
    assert test["accuracy"] >= 0.9 and test["roc_auc"] > 0.9 and test["loss"] >= 0
    written = spark.read.text(f"{tmp_path}/out/report").first()[0]
    assert json.loads(written)["metrics"]["test"] == test
    assert isinstance(PipelineModel.load(f"{tmp_path}/out/model"), PipelineModel)


def test_training_job_refuses(spark, tmp_path):
    with pytest.raises(ValueError):
        train_and_evaluate(spark, "x", "y", ["id"], balance="other")
    with pytest.raises(ValueError):
        train_and_evaluate(spark, "x", "y", ["id"], settings=())
