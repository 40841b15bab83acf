"""Training by epochs: what is learnt, early stopping, falling rate, resume, the choice of the best."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomaloom.functions.numeric import argmax
from anomaloom.operators.epochs import EpochSettings, best_epoch, read_history, train_epochs, with_logits


def rows_of(spark, noise=0.0, count=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    y = np.where(rng.random(count) < noise, rng.integers(0, 3, count), y)
    split = rng.choice(["train", "val", "test"], count, p=[0.6, 0.2, 0.2])
    rows = [(i, line, int(label), str(part)) for i, (line, label, part) in enumerate(zip(x.tolist(), y, split))]
    return spark.createDataFrame(rows, "id long, features array<double>, y int, split string")


def test_first_epoch_is_plain_adam(spark, tmp_path):
    """One batch and one epoch by hand: gradient, step, loss and F1."""
    df = rows_of(spark, 0.1)
    history = train_epochs(df, str(tmp_path), 3, EpochSettings(epochs=1, batches=1, learning_rate=0.1, weight_decay=0.0))
    row = history.first()
    parts = {s: [(np.array(r.features), r.y) for r in df.where(F.col("split") == s).collect()] for s in ("train", "val")}
    x = np.hstack([np.array([a for a, _ in parts["train"]]), np.ones((len(parts["train"]), 1))])
    y = np.eye(3)[[b for _, b in parts["train"]]]
    gradient = (1 / 3 - y).T @ x / len(x)
    weights = -0.1 * gradient / (np.abs(gradient) + 1e-8)
    assert np.allclose(row["weights"], weights.ravel()) and np.isclose(row["train_loss"], np.log(3))
    v = np.hstack([np.array([a for a, _ in parts["val"]]), np.ones((len(parts["val"]), 1))]) @ weights.T
    truth = np.array([b for _, b in parts["val"]])
    loss = np.mean(np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(truth)), truth])
    said = v.argmax(axis=1)
    f1 = [2 * ((said == c) & (truth == c)).sum() / ((said == c).sum() + (truth == c).sum()) for c in range(3)]
    assert np.isclose(row["val_loss"], loss) and np.isclose(row["macro_f1"], np.mean(f1))


def test_learns_and_stops_early(spark, tmp_path):
    settings = EpochSettings(epochs=30, batches=3, learning_rate=0.3, patience=2, rate_patience=0)
    df = rows_of(spark, 0.3)
    history = train_epochs(df, str(tmp_path), 3, settings).orderBy("epoch").collect()
    assert 2 < len(history) < 30
    best = max(row["macro_f1"] for row in history)
    first = next(row["epoch"] for row in history if row["macro_f1"] == best)
    assert history[-1]["epoch"] == first + settings.patience
    assert best_epoch(read_history(spark, str(tmp_path))).first()["epoch"] == first
    assert best_epoch(read_history(spark, str(tmp_path)), as_of=1).first()["epoch"] == 1
    lowest, rate = float("inf"), settings.learning_rate
    for row in history:
        assert np.isclose(row["learning_rate"], rate)
        rate *= 1.0 if row["val_loss"] < lowest * (1 - 1e-4) else 0.5
        lowest = min(lowest, row["val_loss"])
    assert rate < settings.learning_rate
    scored = with_logits(df, best_epoch(read_history(spark, str(tmp_path)))).where("split = 'test'")
    assert scored.select(F.avg((argmax(F.col("logits")) == F.col("y")).cast("int"))).first()[0] > 0.6


def test_resume_goes_on_where_it_ended(spark, tmp_path):
    df = rows_of(spark)
    whole = train_epochs(df, f"{tmp_path}/whole", 3, EpochSettings(epochs=4, batches=2)).orderBy("epoch").collect()
    train_epochs(df, f"{tmp_path}/parts", 3, EpochSettings(epochs=2, batches=2))
    parts = train_epochs(df, f"{tmp_path}/parts", 3, EpochSettings(epochs=4, batches=2)).orderBy("epoch").collect()
    assert [row["epoch"] for row in parts] == [1, 2, 3, 4]
    for a, b in zip(whole, parts):
        assert np.allclose(a["weights"], b["weights"]) and np.isclose(a["val_loss"], b["val_loss"])


def test_refused(spark, tmp_path):
    df = rows_of(spark).where("split <> 'val'")
    with pytest.raises(KeyError):
        train_epochs(df, str(tmp_path), 3)
    assert read_history(spark, f"{tmp_path}/nothing") is None


def test_weights_and_nulls(spark, tmp_path):
    """A row of weight 2 counts as two rows; rows without label or features are left out."""
    df = rows_of(spark, count=200)
    once = df.withColumn("weight", F.when(F.col("split") == "train", 2.0).otherwise(1.0))
    odd = spark.createDataFrame([(-1, None, 1, "train"), (-2, [1.0] * 4, None, "train")], df.schema).withColumn("weight", F.lit(1.0))
    settings = EpochSettings(epochs=2, batches=1)
    a = train_epochs(once.union(odd), f"{tmp_path}/a", 3, settings, weight="weight").orderBy("epoch").collect()
    b = train_epochs(df.union(df.where("split = 'train'")), f"{tmp_path}/b", 3, settings).orderBy("epoch").collect()
    assert all(np.allclose(x["weights"], y["weights"]) and np.isclose(x["train_loss"], y["train_loss"]) for x, y in zip(a, b))
