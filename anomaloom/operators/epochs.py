"""Training by epochs: mini-batch steps, validation, early stopping, falling learning rate, resume.

A linear softmax classifier over feature arrays. The train rows are laid out by batch once, so a step
reads its own batch; every task sums its rows' gradients, the sums are added up by place before the
driver (which holds the model, never rows) takes an AdamW step. Every epoch leaves one row with its
figures, the model and the state of the optimiser: a job that was ended goes on from the last row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.operators.models import select_best
from anomaloom.session import shared_folder
from anomaloom.sources.datasets import load_split

_BETAS = (0.9, 0.999)
_TINY = 1e-8


@dataclass(frozen=True)
class EpochSettings:
    """``batches`` per epoch; ``patience`` epochs without a better validation macro-F1 end the training,
    ``rate_patience`` epochs without a lower validation loss multiply the learning rate by ``rate_factor``."""

    epochs: int = 35
    batches: int = 8
    learning_rate: float = 0.05
    weight_decay: float = 1e-4
    patience: int = 8
    rate_factor: float = 0.5
    rate_patience: int = 2
    seed: int = 42


@dataclass
class EpochState:
    """A row of the history: the figures of an epoch, and all that the next one starts from."""

    epoch: int
    train_loss: float
    val_loss: float
    macro_f1: float
    learning_rate: float
    n_classes: int
    weights: list[float]
    first_moment: list[float]
    second_moment: list[float]
    steps: int
    next_rate: float
    lowest_loss: float
    epochs_above: int
    best_f1: float
    epochs_without_better: int


_SCHEMA = (
    "epoch int, train_loss double, val_loss double, macro_f1 double, learning_rate double, n_classes int, "
    "weights array<double>, first_moment array<double>, second_moment array<double>, steps int, next_rate double, "
    "lowest_loss double, epochs_above int, best_f1 double, epochs_without_better int"
)


def read_history(spark: SparkSession, folder: str) -> DataFrame | None:
    """All epochs that a training has left in its folder; None before the first."""
    try:
        return spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/epochs")
    except AnalysisException:
        return None


def best_epoch(history: DataFrame, as_of: int | None = None) -> DataFrame:
    """The epoch of the best validation macro-F1, the earliest of equal ones; ``as_of`` looks at the epochs
    up to that one, as a training that ended there would."""
    seen = history if as_of is None else history.where(F.col("epoch") <= as_of)
    return select_best(seen)


def train_epochs(
    dataset: DataFrame,
    folder: str,
    n_classes: int,
    settings: EpochSettings = EpochSettings(),
    ids: tuple[str, ...] = ("id",),
    features: str = "features",
    label: str = "y",
    weight: str | None = None,
) -> DataFrame:
    """Train on the split ``train``, watch the split ``val``; the history, one row per epoch.

    ``features`` is an array of numbers, equally long in all rows (null elements count as 0); labels are
    class numbers; ``weight`` scales a row's loss. A folder with earlier epochs is gone on with, under the
    settings given now. Rows with a null label or null features are not learnt from.
    """
    spark = dataset.sparkSession
    rows = dataset.select(
        *ids,
        F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("x"),
        F.col(label).cast("int").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
        "split",
    ).where(F.col("y").isNotNull() & F.col("x").isNotNull())
    laid_out = f"{folder}/batches"
    history = read_history(spark, folder)
    state = _last(history)
    if state is None:
        batch = F.pmod(F.xxhash64(F.lit(settings.seed), *ids), F.lit(settings.batches)).alias("batch")
        load_split(rows, "train").select("x", "y", "w", batch).write.mode("overwrite").partitionBy("batch").parquet(f"{laid_out}/train")
        load_split(rows, "val").select("x", "y", "w").write.mode("overwrite").parquet(f"{laid_out}/val")
    train, val = spark.read.parquet(f"{laid_out}/train"), spark.read.parquet(f"{laid_out}/val")
    batches = sorted(row["batch"] for row in train.select("batch").distinct().collect())
    if state is None:
        width = train.select(F.size("x")).first()[0] + 1
        zeros = [0.0] * (n_classes * width)
        rate = settings.learning_rate
        state = EpochState(0, 0.0, 0.0, 0.0, rate, n_classes, zeros, zeros, zeros, 0, rate, float("inf"), 0, float("-inf"), 0)
    while state.epoch < settings.epochs and state.epochs_without_better < settings.patience:
        state = _epoch(train, val, batches, settings, state)
        row = spark.createDataFrame([tuple(asdict(state).values())], _SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/epochs/{state.epoch:06}")
    return read_history(spark, folder)


def _last(history: DataFrame | None) -> EpochState | None:
    row = None if history is None else history.orderBy(F.desc("epoch")).first()
    return None if row is None else EpochState(**row.asDict())


def _epoch(train: DataFrame, val: DataFrame, batches: list[int], settings: EpochSettings, before: EpochState) -> EpochState:
    k = before.n_classes
    weights, first, second = (np.array(a) for a in (before.weights, before.first_moment, before.second_moment))
    steps, losses, total = before.steps, 0.0, 0.0
    order = np.random.default_rng([settings.seed, before.epoch]).permutation(batches)
    for batch in order.tolist():
        sums = _sums(train.where(F.col("batch") == batch), weights, k, with_gradient=True)
        gradient, (loss, size) = sums[: len(weights)], sums[len(weights) : len(weights) + 2]
        if not size:
            continue
        gradient, steps = gradient / size, steps + 1
        first = _BETAS[0] * first + (1 - _BETAS[0]) * gradient
        second = _BETAS[1] * second + (1 - _BETAS[1]) * gradient * gradient
        step = first / (1 - _BETAS[0] ** steps) / (np.sqrt(second / (1 - _BETAS[1] ** steps)) + _TINY)
        weights = weights * (1 - before.next_rate * settings.weight_decay) - before.next_rate * step
        losses, total = losses + loss, total + size
    found = _sums(val, weights, k, with_gradient=False)
    val_loss = float(found[0] / found[1]) if found[1] else 0.0
    f1 = _macro_f1(found[2:].reshape(k, k))
    # The rate falls once the loss has stayed above its lowest for longer than the patience.
    lower = val_loss < before.lowest_loss * (1 - 1e-4)
    above = 0 if lower else before.epochs_above + 1
    fall = above > settings.rate_patience
    return EpochState(
        before.epoch + 1, float(losses / total) if total else 0.0, val_loss, f1, before.next_rate, k,
        weights.tolist(), first.tolist(), second.tolist(), steps,
        before.next_rate * (settings.rate_factor if fall else 1.0),
        val_loss if lower else before.lowest_loss, 0 if fall else above,
        max(before.best_f1, f1), 0 if f1 > before.best_f1 else before.epochs_without_better + 1,
    )


def _macro_f1(confusion: np.ndarray) -> float:
    hit, both = np.diag(confusion), confusion.sum(axis=0) + confusion.sum(axis=1)
    return float(np.where(both > 0, 2 * hit / np.where(both > 0, both, 1), 0.0).mean())


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, width - 1))
    if x.shape[1] != width - 1:
        raise ValueError(f"features of {x.shape[1]} numbers where the model has {width - 1}")
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(rows: DataFrame, weights: np.ndarray, k: int, with_gradient: bool) -> np.ndarray:
    """Gradient (if asked for), weighted loss and weight, and without gradient the confusion, over all rows."""
    model = weights.reshape(k, -1)
    size = (len(weights) if with_gradient else k * k) + 2

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in stream:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"], model.shape[1])
            y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
            logits = x @ model.T
            top = logits.max(axis=1, keepdims=True)
            powers = np.exp(logits - top)
            all_powers = powers.sum(axis=1)
            loss = np.log(all_powers) + top[:, 0] - logits[np.arange(len(y)), y]
            if with_gradient:
                gaps = powers / all_powers[:, None]
                gaps[np.arange(len(y)), y] -= 1.0
                parts = [(gaps * w[:, None]).T @ x, [w @ loss, w.sum()]]
            else:
                said = logits.argmax(axis=1)
                parts = [[w @ loss, w.sum()], np.bincount(y * k + said, minlength=k * k)]
            total += np.concatenate([np.ravel(part) for part in parts])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    sums = rows.select("x", "y", "w").mapInArrow(run, "place long, value double")
    found = np.zeros(size)
    for row in sums.groupBy("place").agg(F.sum("value").alias("value")).collect():
        found[row["place"]] = row["value"]
    return found


def with_logits(df: DataFrame, model: DataFrame, features: str = "features", output: str = "logits") -> DataFrame:
    """Add the logits of a row of the history (as :func:`best_epoch` gives it) to every row of ``df``."""
    row = model.select("weights", "n_classes").first()
    weights = np.array(row["weights"]).reshape(row["n_classes"], -1)
    table = F.array(*(F.array(*(F.lit(float(v)) for v in line[:-1])) for line in weights))
    bias = F.array(*(F.lit(float(line[-1])) for line in weights))

    def dot(line, start):
        products = F.zip_with(line, F.col(features), lambda a, x: a * F.coalesce(x.cast("double"), F.lit(0.0)))
        return F.aggregate(products, start, lambda total, value: total + value)

    return df.withColumn(output, F.zip_with(table, bias, dot))


def training_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one for the epochs of a training."""
    return f"{shared_folder(spark).rstrip('/')}/{name}"
