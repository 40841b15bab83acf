"""Train-only normalisation of window features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.operators.windows import BLOCK_ROWS

MIN_STD = 1e-6


def row_multiplicity(
    train_keys: DataFrame, length: int, stride: int, file: str = "file"
) -> tuple[DataFrame, int]:
    """How many train windows contain the rows of each cell of ``g`` rows, and ``g``.

    Window borders fall on multiples of g = gcd(length, stride), so all rows of a cell are in the
    same windows: the table has one row per g data rows and no window is laid out. Windows that start
    in the same block of rows are brought together first; their cells are counted where they are, and
    only the counts are shipped.
    """
    g = math.gcd(length, stride)
    start = F.col("w") * stride
    keys = train_keys.select(file, "w", "n_rows", F.floor(start / BLOCK_ROWS).alias("__block"))
    near = keys.repartition(file, "__block")
    first = F.floor(start / g)
    last = F.floor((start + F.col("n_rows") - 1) / g)
    cells = near.select(file, "__block", F.explode(F.sequence(first, last)).alias("__cell"))
    counts = cells.groupBy(file, "__block", "__cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(file, "__cell").agg(F.sum("n").alias("__times")), g


def normalization_stats(
    numbered: DataFrame,
    train_keys: DataFrame,
    length: int,
    stride: int,
    file: str = "file",
    features: str = "features",
) -> DataFrame:
    """One row ``mean, std`` (arrays) over all rows of all train windows.

    A row counts once per window it is in, padding rows count as zeros, the deviation is the
    population one, and one below 1e-6 is taken as 1. One weighted pass with a stable (Welford)
    aggregate; the windows are never laid out.
    """
    times, g = row_multiplicity(train_keys, length, stride, file)
    weighted = numbered.select(
        file, F.floor((F.col("rn") - 1) / g).alias("__cell"), features
    ).join(times, [file, "__cell"])
    weight = F.col("__times").cast("double")
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector(features), weight)
    # Grouped by a constant, so that no rows give no summary instead of an error.
    rows = weighted.groupBy(F.lit("all")).agg(
        summary.alias("s"), F.sum(weight).alias("w1"), F.sum(weight * weight).alias("w2")
    )
    padding = train_keys.agg(F.sum(F.lit(length) - F.col("n_rows")).alias("zeros"))
    # Two one-row tables side by side.
    both = rows.select("s", "w1", "w2").unionByName(padding, allowMissingColumns=True).agg(
        F.first("s", ignorenulls=True).alias("s"),
        F.sum("w1").alias("w1"),
        F.sum("w2").alias("w2"),
        F.coalesce(F.sum("zeros"), F.lit(0)).alias("zeros"),
    )
    sample_to_total = (F.col("w1") - F.col("w2") / F.col("w1")) / F.col("total")
    spread = F.col("w1") * F.col("zeros") / (F.col("total") * F.col("total"))
    return (
        both.where(F.col("w1") > 0)
        .withColumns(
            {
                "m": vector_to_array("s.mean"),
                "v": vector_to_array("s.variance"),
                "total": F.col("w1") + F.col("zeros"),
            }
        )
        .select(
            F.transform("m", lambda mean: mean * F.col("w1") / F.col("total")).alias("mean"),
            F.transform(
                F.zip_with("v", "m", lambda v, mean: F.sqrt(v * sample_to_total + mean * mean * spread)),
                lambda std: F.when(std < MIN_STD, F.lit(1.0)).otherwise(std),
            ).alias("std"),
        )
    )


def fitted_stats(stats: DataFrame) -> tuple[list[float], list[float]]:
    """The two short arrays as Python lists; an empty train split is an error."""
    row = stats.first()
    if row is None:
        raise ValueError("the train split is empty, nothing to normalise by")
    return list(row["mean"]), list(row["std"])


def normalized(vector: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(x − mean) / std per feature, as 32-bit floats."""
    shift = F.lit(list(mean)).cast("array<double>")
    scale = F.lit(list(std)).cast("array<double>")
    centred = F.zip_with(vector, shift, lambda x, m: x - m)
    return F.zip_with(centred, scale, lambda x, s: x / s).cast("array<float>")


def apply_normalization(
    df: DataFrame, mean: Sequence[float], std: Sequence[float], features: str = "features"
) -> DataFrame:
    """Normalise feature rows (before windows are laid out, so a row is computed once)."""
    return df.withColumn(features, normalized(F.col(features), mean, std))


def normalized_padding(mean: Sequence[float], std: Sequence[float]) -> Column:
    """A padding row after normalisation."""
    return F.lit([-m / s for m, s in zip(mean, std)]).cast("array<float>")
