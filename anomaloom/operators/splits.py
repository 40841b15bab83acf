"""Stratified splits, shuffles, balanced draws."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from anomaloom.operators.joins import lookup_join
from anomaloom.operators.ranking import hash_bucket, hash_order, row_number_by_bucket
from anomaloom.sources.datasets import SPLITS

DEFAULT_RATIOS = (0.75, 0.10, 0.15)
DEFAULT_SEED = 42
# Draws of one row that one task may have to produce.
DRAWS_PER_SALT = 10_000


def check_ratios(ratios: Sequence[float]) -> None:
    if any(ratio < 0 for ratio in ratios):
        raise ValueError("split ratios must not be negative")
    if not math.isclose(sum(ratios), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)}")


def split_counts(total: int, ratios: Sequence[float] = DEFAULT_RATIOS) -> tuple[int, int, int]:
    """Exact (train, val, test) sizes of a class of ``total`` rows.

    Train and validation take the whole part of their share, at least one row each from three rows
    on; test takes the rest, and where nothing is left it gets a row of the larger of the two. Of two
    rows the first goes to train (validation if train has under half), the second to test unless
    validation took it.
    """
    train_share, val_share = ratios[0], ratios[1]
    if total <= 1:
        return max(total, 0), 0, 0
    if total == 2:
        return (1, 0, 1) if train_share >= 0.5 else (0, 1, 1)
    train, val = max(int(total * train_share), 1), max(int(total * val_share), 1)
    if train + val >= total:
        train, val = (train - 1, val) if train > val else (train, val - 1)
    return train, val, total - train - val


def stratified_split(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    ratios: Sequence[float] = DEFAULT_RATIOS,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add ``split``: per class a seeded shuffle cut at the exact quotas.

    Pass light rows (ids and label): they are shipped once for the rank, by (class, hash bucket), so
    a class that holds nearly all rows is still spread.
    """
    check_ratios(ratios)
    totals = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    bounds = []
    for row in totals:
        train, val, _ = split_counts(row["n"], ratios)
        bounds.append((row[label], train, train + val))
    kind = df.schema[label].dataType.simpleString()
    quotas = df.sparkSession.createDataFrame(bounds, f"`{label}` {kind}, __train bigint, __val bigint")
    hashed = df.withColumn("__h", hash_order(seed, F.col(label), *(F.col(name) for name in ids)))
    hashed = hashed.withColumn("__hb", hash_bucket(F.col("__h")))
    ranked = row_number_by_bucket(hashed, [label], ["__hb"], ["__h", *ids], "__rank")
    train, val, test = SPLITS
    split = (
        F.when(F.col("__rank") <= F.col("__train"), F.lit(train))
        .when(F.col("__rank") <= F.col("__val"), F.lit(val))
        .otherwise(F.lit(test))
    )
    return lookup_join(ranked, quotas, [label], "inner").select(*df.columns, split.alias("split"))


def shuffle(df: DataFrame, ids: Sequence[str], seed: int = DEFAULT_SEED, output: str = "position") -> DataFrame:
    """Place of every row in a seeded random order (from 1), the same under any partitioning."""
    hashed = df.withColumn("__h", hash_order(seed, *(F.col(name) for name in ids)))
    hashed = hashed.withColumn("__hb", hash_bucket(F.col("__h")))
    return row_number_by_bucket(hashed, [], ["__hb"], ["__h", *ids], output).select(*df.columns, output)


def balanced_resample(
    df: DataFrame, label: str, ids: Sequence[str], weights: DataFrame, draws: int | None = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``draws`` rows (as many as there are by default) drawn with replacement, each with a chance in
    proportion to the weight of its class (``label, weight``). Adds ``draw``.

    Every draw picks a class, then the row at a random rank of it. Small classes are drawn many
    times over, so their few rows are repeated per salt and their draws spread over the salts.
    """
    totals = {row[label]: row["n"] for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {row[label]: row["weight"] * totals.get(row[label], 0) for row in weights.collect()}
    mass = sum(shares.values())
    if mass <= 0:
        raise ValueError("no row has a positive weight")
    draws = sum(totals.values()) if draws is None else draws
    table, upto = [], 0.0
    for value in sorted(name for name, share in shares.items() if share > 0):
        low, upto = upto, upto + shares[value] / mass
        per_row = draws * (upto - low) / totals[value]
        table.append((value, low, upto, totals[value], max(1, math.ceil(per_row / DRAWS_PER_SALT))))
    # The last class ends past 1, so that rounding leaves no draw without a class.
    table[-1] = (*table[-1][:2], 2.0, *table[-1][3:])
    kind = df.schema[label].dataType.simpleString()
    chosen = None
    spark = df.sparkSession
    point = F.conv(F.substring("__h", 1, 12), 16, 10).cast("double") / float(16**12)
    picked = spark.range(draws).withColumnRenamed("id", "draw").withColumn("__h", hash_order(seed, F.col("draw")))
    picked = picked.withColumn("__u", point)
    for value, _, high, size, salts in table:
        entry = F.struct(
            F.lit(value).cast(kind).alias("value"), F.lit(size).cast("bigint").alias("size"), F.lit(salts).alias("salts")
        )
        here = F.col("__u") < high
        chosen = F.when(here, entry) if chosen is None else chosen.when(here, entry)
    place = F.conv(F.substring("__h", 17, 14), 16, 10).cast("bigint")
    picked = picked.withColumn("__c", chosen).select(
        "draw",
        F.col("__c.value").alias(label),
        (place % F.col("__c.size") + 1).alias("__rank"),
        (F.col("draw") % F.col("__c.salts")).cast("int").alias("__salt"),
    )
    hashed = df.withColumn("__h", hash_order(seed, F.col(label), *(F.col(name) for name in ids)))
    hashed = hashed.withColumn("__hb", hash_bucket(F.col("__h")))
    ranked = row_number_by_bucket(hashed, [label], ["__hb"], ["__h", *ids], "__rank").drop("__h", "__hb")
    salts = spark.createDataFrame([(v, s) for v, _, _, _, s in table], f"`{label}` {kind}, __salts int")
    rows = lookup_join(ranked, salts, [label], "inner").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    )
    return picked.join(rows, [label, "__rank", "__salt"]).select(*df.columns, "draw")
