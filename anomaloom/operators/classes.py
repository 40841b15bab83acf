"""Class tables, counts, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from anomaloom.functions.labels import BINARY_CLASSES, FAMILY_CLASSES, FINE_CLASSES, check_label_schema
from anomaloom.operators.joins import lookup_join
from anomaloom.sources.datasets import SPLITS

RARE_BUCKET = "OtherAttack"
PROTECTED = ("Benign", "Anomaly")


def class_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``class_index, class_name`` in the given order."""
    rows = [(index, name) for index, name in enumerate(names)]
    return spark.createDataFrame(rows, "class_index int, class_name string")


def merge_rare_classes(
    df: DataFrame,
    min_support: int,
    label: str = "label",
    schema: str = "fine",
    bucket: str = RARE_BUCKET,
) -> DataFrame:
    """Put classes with fewer than ``min_support`` rows into ``bucket``; Benign and Anomaly stay."""
    check_label_schema(schema)
    if min_support < 0:
        raise ValueError("minimum class support must not be negative")
    if min_support <= 1 or schema == "binary":
        return df
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    rare = counts.where((F.col("__n") < min_support) & ~F.col(label).isin(*PROTECTED)).select(
        label, F.lit(True).alias("__rare")
    )
    joined = lookup_join(df, rare, [label])
    merged = F.when(F.col("__rare"), F.lit(bucket)).otherwise(F.col(label))
    return joined.withColumn(label, merged).select(*df.columns)


def ordered_classes(
    df: DataFrame,
    label: str = "label",
    schema: str = "fine",
    force: bool = True,
    bucket: str = RARE_BUCKET,
) -> DataFrame:
    """``class_index, class_name``: the canonical order (all of it with ``force``, else the classes
    present), then the other classes: under ``fine`` all of them by name, under ``family`` the
    bucket."""
    check_label_schema(schema)
    spark = df.sparkSession
    if schema == "binary":
        return class_table(spark, BINARY_CLASSES)
    canonical = class_table(spark, FAMILY_CLASSES if schema == "family" else FINE_CLASSES)
    if schema == "family" and force:
        return canonical
    present = df.select(F.col(label).alias("class_name")).distinct()
    base = canonical if force else canonical.join(present, "class_name", "left_semi")
    extras = present.join(canonical, "class_name", "left_anti")
    if schema == "family":
        extras = extras.where(F.col("class_name") == bucket)
    listed = base.select("class_name", F.col("class_index").alias("place")).unionByName(
        extras.select("class_name", F.lit(len(FINE_CLASSES)).alias("place"))
    )
    # One row per class: a table as small as the class list.
    index = F.row_number().over(Window.orderBy("place", "class_name")) - 1
    return listed.select(index.cast("int").alias("class_index"), "class_name")


def index_classes(df: DataFrame, classes: DataFrame, label: str = "label", output: str = "y") -> DataFrame:
    """Add the class index of a label."""
    named = classes.select(F.col("class_name").alias(label), F.col("class_index").alias(output))
    return lookup_join(df, named, [label], "inner").select(*df.columns, output)


def class_counts(
    df: DataFrame, classes: DataFrame, label: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """``[by,] class_index, class_name, n`` with zeros for classes that do not occur.

    By ``split`` alone all three splits are listed, also those without rows.
    """
    counted = df.groupBy(*by, F.col(label).alias("class_index")).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        return classes.join(counted, "class_index", "left").select(
            "class_index", "class_name", F.coalesce("n", F.lit(0)).alias("n")
        )
    # The class list is as long as the model's output; it goes into the expression.
    names = F.array(
        *(F.struct(F.lit(r.class_index).alias("class_index"), F.lit(r.class_name).alias("class_name"))
          for r in classes.collect())
    )
    if list(by) == ["split"]:
        groups = df.sparkSession.createDataFrame([(name,) for name in SPLITS], "split string")
    else:
        groups = counted.select(*by).distinct()
    grid = groups.select(*by, F.inline(names))
    return grid.join(counted, [*by, "class_index"], "left").select(
        *by, "class_index", "class_name", F.coalesce("n", F.lit(0)).alias("n")
    )


def inverse_frequency_weights(counts: DataFrame) -> DataFrame:
    """Add ``weight`` = total / (count · classes), counts floored at 1 (one row per class)."""
    floored = F.greatest(F.col("n"), F.lit(1))
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "weight", F.sum(floored).over(everything) / (floored * F.count(F.lit(1)).over(everything))
    )


def with_class_weight(df: DataFrame, weights: DataFrame, label: str = "y", output: str = "weight") -> DataFrame:
    """Add the weight of each row's class."""
    table = weights.select(F.col("class_index").alias(label), F.col("weight").alias(output))
    return lookup_join(df, table, [label])
