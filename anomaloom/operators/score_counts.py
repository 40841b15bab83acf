"""ROC area and average precision from counts per score, kept and folded across runs.

A run's rows shrink to one row per distinct score. Counts of runs add up, so the figures over everything
judged so far are those of one pass over all rows, and no earlier row is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.operators.ranking import prefix_sums


def score_counts(df: DataFrame, *runs: str, truth: str = "anomaly", score: str = "anomaly_score") -> DataFrame:
    """``runs, score, n, positives`` per distinct score (and run).

    Rows whose score is null or NaN are left out. A null truth is negative.
    """
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return scored.groupBy(*runs, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 1).alias("positives")
    )


def write_score_counts(
    df: DataFrame, path: str, run: str = "run", truth: str = "anomaly", score: str = "anomaly_score"
) -> None:
    """Store the counts of the runs in ``df`` under ``path``. A run that is written again replaces what was stored
    of it, so a job that starts over counts nothing twice; other runs stay."""
    counts = score_counts(df, run, truth=truth, score=score).withColumnRenamed(run, "run")
    stored = counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    stored.partitionBy("run").parquet(path)


def read_score_counts(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts, with their ``run``."""
    return spark.read.parquet(path)


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several runs as those of one."""
    return counts.groupBy("score").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def roc_auc_of_counts(per_score: DataFrame, **sizes: int) -> DataFrame:
    """Area under the ROC curve of merged counts by ranks, ties averaged; null if a class is absent."""
    ranked = prefix_sums(per_score, [F.col("score")], {"n": "upto"}, **sizes)
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    sums = ranked.agg(
        F.sum(F.col("positives") * rank).alias("rank_sum"),
        F.sum("positives").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("q"),
    )
    area = (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), area).alias("roc_auc"))


def average_precision_of_counts(per_score: DataFrame, **sizes: int) -> DataFrame:
    """Mean over the positives of the precision at their score; null without positives.

    Counts know no order among equal scores: they enter together, with the precision after all of them.
    """
    falling = per_score.select((-F.col("score")).alias("falling"), "n", "positives")
    running = prefix_sums(falling, [F.col("falling")], {"n": "seen", "positives": "found"}, **sizes)
    sums = running.agg(
        F.sum(F.col("positives") * F.col("found") / F.col("seen")).alias("s"), F.sum("positives").alias("p")
    )
    return sums.select(F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))
