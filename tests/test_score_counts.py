"""Figures folded from the counts of runs, against plain Python over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from anomaloom.operators import evaluation, score_counts as counts

SCHEMA = "id int, run string, anomaly int, anomaly_score double"


def judged(count, seed=1):
    rng = random.Random(seed)
    return [(i, f"day{i % 4}", int(rng.random() < 0.3), round(rng.random(), 1)) for i in range(count)]


def plain(rows):
    good = [r for r in rows if r[3] is not None and r[3] == r[3]]
    pos, neg = [r[3] for r in good if r[2] == 1], [r[3] for r in good if r[2] != 1]
    area = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    precision = sum(sum(q >= p for q in pos) / sum(r[3] >= p for r in good) for p in pos) / len(pos)
    return area, precision


def figures(merged, **sizes):
    return counts.roc_auc_of_counts(merged, **sizes).first()[0], counts.average_precision_of_counts(merged, **sizes).first()[0]


def test_runs_fold_to_the_figures_of_all_rows(spark, tmp_path):
    rows = judged(400) + [(900, "day1", 1, None), (901, "day2", 0, float("nan")), (902, "day9", None, 0.5)]
    path = str(tmp_path / "counts")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x"))
    counts.write_score_counts(df.where("run < 'day3'"), path)
    counts.write_score_counts(df.where("run >= 'day3'"), path)
    stored = counts.read_score_counts(spark, path)
    assert figures(counts.merged_counts(stored)) == pytest.approx(plain(rows))
    assert {r.run for r in stored.select("run").distinct().collect()} == {"day0", "day1", "day2", "day3", "day9"}
    # One row per score and run, however many rows were judged.
    assert stored.count() <= 11 * 5


def test_a_run_written_again_counts_once(spark, tmp_path):
    rows, path = judged(200), str(tmp_path / "counts")
    df = spark.createDataFrame(rows, SCHEMA)
    wrong = df.where("run = 'day2'").withColumn("anomaly", F.lit(1))
    counts.write_score_counts(df.where("run <> 'day2'").unionByName(wrong), path)
    counts.write_score_counts(df.where("run = 'day2'"), path)
    assert figures(counts.merged_counts(counts.read_score_counts(spark, path))) == pytest.approx(plain(rows))


def test_same_area_as_one_pass(spark):
    df = spark.createDataFrame(judged(300, seed=4), SCHEMA)
    merged = counts.merged_counts(counts.score_counts(df, "run"))
    assert counts.roc_auc_of_counts(merged).first()[0] == evaluation.roc_auc(df).first()[0]


def test_missing_classes_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert figures(counts.score_counts(empty)) == (None, None)
    only = spark.createDataFrame([(1, "a", 0, 0.5)], SCHEMA)
    assert figures(counts.score_counts(only)) == (None, None)
    positive = spark.createDataFrame([(1, "a", 1, 0.5)], SCHEMA)
    assert figures(counts.score_counts(positive)) == (None, 1.0)
