"""Queries over scored rows: probabilities, confusion, rates, ranks, losses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.operators import evaluation
from anomaloom.operators.classes import class_table
from anomaloom.operators.score_counts import (
    average_precision_of_counts,
    merged_counts,
    read_score_counts,
    roc_auc_of_counts,
    write_score_counts,
)
from anomaloom.plans.catalog.inputs import JUDGED, SCORED, judged_documents, scored_embeddings
from anomaloom.plans.catalog.registry import query, table
from anomaloom.session import shared_folder, stage

_NAMES = [f"class_{i}" for i in range(10)]


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_probabilities(scored_embeddings(spark, d))


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_matrix(_predicted(spark, d), 10)


def _per_class(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_class_metrics(_confusion(spark, d), class_table(spark, _NAMES))


@query(f"WITH {SCORED} SELECT id, prediction, round(top_p, 6) AS top_p, round(total_p, 6) AS total_p FROM scored")
def softmax_argmax(spark, d):
    p = F.col("probabilities")
    return _predicted(spark, d).select(
        "id", "prediction",
        F.round(F.array_max(p), 6).alias("top_p"),
        F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total_p"),
    )


@query(f"WITH {SCORED} SELECT label, prediction, n FROM confusion")
def confusion_matrix(spark, d):
    return _confusion(spark, d)


@query(f"WITH {SCORED} SELECT round(avg((label = prediction)::INTEGER), 6) AS accuracy FROM scored")
def accuracy(spark, d):
    return evaluation.accuracy(_predicted(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {SCORED} SELECT class_index, class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class")
def per_class_metrics(spark, d):
    rounded = {name: F.round(name, 6) for name in ("precision", "recall", "f1")}
    return _per_class(spark, d).withColumns(rounded)


@query(f"WITH {SCORED} SELECT round(avg(f1), 6) AS macro_f1 FROM per_class")
def macro_f1(spark, d):
    return evaluation.macro_f1(_per_class(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {SCORED} SELECT round(avg(-ln(label_p)), 6) AS loss FROM scored")
def log_loss(spark, d):
    return evaluation.log_loss(scored_embeddings(spark, d)).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {SCORED} SELECT round(sum(-ln(label_p) * (1 + label)) / sum(1 + label), 6) AS loss FROM scored")
def weighted_log_loss(spark, d):
    rows = scored_embeddings(spark, d).withColumn("weight", (F.col("label") + 1).cast("double"))
    return evaluation.log_loss(rows, weight="weight").select(F.round("loss", 6).alias("loss"))


@query(f"WITH {SCORED} SELECT id, (label <> 0)::INTEGER AS anomaly, round(1e0 - normal_p, 6) AS anomaly_score FROM scored")
def anomaly_scores(spark, d):
    scored = evaluation.anomaly_columns(_predicted(spark, d))
    return scored.select("id", "anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


_RANKED = """,
ranked AS (SELECT *, (min(place) OVER (PARTITION BY anomaly_score) + max(place) OVER (PARTITION BY anomaly_score)) / 2e0 AS avg_rank
  FROM (SELECT *, row_number() OVER (ORDER BY anomaly_score) AS place FROM judged))
"""


@query(f"WITH {JUDGED} {_RANKED} SELECT id, anomaly_score, avg_rank FROM ranked")
def average_rank(spark, d):
    ranked = evaluation.with_average_rank(judged_documents(spark, d), "anomaly_score")
    return ranked.select("id", "anomaly_score", "avg_rank")


@query(f"""WITH {JUDGED} {_RANKED}, sums AS (SELECT sum(avg_rank) FILTER (anomaly = 1) AS s, count(*) FILTER (anomaly = 1) AS p, count(*) FILTER (anomaly <> 1) AS q FROM ranked)
SELECT round((s - p * (p + 1) / 2e0) / (p * q), 6) AS roc_auc FROM sums""")
def roc_auc(spark, d):
    return evaluation.roc_auc(judged_documents(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"""WITH {JUDGED}, running AS (SELECT anomaly, row_number() OVER w AS seen, sum(anomaly) OVER w AS found FROM judged
  WINDOW w AS (ORDER BY anomaly_score DESC, id ROWS UNBOUNDED PRECEDING))
SELECT round(sum(found / seen) FILTER (anomaly = 1) / count(*) FILTER (anomaly = 1), 6) AS average_precision FROM running""")
def average_precision(spark, d):
    precision = evaluation.average_precision(judged_documents(spark, d))
    return precision.select(F.round("average_precision", 6).alias("average_precision"))


@query(f"""WITH {JUDGED} {_RANKED}, sums AS (SELECT sum(avg_rank) FILTER (anomaly = 1) AS s, count(*) FILTER (anomaly = 1) AS p, count(*) FILTER (anomaly <> 1) AS q FROM ranked),
per_score AS (SELECT anomaly_score, count(*) AS n, sum(anomaly) AS positives FROM judged GROUP BY 1),
running AS (SELECT positives, sum(n) OVER w AS seen, sum(positives) OVER w AS found FROM per_score WINDOW w AS (ORDER BY anomaly_score DESC))
SELECT round((s - p * (p + 1) / 2e0) / (p * q), 6) AS roc_auc,
  (SELECT round(sum(positives * found / seen) / sum(positives), 6) FROM running) AS average_precision FROM sums""")
def folded_metrics(spark, d):
    """Both figures from stored counts of runs, one of which was written twice."""
    path = f"{shared_folder(spark).rstrip('/')}/score-counts-{uuid.uuid4().hex}"
    judged = judged_documents(spark, d).withColumn("run", F.substring(F.md5(F.col("id").cast("string")), 1, 1))
    write_score_counts(judged, path)
    write_score_counts(judged.where("run = 'a'"), path)
    merged = stage(merged_counts(read_score_counts(spark, path)), "merged-counts")
    figures = roc_auc_of_counts(merged).select(F.round("roc_auc", 6).alias("roc_auc"))
    precision = average_precision_of_counts(merged).first()[0]
    return figures.withColumn("average_precision", F.round(F.lit(precision), 6))


@query(f"""WITH {SCORED} SELECT class_index, 'Very low support for class ''' || class_name || ''' in evaluation split (support=' || support
  || '). Metrics for this class are unstable.' AS warning FROM per_class WHERE support < 50""")
def support_warnings(spark, d):
    return evaluation.support_warnings(_per_class(spark, d), 50)


@query("SELECT CAST(i AS INTEGER) AS class_index, 'class_' || i AS class_name FROM range((SELECT max(label) + 1 FROM embeddings)) t(i)")
def infer_class_count(spark, d):
    return evaluation.default_class_names(evaluation.infer_class_count(table(spark, d, "embeddings")))


@query(f"""WITH {SCORED},
ranked AS (SELECT *, (min(place) OVER (PARTITION BY normal_p) + max(place) OVER (PARTITION BY normal_p)) / 2e0 AS avg_rank
  FROM (SELECT *, row_number() OVER (ORDER BY normal_p DESC) AS place FROM scored)),
area AS (SELECT sum(avg_rank) FILTER (label <> 0) AS s, count(*) FILTER (label <> 0) AS p, count(*) FILTER (label = 0) AS q FROM ranked),
running AS (SELECT label, row_number() OVER w AS seen, sum((label <> 0)::INTEGER) OVER w AS found FROM scored WINDOW w AS (ORDER BY normal_p, id ROWS UNBOUNDED PRECEDING))
SELECT 'loss' AS metric, round(avg(-ln(label_p)), 4) AS value FROM scored
UNION ALL SELECT 'accuracy', round(avg((label = prediction)::INTEGER), 4) FROM scored
UNION ALL SELECT 'macro_f1', round(avg(f1), 4) FROM per_class
UNION ALL SELECT 'roc_auc', round((s - p * (p + 1) / 2e0) / (p * q), 4) FROM area
UNION ALL SELECT 'average_precision', round(sum(found / seen) FILTER (label <> 0) / count(*) FILTER (label <> 0), 4) FROM running""")
def classification_report(spark, d):
    report = evaluation.classification_report(scored_embeddings(spark, d), class_table(spark, _NAMES), 10)
    return report.summary.select("metric", F.round("value", 4).alias("value"))
