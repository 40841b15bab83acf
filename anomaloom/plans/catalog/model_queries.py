"""Queries that fit, score and select models."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.functions.numeric import argmax
from anomaloom.operators import convolution, models, surprise
from anomaloom.operators.classes import class_counts, class_table, inverse_frequency_weights, with_class_weight
from anomaloom.operators.epochs import EpochSettings, best_epoch, train_epochs, training_folder, with_logits
from anomaloom.operators.splits import stratified_split
from anomaloom.operators.vocab import build_vocab
from anomaloom.operators.windows import lay_out_windows
from anomaloom.plans.catalog.flow_queries import _keys_sql, _normal_sql, _numbered_sql, numbered_flows, split_windows
from anomaloom.plans.catalog.inputs import EV, EVENT_ORDER, LINES
from anomaloom.plans.catalog.log_queries import _LABELS, _TRACES, block_labels, block_traces, log_lines
from anomaloom.plans.catalog.registry import query, table
from anomaloom.plans.log_analysis import analyze_lines
from anomaloom.plans.training import train_and_evaluate
from anomaloom.session import shared_folder, stage
from anomaloom.sources.datasets import read_metrics_report, write_dataset

_NAMES = [f"class_{i}" for i in range(10)]


def embedding_dataset(spark: SparkSession, d: str) -> DataFrame:
    """``id, y, features, split`` of the labelled vectors."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("y"), array_to_vector("embedding").alias("features")
    )
    return stratified_split(rows.select("id", "y"), "y", ["id"]).join(rows.drop("y"), "id")


def _fitted(dataset: DataFrame):
    train = dataset.where(F.col("split") == "train")
    kinds = class_table(dataset.sparkSession, _NAMES)
    weights = inverse_frequency_weights(class_counts(train, kinds))
    return models.fit_classifier(with_class_weight(train, weights), weight="weight", maxIter=20, regParam=0.01)


_SPLIT_SIZES = """
sized AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
quotas AS (SELECT label, CASE WHEN n <= 2 THEN 1 ELSE CASE WHEN train + val >= n AND train > val THEN train - 1 ELSE train END END AS train,
    CASE WHEN n <= 2 THEN 0 ELSE CASE WHEN train + val >= n AND train <= val THEN val - 1 ELSE val END END AS val
  FROM (SELECT *, greatest(1, CAST(floor(n * 0.75e0) AS BIGINT)) AS train, greatest(1, CAST(floor(n * 0.10e0) AS BIGINT)) AS val FROM sized)),
placed AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label || ':' || vec_id), vec_id) AS rank FROM embeddings),
split AS (SELECT vec_id AS id, label AS y, CASE WHEN rank <= train THEN 'train' WHEN rank <= train + val THEN 'val' ELSE 'test' END AS split
  FROM placed JOIN quotas USING (label))
"""
_WHOLE = "1 AS sums_to_one, 1 AS argmax_is_class, 1 AS anomaly_is_rest"


def _checked(scored: DataFrame, names: list[str]) -> list:
    """What must hold of every prediction, as 0 or 1: SQL cannot fit the model, but it can say this."""
    of = F.col("prediction")
    p = F.transform(F.array(*(F.lit(name) for name in names)), lambda name: of["class_probabilities"][name])
    place = F.array_position(F.array(*(F.lit(name) for name in names)), of["predicted_class"])
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    normal = [i for i, name in enumerate(names) if name in models.NORMAL_NAMES]
    rest = 1.0 - p[normal[0]] if normal else F.array_max(p)
    return [
        (F.abs(total - 1.0) < 1e-9).cast("int").alias("sums_to_one"),
        (F.element_at(p, place.cast("int")) == F.array_max(p)).cast("int").alias("argmax_is_class"),
        (F.abs(of["anomaly_score"] - rest) < 1e-9).cast("int").alias("anomaly_is_rest"),
    ]


@query(f"WITH {_SPLIT_SIZES} SELECT id, y, split, {_WHOLE} FROM split")
def train_and_score(spark, d):
    """Every row of every split gets one prediction that is whole."""
    dataset = embedding_dataset(spark, d)
    scored = models.score(dataset, _fitted(dataset), _NAMES)
    return scored.select("id", "y", "split", *_checked(scored, _NAMES))


@query(f"""WITH {_SPLIT_SIZES}, rows AS (SELECT count(*) AS n FROM split WHERE split = 'test')
SELECT 'support' AS metric, CAST(n AS DOUBLE) AS value FROM rows UNION ALL SELECT 'cells', 100e0
UNION ALL SELECT 'in_range', 5e0""")
def evaluate_split(spark, d):
    """The report of a split: support and cells are known, and all metrics lie in their range."""
    dataset = embedding_dataset(spark, d)
    report = models.evaluate_split(dataset, "test", _fitted(dataset), class_table(spark, _NAMES), _NAMES)
    value = F.col("value")
    fine = F.when(F.col("metric") == "loss", value >= 0).otherwise(value.between(0, 1))
    parts = (
        report.per_class.agg(F.lit("support").alias("metric"), F.sum("support").cast("double").alias("value")),
        report.confusion.agg(F.lit("cells").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")),
        report.summary.agg(F.lit("in_range").alias("metric"), F.count_if(fine).cast("double").alias("value")),
    )
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {_SPLIT_SIZES} SELECT id, 1 AS is_class, 1 AS sums_to_one FROM split")
def search_classifier(spark, d):
    """Every row gets a known class and a whole distribution from the model of the best setting."""
    dataset = embedding_dataset(spark, d)
    found = models.search_classifier(dataset.where(F.col("split") == "train"), regularisation=(0.001, 0.1))
    scored = found.bestModel.transform(dataset)
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda acc, x: acc + x)
    return scored.select(
        "id",
        F.col("prediction").isin(*range(10)).cast("int").alias("is_class"),
        (F.abs(total - 1.0) < 1e-9).cast("int").alias("sums_to_one"),
    )


@query(f"""WITH {_SPLIT_SIZES}, shares AS (SELECT split, y, count(*) AS n FROM split GROUP BY 1, 2),
grid AS (SELECT s.split, c.y FROM (VALUES ('val'), ('test')) s(split) CROSS JOIN range(10) c(y))
SELECT split, CAST(y AS INTEGER) AS class_index, coalesce(n, 0) AS support, 2 AS settings FROM grid LEFT JOIN shares USING (split, y)""")
def training_report(spark, d):
    """Vectors as windows of one row through the whole training job; what its report says of every
    model: the support of each class, as read back from the written file."""
    base = f"{shared_folder(spark).rstrip('/')}/training-{uuid.uuid4().hex}"
    split = embedding_dataset(spark, d).select("id", F.col("y").cast("bigint").alias("y"), "split")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array("embedding").alias("X"))
    write_dataset(split.join(vectors, "id"), f"{base}/data", {"classes": class_table(spark, _NAMES)})
    settings = ({"regParam": 0.01, "maxIter": 5}, {"regParam": 0.1, "maxIter": 5})
    train_and_evaluate(spark, f"{base}/data", f"{base}/out", ["id"], windows=True, settings=settings, balance="weights")
    written = read_metrics_report(spark, f"{base}/out/report")
    parts = [
        written.select(
            F.lit(name).alias("split"), F.lit(i).alias("class_index"),
            F.col(f"metrics.{place}.per_class.class_{i}.support").alias("support"), F.size("metrics.history").alias("settings"),
        )
        for name, place in (("val", "best_val"), ("test", "test"))
        for i in range(10)
    ]
    return reduce(DataFrame.unionByName, parts)


def block_model(spark: SparkSession, d: str):
    """Labelled blocks and a classifier on their token counts."""
    rows = block_traces(spark, d).join(block_labels(spark, d), "block_id")
    return rows, models.fit_classifier(rows, "label", stages=models.sequence_features(buckets=256), maxIter=10)


@query(f"WITH {EV}, {_LABELS}, {_TRACES} SELECT block_id, label, {_WHOLE} FROM traces JOIN labels_of USING (block_id)")
def sequence_classifier(spark, d):
    """Every labelled block gets one prediction that is whole."""
    rows, model = block_model(spark, d)
    names = ["Normal", "Anomaly"]
    scored = models.score(rows, model, names)
    return scored.select("block_id", "label", *_checked(scored, names))


@query(f"""WITH {LINES} SELECT CAST(user_id AS VARCHAR) AS event_name, count(*) AS event_token_count,
  (SELECT count(*) FROM lines l WHERE l.user_id = e.user_id) || ' line(s)' AS source_value, 128 AS sequence_length FROM extracted e GROUP BY e.user_id""")
def analyze_log_lines(spark, d):
    """Lines of a user to incident and response, with a model on block sequences; what the model does
    not touch is compared."""
    rows, model = block_model(spark, d)
    vocab = build_vocab(rows, ["block_id"])
    records = analyze_lines(log_lines(spark, d), ["user_id"], EVENT_ORDER, vocab, model, ["Normal", "Anomaly"])
    return records.select(
        "response.event_name", "response.input.event_token_count", "response.input.source_value", "response.metadata.sequence_length"
    )


@query("""SELECT vec_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS class_index,
  round(greatest(a, b, c), 4) AS confidence, round(1e0 - a, 4) AS anomaly_score
FROM (SELECT vec_id, x / (x + y + z) AS a, y / (x + y + z) AS b, z / (x + y + z) AS c FROM (
  SELECT vec_id, exp(4e0 * embedding[1]) AS x, exp(4e0 * embedding[2]) AS y, exp(4e0 * embedding[3]) AS z FROM embeddings))""")
def score_external(spark, d):
    """A user's own model, here logits from the first three values."""

    def build():
        return lambda batch: batch[:, :3].astype(np.float64) * 4.0

    names = ["Normal", "AttackA", "AttackB"]
    scored = models.score_external(table(spark, d, "embeddings"), build, "embedding", [64], names)
    index = F.array_position(F.array(*(F.lit(name) for name in names)), F.col("prediction.predicted_class")) - 1
    return scored.select(
        "vec_id", index.cast("int").alias("class_index"),
        F.round("prediction.confidence", 4).alias("confidence"),
        F.round("prediction.anomaly_score", 4).alias("anomaly_score"),
    )


@query("""WITH reports AS (SELECT CAST(substr(source, 4) AS INTEGER) AS epoch, round(avg(quality), 1) AS macro_f1, count(*) AS n
  FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT epoch, macro_f1, n FROM reports ORDER BY macro_f1 DESC, epoch LIMIT 1""")
def select_best(spark, d):
    """Each source as an epoch, its share of good documents as the metric."""
    judged = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    reports = judged.groupBy(F.substring("source", 4, 9).cast("int").alias("epoch")).agg(
        F.round(F.avg("quality"), 1).alias("macro_f1"), F.count(F.lit(1)).alias("n")
    )
    return models.select_best(reports)


@query(f"""WITH {_numbered_sql()} {_keys_sql(64, 4)}
SELECT keys.file, w, 20 AS n, round(sum(l_quantity) / 64e0, 3) AS mean_quantity,
  round(sqrt(greatest(0e0, sum(l_quantity * l_quantity) / 64e0 - (sum(l_quantity) / 64e0) ** 2)), 3) AS deviation,
  max(l_quantity) FILTER (rn = last_rn) AS last_quantity,
  max(l_quantity) FILTER (rn = last_rn) - coalesce(max(l_quantity) FILTER (rn = last_rn - 63), 0e0) AS change
FROM keys JOIN numbered ON numbered.file = keys.file AND rn BETWEEN last_rn - 63 AND last_rn GROUP BY keys.file, w, last_rn""")
def window_features(spark, d):
    """Summary vector of every flow window; short files have zero rows in front."""
    windows = lay_out_windows(numbered_flows(spark, d), 64, 4)
    x = F.col("x")
    return windows.select("file", "w", vector_to_array(models.window_features(F.col("window"))).alias("x")).select(
        "file", "w", F.size(x).alias("n"),
        F.round(x[0], 3).alias("mean_quantity"), F.round(x[5], 3).alias("deviation"),
        x[10].alias("last_quantity"), x[15].alias("change"),
    )


# --- training by epochs ---------------------------------------------------------------------

def marked_blocks(spark: SparkSession, d: str) -> DataFrame:
    """``id, y, features, split``: which of 29 events a user's day has; an anomaly (1) is a day with event 7."""
    k = F.get_json_object("props", "$.k").cast("int") % 29 + 1
    days = table(spark, d, "events").select(
        F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), k.alias("event")
    )
    seen = days.groupBy("id").agg(*(F.max(F.coalesce((F.col("event") == i).cast("int"), F.lit(0))).alias(f"e{i}") for i in range(1, 30)))
    rows = seen.select("id", F.col("e7").alias("y"), F.array(*(F.col(f"e{i}") for i in range(1, 30))).alias("features"))
    part = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(10))
    return rows.withColumn("split", F.when(part < 7, "train").when(part < 9, "val").otherwise("test"))


@query("""WITH days AS (
  SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d') AS id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 29 + 1 AS event
  FROM events)
SELECT id, CAST(bool_or(coalesce(event = 7, false)) AS INTEGER) AS predicted FROM days GROUP BY id""")
def epoch_training(spark, d):
    """Class that the best epoch's model gives to every row: the rule behind the labels, which it has to learn."""
    rows = marked_blocks(spark, d)
    folder = training_folder(spark, f"epochs-{uuid.uuid4().hex}")
    settings = EpochSettings(epochs=6, batches=24, learning_rate=0.5, patience=3)
    history = train_epochs(rows, folder, 2, settings)
    return with_logits(rows, best_epoch(history)).select("id", argmax(F.col("logits")).alias("predicted"))


# --- order and time -------------------------------------------------------------------------

# Quantity and discount under six kernels each.
_BANK = convolution.kernel_bank((0, 2), 64, 6)
_BANK_SQL = ", ".join(f"({i}, {k.feature}, {k.dilation}, {', '.join(map(str, k.high))})" for i, k in enumerate(_BANK))
_NINE = " + ".join(f"x[t + {tap} * d]" for tap in range(convolution.TAPS))


def _series_sql(column: str) -> str:
    rows = f"list(CAST(CAST({column} AS FLOAT) AS DOUBLE) ORDER BY rn)"
    return f"list_concat([0e0 for i in range(64 - max(n_rows))], {rows})"


@query(_normal_sql("l_suppkey", 64, 4) + f""",
bank(kernel, feature, d, a, b, c) AS (VALUES {_BANK_SQL}),
series AS (SELECT keys.file, w, {_series_sql("l_quantity")} AS x0, {_series_sql("l_discount")} AS x2
  FROM keys JOIN numbered ON numbered.file = keys.file AND rn BETWEEN last_rn - 63 AND last_rn GROUP BY 1, 2),
answers AS (SELECT file, w, kernel,
    [3e0 * (x[t + a * d] + x[t + b * d] + x[t + c * d]) - ({_NINE}) for t in range(1, 65 - 8 * d)] AS r
  FROM (SELECT *, CASE feature WHEN 0 THEN x0 ELSE x2 END AS x FROM series CROSS JOIN bank)),
limits AS (SELECT kernel, sum(list_sum(r)) / sum(len(r)) AS bound FROM answers JOIN train USING (file, w) GROUP BY 1)
SELECT file, w, CAST(kernel AS INTEGER) AS kernel, round(list_max(r), 4) AS top, round(len([v for v in r if v > bound]) / len(r), 6) AS share
FROM answers JOIN limits USING (kernel)""")
def temporal_features(spark, d):
    """Largest response and share above the train windows' mean, of every window and kernel."""
    numbered = numbered_flows(spark, d)
    laid_out = stage(lay_out_windows(numbered, 64, 4), "windows")
    train = split_windows(numbered, 64, 4).where(F.col("split") == "train").select("file", "w")
    # The blocks of the train windows are shipped once more, a fraction of the windows themselves.
    limits = convolution.fit_thresholds(lay_out_windows(numbered, 64, 4, selected=train), _BANK, 64)
    values = convolution.convolution_values(F.col("window"), _BANK, 64, limits)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(len(_BANK) - 1)), lambda i: F.struct(
        i.alias("kernel"), F.get("values", i * 2).alias("top"), F.get("values", i * 2 + 1).alias("share")
    ))
    rows = laid_out.select("file", "w", values.alias("values")).select("file", "w", F.inline_outer(pairs))
    return rows.withColumns({"top": F.round("top", 4), "share": F.round("share", 6)})


def _gram_counts(name: str, keys: str, count: str) -> str:
    return f"{name} AS (SELECT {keys}, count(*) AS {count} FROM known GROUP BY ALL)"


@query(f"""WITH {EV}, {_LABELS},
grams AS (SELECT block_id, lag(event, 2) OVER o AS a, lag(event) OVER o AS b, event FROM ev WINDOW o AS (PARTITION BY block_id ORDER BY ts, event_id)),
known AS (SELECT grams.* FROM grams JOIN labels_of USING (block_id) WHERE label = 0),
{_gram_counts("abe", "a, b, event", "n_abe")}, {_gram_counts("ab", "a, b", "n_ab")}, {_gram_counts("be", "b, event", "n_be")},
{_gram_counts("ball", "b", "n_b")}, {_gram_counts("e", "event", "n_e")},
size AS (SELECT count(*) AS n, 1e0 / (count(DISTINCT event) + 1) AS even FROM known),
found AS (SELECT g.block_id, coalesce(n_abe, 0) / n_ab AS long, coalesce(n_be, 0) / n_b AS short, coalesce(n_e, 0) / n AS base, even
  FROM grams g LEFT JOIN abe ON abe.a IS NOT DISTINCT FROM g.a AND abe.b IS NOT DISTINCT FROM g.b AND abe.event = g.event
  LEFT JOIN ab ON ab.a IS NOT DISTINCT FROM g.a AND ab.b IS NOT DISTINCT FROM g.b
  LEFT JOIN be ON be.b IS NOT DISTINCT FROM g.b AND be.event = g.event LEFT JOIN ball ON ball.b IS NOT DISTINCT FROM g.b
  LEFT JOIN e ON e.event = g.event CROSS JOIN size),
rated AS (SELECT block_id, -ln(0.05e0 * even + CASE WHEN short IS NULL THEN 0.95e0 * base WHEN long IS NULL THEN 0.1e0 * base + 0.85e0 * short
  ELSE 0.1e0 * base + 0.25e0 * short + 0.6e0 * long END) AS cost FROM found)
SELECT block_id, count(*) AS n_events, round(avg(cost), 6) AS surprise, round(max(cost), 6) AS peak FROM rated GROUP BY 1""")
def sequence_surprise(spark, d):
    """How unexpected the events of every block are, after the blocks labelled normal."""
    traces = stage(block_traces(spark, d), "traces")
    normal = block_labels(spark, d).where(F.col("label") == 0).select("block_id")
    model = surprise.fit_next_events(traces.join(normal, "block_id"))
    rated = surprise.sequence_surprise(traces, model, ["block_id"])
    return rated.withColumns({"surprise": F.round("surprise", 6), "peak": F.round("peak", 6)})
