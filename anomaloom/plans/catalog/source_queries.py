"""Queries through files: derived CSV, text, JSON and Parquet are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from anomaloom.operators.events import extract_events
from anomaloom.operators.flows import valid_flows
from anomaloom.operators.incidents import classify, format_alert
from anomaloom.operators.ranking import row_number_by_bucket
from anomaloom.operators.windows import valid_row_number as number_scanned_rows
from anomaloom.plans.catalog.flow_queries import _CELL_SQL, _SPLIT, raw_cell, split_events
from anomaloom.plans.catalog.incident_queries import counted_blocks
from anomaloom.plans.catalog.inputs import EV, FLOWS, LINES, RULES, flows, log_lines
from anomaloom.plans.catalog.log_queries import _LABELS, _TRACES, block_traces, raw_labels
from anomaloom.plans.catalog.registry import query, table
from anomaloom.session import shared_folder
from anomaloom.sources import csv_files, datasets, logs
from anomaloom.streaming.incidents import read_log_stream, stream_extract, stream_incidents, write_alerts_stream


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {EV}, {_TRACES} SELECT block_id, array_to_string(tokens, ' ') AS tokens FROM traces")
def read_event_traces(spark, d):
    path = _path(spark, "traces")
    traces = block_traces(spark, d).select(
        F.concat(F.lit("'"), "block_id", F.lit("' ")).alias("blk_id"), F.upper(F.array_join("tokens", " , ")).alias(" EventSequence")
    )
    traces.write.option("header", True).csv(path)
    return csv_files.read_event_traces(spark, path).select("block_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {EV}, {_LABELS} SELECT block_id, label FROM labels_of")
def read_block_labels(spark, d):
    """Files whose names follow the order, so that the later row of a block is the later event."""
    path = _path(spark, "labels")
    ordered = raw_labels(spark, d).orderBy("ts", "event_id").select(F.col("BlockId").alias("blockid"), F.col("Label").alias("is_anomaly"))
    ordered.write.option("header", True).option("escape", '"').csv(path)
    return csv_files.read_block_labels(spark, path)


@query(f"""WITH {FLOWS}, cells AS (SELECT *, {_CELL_SQL} AS cell FROM fine WHERE fine_label IS NOT NULL)
SELECT fine_label AS label, count(*) AS n, round(sum(l_quantity), 1) AS quantity,
  round(sum(CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity + 0.5e0 WHEN 4 THEN 1000e0 + l_quantity
    WHEN 6 THEN CASE WHEN l_tax > 0.04 THEN 0e0 ELSE -100e0 * l_quantity END ELSE 0e0 END), 1) AS cell,
  round(sum(l_quantity + l_linenumber), 1) AS packets, 0e0 AS pad FROM cells GROUP BY 1""")
def read_flow_csvs(spark, d):
    """Several CSV files with messy cells; ids are left out, totals added, padding to five."""
    path = _path(spark, "flows")
    wide = flows(spark, d).select(
        F.col("l_orderkey").alias("Flow ID"), F.col("l_quantity").alias("Tot Fwd Pkts"), raw_cell().alias("Odd"),
        F.col("l_linenumber").alias("Tot Bwd Pkts"), F.col("raw_label").alias("Label "),
    )
    wide.repartition(4).write.option("header", True).option("escape", '"').csv(path)
    table = csv_files.read_flow_csvs(spark, path, target_count=6)
    x = [F.col("features")[i].cast("double") for i in range(6)]
    sums = {"quantity": x[0], "cell": x[1], "packets": x[3], "pad": x[5]}
    return valid_flows(table.rows).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.sum(value), 1).alias(name) for name, value in sums.items())
    )


@query(f"WITH {LINES} SELECT event, count(*) AS n FROM extracted GROUP BY 1")
def read_log_files(spark, d):
    path = _path(spark, "log")
    log_lines(spark, d).select("line").write.text(path)
    return extract_events(logs.read_log_files(spark, path)).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT user_id, ts, event_id, line, row_number() OVER (ORDER BY ts, event_id) AS rn FROM lines".replace("user_id, ts, event_id, line,", "line,"))
def scanned_row_number(spark, d):
    """Row numbers of a sorted text over its files, whose names follow the order, and their splits."""
    path = _path(spark, "sorted")
    log_lines(spark, d).orderBy("ts", "event_id").select("line").write.text(path)
    numbered = number_scanned_rows(logs.read_log_files(spark, path).withColumnRenamed("source", "file"), "in_file")
    return row_number_by_bucket(numbered, [], ["file"], ["in_file"], "rn").select("line", "rn")


@query(f"WITH {_SPLIT} SELECT event_id, CAST(event_id AS BIGINT) AS y FROM split WHERE split = 'val'")
def load_split(spark, d):
    path = _path(spark, "dataset")
    rows = split_events(spark, d).select("event_id", F.array("event_type").alias("features"), F.array("event_id").alias("labels"), "split")
    datasets.write_dataset(rows, path)
    val = datasets.load_split(datasets.read_dataset(spark, f"{path}/data"), "val")
    return val.select("event_id", "y")


@query("""SELECT l_orderkey * 8 + l_linenumber AS y, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
  l_tax AS tax FROM lineitem""")
def array_containers(spark, d):
    """Flow rows of two by two features written as array containers and read by ranges of rows."""
    path = _path(spark, "arrays")
    rows = table(spark, d, "lineitem").select(
        F.array(F.array("l_quantity", "l_extendedprice"), F.array("l_discount", "l_tax")).alias("X"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("y"),
    )
    datasets.write_arrays(rows, path)
    x = F.col("X")
    return datasets.read_arrays(spark, path, feature_type="double").select(
        "y", x[0][0].alias("quantity"), x[0][1].alias("price"), x[1][0].alias("discount"), x[1][1].alias("tax")
    )


@query(f"WITH {RULES} SELECT anomaly_type, severity, count(*) AS n FROM classified GROUP BY 1, 2")
def write_alerts(spark, d):
    path = _path(spark, "alerts")
    datasets.write_alerts(format_alert(classify(counted_blocks(spark, d))), path)
    return spark.read.json(path).groupBy("anomaly_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RULES} SELECT anomaly_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM classified GROUP BY 1")
def metrics_report(spark, d):
    path = _path(spark, "report")
    report = classify(counted_blocks(spark, d)).groupBy("anomaly_type").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).alias("m")
    )
    datasets.write_metrics_report(report, path)
    return datasets.read_metrics_report(spark, path).select("anomaly_type", "m.n", "m.confidence")


# --- streams --------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT event, count(*) AS n FROM extracted GROUP BY 1")
def stream_extract_events(spark, d):
    """Text files arriving as a stream, their events appended to Parquet."""
    inbox, out = _path(spark, "inbox"), _path(spark, "events")
    log_lines(spark, d).select("line").write.text(inbox)
    found = stream_extract(read_log_stream(spark, inbox))
    job = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "progress"))
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV.replace("'blk_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d')", "CAST(user_id AS VARCHAR) || '@' || strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')")},
closed AS (SELECT * FROM ev WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)),
{RULES.replace(EV, '').lstrip().lstrip(',').replace('FROM ev GROUP BY', 'FROM closed GROUP BY')}
SELECT block_id, anomaly_type, severity, confidence FROM classified""")
def stream_alerts(spark, d):
    """Daily incidents of every user from a stream, through the alert sink; windows that the
    watermark has not closed stay open."""
    incidents = stream_incidents(_arriving_events(spark, d), ["user_id"], "ts", "1 hour", F.window("ts", "1 day"), score="score")
    return _sunk_alerts(spark, incidents, "stream-alerts")


def _arriving_events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("int")
    return arriving.select("ts", "user_id", F.concat(F.lit("E"), (k % 29 + 1).cast("string")).alias("event"), (k / 100.0).alias("score"))


def _sunk_alerts(spark, incidents, name):
    """Alerts that the stream has left in its sink, named by user and start of the window."""
    out, progress = _path(spark, name), _path(spark, "progress")
    write_alerts_stream(incidents, "user_id", out, progress).awaitTermination()
    alerts = spark.read.json(out)
    start = F.date_format(F.col("window_start").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return alerts.select(F.concat("block_id", F.lit("@"), start).alias("block_id"), "anomaly_type", "severity", "confidence")


@query(f"""WITH {EV},
opened AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM ev),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM opened),
bounded AS (
  SELECT *, min(ts) OVER (PARTITION BY user_id, session) AS first_ts, max(ts) OVER (PARTITION BY user_id, session) AS last_ts
  FROM numbered),
closed AS (
  SELECT event, k, CAST(user_id AS VARCHAR) || '@' || strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS block_id
  FROM bounded WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)),
{RULES.replace(EV, '').lstrip().lstrip(',').replace('FROM ev GROUP BY', 'FROM closed GROUP BY')}
SELECT block_id, anomaly_type, severity, confidence FROM classified""")
def stream_sessions(spark, d):
    """Incidents of every user's sessions (six quiet hours end one) from a stream, through the alert
    sink; sessions that the watermark has not closed stay open."""
    incidents = stream_incidents(_arriving_events(spark, d), ["user_id"], "ts", "1 hour", F.session_window("ts", "6 hours"), score="score")
    return _sunk_alerts(spark, incidents, "stream-sessions")
