"""The online path: log stream -> events -> incidents -> alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from anomaloom.operators.events import event_counts, extract_events
from anomaloom.operators.incidents import alert_columns, classify, effective_score


def read_log_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of text files as they arrive: ``source, line``."""
    return (
        spark.readStream.options(**options)
        .text(path)
        .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))
    )


def stream_extract(lines: DataFrame, line: str = "line") -> DataFrame:
    """Events of streamed lines; stateless, the batch operator itself."""
    return extract_events(lines, line)


def stream_incidents(
    events: DataFrame,
    key: Sequence[str],
    time: str,
    watermark: str,
    window: Column,
    event: str = "event",
    score: str | None = None,
) -> DataFrame:
    """Classified incidents per key and ``window`` (``F.window`` or ``F.session_window`` on ``time``).

    The state of a key is its fifteen rule counts and its top score, however many events it gets;
    rows later than the watermark that the batch before went by are dropped. Works on a batch DataFrame as well.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    extra = [F.max(score).alias("score")] if score else []
    counted = event_counts(timed.withColumn("__window", window), ["__window", *key], event, *extra)
    opened = counted.select(
        *key,
        F.col("__window.start").alias("window_start"),
        F.col("__window.end").alias("window_end"),
        *(name for name in counted.columns if name not in ("__window", *key)),
    )
    return classify(effective_score(opened))


def write_alerts_stream(incidents: DataFrame, block_id: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append alerts as JSON files; the checkpoint folder makes restarts exactly-once.

    ``alert_id`` follows from block and window, so a batch that is replayed gives the same ids.
    """
    alerts = incidents.select(
        F.md5(F.concat_ws("/", F.col(block_id).cast("string"), "window_start", "window_end")).alias("alert_id"),
        F.col("window_start"), F.col("window_end"), F.current_timestamp().alias("timestamp"), *alert_columns(block_id)
    )
    return (
        alerts.writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
