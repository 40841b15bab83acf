"""Statistics over classified result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from anomaloom.functions.text import normalize_events, tokens_from_sequence
from anomaloom.operators.events import with_event_counts
from anomaloom.operators.incidents import classify, effective_score, optional


def classify_records(records: DataFrame) -> DataFrame:
    """Type, severity and score of loose result records; a type or severity the record brings along
    replaces the computed one. Other columns are kept."""
    own = records.withColumns(
        {
            "__type": optional(records, "anomaly_type", "string"),
            "__severity": optional(records, "severity", "string"),
            "__events": normalize_events(
                tokens_from_sequence(
                    optional(records, "event_names", "array<string>"),
                    optional(records, "event_sequence", "string"),
                )
            ),
        }
    ).drop("anomaly_type", "severity", "confidence", "matched_rules", "description")
    classified = classify(effective_score(with_event_counts(own, F.col("__events"))))
    return classified.select(
        *(F.col(name) for name in records.columns if name not in ("anomaly_type", "severity", "score")),
        "score",
        F.coalesce("__type", "anomaly_type").alias("anomaly_type"),
        F.coalesce("__severity", "severity").alias("severity"),
    )


def anomaly_type_stats(classified: DataFrame) -> DataFrame:
    """Count and mean score (4 decimals) per type."""
    return classified.groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("average_score")
    )


def most_common_severity(classified: DataFrame, order: Sequence[str]) -> DataFrame:
    """The most frequent severity, ties by first record; ``Unknown`` without records."""
    # One numeric column keeps this a hash aggregate; several need a struct, which sorts.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    counts = classified.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_at"))
    top = F.min_by("severity", F.struct(-F.col("n"), F.col("first_at")))
    return counts.agg(F.coalesce(top, F.lit("Unknown")).alias("most_common_severity"))


def timeline(classified: DataFrame, order: Sequence[str]) -> DataFrame:
    """Records with a timestamp, in the order of the timestamp text, then of ``order``."""
    return (
        classified.where(F.col("timestamp").isNotNull())
        .orderBy("timestamp", *order)
        .select(
            "timestamp",
            F.coalesce(optional(classified, "block_id", "string"), F.lit("unknown")).alias("block_id"),
            "anomaly_type",
            "severity",
            F.round("score", 4).alias("score"),
        )
    )
