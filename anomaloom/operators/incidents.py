"""Incidents: rule classification, model gate, alerts, nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.functions import rules
from anomaloom.functions.numeric import clamp_score

# --- fixed values ---------------------------------------------------------------------------
NORMAL_TYPE = "Normal"
NORMAL_SEVERITY = "Low"
NORMAL_DESCRIPTION = "No anomaly pattern detected."
CLASSIFICATION_SOURCE = "rule_based"
EXPERT = "system_expert"
# --------------------------------------------------------------------------------------------


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column where the table has it, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def effective_score(df: DataFrame, output: str = "score") -> DataFrame:
    """``score``, else ``anomaly_score``, else 0, bounded to 0…1."""
    raw = F.coalesce(optional(df, "score", "double"), optional(df, "anomaly_score", "double"), F.lit(0.0))
    return df.withColumn(output, clamp_score(raw))


def classify(df: DataFrame, score: str = "score") -> DataFrame:
    """Add type, severity, confidence, matched rules and description from count columns and score.

    A pure projection: no shuffle, no look-up.
    """
    table = rules.rule_table(rules.named_count, F.col(score))
    typed = df.select(
        "*",
        rules.select_type(table).alias("anomaly_type"),
        rules.select_confidence(table, F.col(score)).alias("confidence"),
        rules.matched_rules(table).alias("matched_rules"),
    )
    kind = F.col("anomaly_type")
    return typed.select(
        "*",
        rules.severity(kind, rules.named_count, F.col(score)).alias("severity"),
        rules.description(kind).alias("description"),
    )


def gate_by_model(df: DataFrame, predicted: str = "predicted_class", normal: str = "Normal") -> DataFrame:
    """Keep the rule result only where the model saw an anomaly; add ``anomaly_detected``."""
    seen = F.col("anomaly_detected")

    def gated(name: str, otherwise: Column) -> Column:
        return F.when(seen, F.col(name)).otherwise(otherwise)

    return df.withColumn("anomaly_detected", F.coalesce(F.col(predicted) != normal, F.lit(True))).withColumns(
        {
            "anomaly_type": gated("anomaly_type", F.lit(NORMAL_TYPE)),
            "severity": gated("severity", F.lit(NORMAL_SEVERITY)),
            "confidence": gated("confidence", F.lit(1.0)),
            "matched_rules": gated("matched_rules", F.array().cast("array<string>")),
            "description": gated("description", F.lit(NORMAL_DESCRIPTION)),
        }
    )


def alert_columns(block_id: str) -> list[Column]:
    """The repeatable part of an alert."""
    return [
        F.col(block_id).cast("string").alias("block_id"),
        F.col("anomaly_type"),
        F.col("severity"),
        F.col("confidence"),
        F.col("description"),
        F.col("matched_rules"),
        rules.recommended_action(F.col("anomaly_type")).alias("recommended_action"),
    ]


def format_alert(df: DataFrame, block_id: str = "block_id") -> DataFrame:
    """Alert rows with a fresh id and the current UTC time."""
    return df.select(
        F.uuid().alias("alert_id"),
        F.current_timestamp().alias("timestamp"),
        *alert_columns(block_id),
    )


def triggered_experts() -> Column:
    return F.when(F.col("anomaly_detected"), F.array(F.lit(EXPERT))).otherwise(F.array().cast("array<string>"))


def incident_record(df: DataFrame) -> DataFrame:
    """Nested ``incident`` and ``response`` of each gated, scored and encoded sequence.

    Reads ``event_name, tokens, prediction`` (see the model operators), the gated rule columns, the
    token statistics, and where present the extraction counters and ``reason, action, advice_source``.
    """
    model = F.col("prediction")
    counters = {name: F.coalesce(optional(df, name, "bigint"), F.lit(0)) for name in
                ("from_event_id", "from_template", "unmatched_lines")}
    triggered = triggered_experts()
    incident = F.struct(
        "event_name",
        "anomaly_detected",
        "anomaly_type",
        F.col("severity").alias("severity_level"),
        model["anomaly_score"].alias("max_anomaly_score"),
        triggered.alias("triggered_experts"),
        F.lit(CLASSIFICATION_SOURCE).alias("classification_source"),
        F.col("confidence").alias("classification_confidence"),
        F.col("matched_rules").alias("classification_matched_rules"),
        F.col("description").alias("classification_description"),
        F.transform("tokens", F.upper).alias("event_names"),
        F.array(model).alias("predictions"),
    )
    response = F.struct(
        "event_name",
        F.struct(
            F.coalesce(optional(df, "input_source", "string"), F.lit("event_tokens")).alias("source"),
            optional(df, "input_value", "string").alias("source_value"),
            "event_token_count",
            F.transform("event_tokens_tail", F.lower).alias("event_tokens_tail"),
        ).alias("input"),
        "anomaly_detected",
        "anomaly_type",
        model["predicted_class"].alias("predicted_label"),
        model["anomaly_score"].alias("anomaly_score"),
        model["confidence"].alias("confidence"),
        F.col("description").alias("anomaly_description"),
        optional(df, "reason", "string").alias("reason"),
        optional(df, "action", "string").alias("action"),
        F.struct(
            F.col("severity").alias("severity_level"),
            triggered.alias("triggered_experts"),
            optional(df, "advice_source", "string").alias("advice_source"),
            F.lit(CLASSIFICATION_SOURCE).alias("classification_source"),
            F.col("confidence").alias("classification_confidence"),
            F.col("matched_rules").alias("classification_matched_rules"),
            "known_event_count",
            "unknown_event_count",
            "unknown_event_tokens",
            optional(df, "sequence_length", "int").alias("sequence_length"),
            counters["from_event_id"].alias("event_tokens_from_event_id"),
            counters["from_template"].alias("event_tokens_from_template_inference"),
            counters["unmatched_lines"].alias("unmatched_log_lines"),
        ).alias("metadata"),
    )
    return df.select(incident.alias("incident"), response.alias("response"))
