"""Reason and action per incident; request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.functions.text import quoted, quoted_list, shortest_decimal, split_lines, strip

# --- fixed values ---------------------------------------------------------------------------
NORMAL_REASON = "Current signal pattern is consistent with normal cloud workload behavior."
NORMAL_ACTION = "Continue monitoring; keep current alert thresholds and verify periodic model drift checks."
ANOMALY_ACTION = (
    "Isolate affected workload, block suspicious traffic/credentials, and inspect related host and "
    "network logs for root cause."
)
PROMPT_LINES = (
    "Incident context:",
    "- event_name: %s",
    "- anomaly_detected: %s",
    "- anomaly_type: %s",
    "- severity_level: %s",
    "- max_anomaly_score: %.4f",
    "- triggered_experts: %s",
    "- classification_source: %s",
    "- classification_confidence: %.4f",
    "- classification_matched_rules: %s",
    "- classification_description: %s",
    "- event_names: %s",
    "- expert_predictions: %s",
    "",
    "Instructions:",
    "- Treat anomaly_type as final rule-based class.",
    "- reason: explain why this class fits these events and score.",
    "- action: give clear immediate mitigation steps specific to this class.",
    "Return strict JSON only with:",
    '{"reason":"<short cause>", "action":"<short immediate action list>"}',
)
# --------------------------------------------------------------------------------------------

_OBJECT = r"(?s)\{.*\}"


def heuristic_reason(detected: Column, anomaly_type: Column, severity: Column, triggered: Column) -> Column:
    experts = F.when(F.size(triggered) > 0, F.array_join(triggered, ", ")).otherwise(F.lit("none"))
    text = F.format_string(
        "%s anomaly detected with type '%s' from expert signals (%s).", severity, anomaly_type, experts
    )
    return F.when(detected, text).otherwise(F.lit(NORMAL_REASON))


def heuristic_action(detected: Column) -> Column:
    return F.when(detected, F.lit(ANOMALY_ACTION)).otherwise(F.lit(NORMAL_ACTION))


def heuristic_advice(df: DataFrame, triggered: str = "triggered_experts") -> DataFrame:
    """Add ``reason, action, advice_source`` from fixed wording."""
    detected = F.coalesce(F.col("anomaly_detected"), F.lit(False))
    return df.withColumns(
        {
            "reason": heuristic_reason(
                detected,
                F.coalesce("anomaly_type", F.lit("Normal")),
                F.coalesce("severity", F.lit("Low")),
                F.col(triggered),
            ),
            "action": heuristic_action(detected),
            "advice_source": F.lit("heuristic"),
        }
    )


def incident_prompt(incidents: DataFrame, incident: str = "incident", output: str = "prompt") -> DataFrame:
    """Add the fixed-layout prompt of an incident struct."""
    of = F.col(incident)

    def word(flag: Column) -> Column:
        return F.when(flag, F.lit("True")).otherwise(F.lit("False"))

    prompt = F.format_string(
        "\n".join(PROMPT_LINES),
        F.coalesce(of["event_name"], F.lit("unknown-event")),
        word(F.coalesce(of["anomaly_detected"], F.lit(False))),
        F.coalesce(of["anomaly_type"], F.lit("Normal")),
        F.coalesce(of["severity_level"], F.lit("Low")),
        F.coalesce(of["max_anomaly_score"], F.lit(0.0)),
        quoted_list(of["triggered_experts"]),
        F.coalesce(of["classification_source"], F.lit("unknown")),
        F.coalesce(of["classification_confidence"], F.lit(0.0)),
        quoted_list(of["classification_matched_rules"]),
        F.coalesce(of["classification_description"], F.lit("")),
        quoted_list(of["event_names"]),
        _prediction_list(of["predictions"]),
    )
    return incidents.withColumn(output, prompt)


def _prediction_list(predictions: Column) -> Column:
    def number(value: Column) -> Column:
        return shortest_decimal(value.cast("double"))

    def probabilities(entries: Column) -> Column:
        pairs = F.transform(
            F.map_entries(entries), lambda e: F.concat(quoted(e["key"]), F.lit(": "), number(e["value"]))
        )
        return F.concat(F.lit("{'class_probabilities': {"), F.array_join(pairs, ", "), F.lit("}}"))

    def one(p: Column) -> Column:
        return F.concat(
            F.lit("{'expert_name': "), quoted(p["expert_name"]),
            F.lit(", 'anomaly_score': "), number(p["anomaly_score"]),
            F.lit(", 'predicted_class': "), quoted(p["predicted_class"]),
            F.lit(", 'confidence': "), number(p["confidence"]),
            F.lit(", 'metadata': "), probabilities(p["class_probabilities"]),
            F.lit("}"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(predictions, one), ", "), F.lit("]"))


def parse_advice(df: DataFrame, response: str = "response_text") -> DataFrame:
    """Reason and action from an adviser's JSON answer.

    The whole answer is read as JSON object, else the part from the first to the last brace; without
    both texts the columns ``reason, action, advice_source`` keep their (heuristic) values.
    """
    text = strip(F.coalesce(F.col(response), F.lit("")))
    whole = F.try_parse_json(F.when(text.startswith("{") & text.endswith("}"), text))
    inner = F.try_parse_json(F.nullif(F.regexp_extract(text, _OBJECT, 0), F.lit("")))
    parsed = df.withColumn("__answer", F.coalesce(whole, inner))
    parsed = parsed.withColumns({"__reason": _answer_text("reason"), "__action": _answer_text("action")})
    answered = F.coalesce((F.col("__reason") != "") & (F.col("__action") != ""), F.lit(False))
    return parsed.withColumns(
        {
            "reason": F.when(answered, F.col("__reason")).otherwise(F.col("reason")),
            "action": F.when(answered, F.col("__action")).otherwise(F.col("action")),
            "advice_source": F.when(answered, F.lit("model")).otherwise(F.col("advice_source")),
        }
    ).drop("__answer", "__reason", "__action")


def _answer_text(field: str) -> Column:
    """A field as text; the JSON words true, false and null are spelt True, False, None."""
    value = F.try_variant_get("__answer", f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get("__answer", f"$.{field}", "string")
    return strip(
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(F.coalesce(text, F.lit("")))
    )


def single_input_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with exactly one of sequence, text and lines, and the rejected rest.

    The accepted rows get ``input_source`` and their ``lines``.
    """
    def filled(name: str) -> Column:
        return F.coalesce(strip(F.col(name)) != "", F.lit(False))

    given = {
        "event_sequence": filled("event_sequence"),
        "log_text": filled("log_text"),
        "log_lines": F.coalesce(F.size("log_lines") > 0, F.lit(False)),
    }
    flags = df.withColumn("__given", sum((flag.cast("int") for flag in given.values()), F.lit(0)))
    lines = (
        F.when(given["event_sequence"], F.array("event_sequence"))
        .when(given["log_text"], split_lines(F.col("log_text")))
        .otherwise(F.col("log_lines"))
    )
    accepted = flags.where(F.col("__given") == 1).select(
        *df.columns,
        F.when(given["event_sequence"], F.lit("event_sequence")).otherwise(F.lit("log_lines")).alias("input_source"),
        lines.alias("lines"),
    )
    return accepted, flags.where(F.col("__given") != 1).drop("__given")
