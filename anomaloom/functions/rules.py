"""Incident rules as expressions over event counts and one score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from anomaloom.functions.numeric import clamp_score

# --- fixed values ---------------------------------------------------------------------------
CASCADE_EVENTS = ("E5", "E6", "E7", "E15", "E20", "E21", "E22", "E24")
RULE_EVENTS = (
    "E5", "E6", "E7", "E9", "E15", "E16", "E18", "E19", "E20", "E21", "E22", "E23", "E24", "E27", "E28",
)
UNKNOWN = "Unknown_System_Anomaly"

DESCRIPTIONS = {
    "Cascading_Failure": "Multiple independent failure signals indicate a cascading cluster-wide incident.",
    "Node_Failure": "A DataNode appears unhealthy or unreachable, causing block operations to fail.",
    "Data_Corruption": "Corruption indicators suggest block contents or packets may be damaged.",
    "Network_Connection_Error": "Transfer and receive errors point to unstable DataNode network connectivity.",
    "Replication_Failure": "Replication mechanisms are failing to restore healthy block redundancy.",
    "Storage_Write_Failure": "Block persistence operations are failing at the storage write/delete layer.",
    "PacketResponder_Crash": "PacketResponder interruptions suggest responder thread/process instability.",
    "Pipeline_Failure": "The HDFS write pipeline shows delivery/state failures during transfer.",
    "Unknown_System_Anomaly": "No known error signature matched, but behavior remains anomalous.",
}
# Type, or its start where the entry ends in "_" -> action.
ACTIONS = (
    ("Data_Corruption", "Trigger immediate block re-verification and re-replication"),
    ("Node_Failure", "Isolate affected DataNode and redistribute its blocks"),
    ("Network_", "Check network connectivity between DataNodes"),
    ("Replication_", "Force re-replication of affected blocks"),
    ("Cascading_", "Alert on-call team immediately, check cluster health dashboard"),
)
DEFAULT_ACTION = "Monitor for recurrence, log for review"
# --------------------------------------------------------------------------------------------

CountOf = Callable[[str], Column]


def count_column(event: str) -> str:
    return f"n_{event.lower()}"


COUNT_COLUMNS = tuple(count_column(event) for event in RULE_EVENTS)


def counts_in_array(events: Column) -> list[Column]:
    """Count columns of the rule events in one upper-case event array (native array functions only)."""
    return [
        (F.size(events) - F.size(F.array_remove(events, event))).cast("bigint").alias(count_column(event))
        for event in RULE_EVENTS
    ]


def counts_in_group(event: Column) -> list[Column]:
    """Conditional counts for a grouping: partial aggregation, no token is shuffled."""
    return [F.count_if(event == name).alias(count_column(name)) for name in RULE_EVENTS]


def named_count(event: str) -> Column:
    return F.col(count_column(event))


def _some(n: CountOf, *events: str) -> Column:
    return reduce(lambda left, right: left | right, (n(event) > 0 for event in events))


def _total(n: CountOf, *events: str) -> Column:
    return reduce(lambda left, right: left + right, (n(event) for event in events))


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def rule_table(n: CountOf, score: Column) -> list[tuple[str, Column, Column]]:
    """(type, match, confidence where it matches) in priority order."""
    s = clamp_score(score)
    cascade = reduce(lambda left, right: left + right, (_flag(n(event) > 0) for event in CASCADE_EVENTS))
    rules = (
        ("Cascading_Failure", cascade >= 3, 0.60 + 0.10 * cascade + 0.20 * s),
        ("Node_Failure", _some(n, "E24") | ((n("E5") >= 3) & _some(n, "E7")), 0.72 + 0.18 * s),
        (
            "Data_Corruption",
            _some(n, "E22", "E16", "E28"),
            0.58 + 0.10 * _total(n, "E22", "E16", "E28") + 0.20 * s,
        ),
        (
            "Network_Connection_Error",
            _some(n, "E6") & _some(n, "E7") & _some(n, "E5"),
            0.56 + 0.07 * _total(n, "E6", "E7") + 0.18 * s,
        ),
        (
            "Replication_Failure",
            _some(n, "E15", "E21", "E20"),
            0.55 + 0.10 * _total(n, "E15", "E21", "E20") + 0.20 * s,
        ),
        (
            "Storage_Write_Failure",
            (_some(n, "E6") & _some(n, "E18")) | _some(n, "E19"),
            0.52 + 0.15 * _flag(n("E19") > 0) + 0.18 * s,
        ),
        (
            "PacketResponder_Crash",
            (n("E5") >= 2) & ~_some(n, "E6", "E7"),
            0.50 + 0.08 * n("E5") + 0.18 * s,
        ),
        (
            "Pipeline_Failure",
            _some(n, "E23") | (_some(n, "E27") & _some(n, "E6", "E7")),
            0.50 + 0.10 * _flag(n("E23") > 0) + 0.18 * s,
        ),
    )
    return [(name, match, _rounded(confidence)) for name, match, confidence in rules]


def _rounded(confidence: Column) -> Column:
    return F.round(F.least(F.lit(1.0), confidence), 3)


def unknown_confidence(score: Column) -> Column:
    return _rounded(0.35 + 0.30 * clamp_score(score))


def select_type(rules: Sequence[tuple[str, Column, Column]]) -> Column:
    return F.coalesce(*(F.when(match, F.lit(name)) for name, match, _ in rules), F.lit(UNKNOWN))


def select_confidence(rules: Sequence[tuple[str, Column, Column]], score: Column) -> Column:
    return F.coalesce(*(F.when(match, confidence) for _, match, confidence in rules), unknown_confidence(score))


def matched_rules(rules: Sequence[tuple[str, Column, Column]]) -> Column:
    found = F.array_compact(F.array(*(F.when(match, F.lit(name)) for name, match, _ in rules)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNKNOWN)))


def severity(anomaly_type: Column, n: CountOf, score: Column) -> Column:
    def graded(condition: Column, above: str, below: str) -> Column:
        return F.when(condition, F.lit(above)).otherwise(F.lit(below))

    return (
        F.when(anomaly_type == "Cascading_Failure", F.lit("Critical"))
        .when(anomaly_type == "Node_Failure", graded(n("E24") > 0, "Critical", "High"))
        .when(anomaly_type == "Data_Corruption", graded(clamp_score(score) > 0.95, "High", "Medium"))
        .when(
            anomaly_type == "Network_Connection_Error",
            graded(_total(n, "E6", "E7") >= 4, "High", "Medium"),
        )
        .when(anomaly_type == "Replication_Failure", F.lit("High"))
        .when(anomaly_type == "Storage_Write_Failure", graded(n("E9") > 0, "High", "Medium"))
        .otherwise(F.lit("Medium"))
    )


def description(anomaly_type: Column) -> Column:
    return F.coalesce(*(F.when(anomaly_type == name, F.lit(text)) for name, text in DESCRIPTIONS.items()))


def recommended_action(anomaly_type: Column) -> Column:
    return F.coalesce(
        *(
            F.when(anomaly_type.startswith(name) if name.endswith("_") else anomaly_type == name, F.lit(text))
            for name, text in ACTIONS
        ),
        F.lit(DEFAULT_ACTION),
    )
