"""Log lines to classified incident records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.functions.numeric import last_items
from anomaloom.operators.advice import heuristic_advice
from anomaloom.operators.events import (
    end_items,
    event_counts,
    explode_events,
    extract_events,
    line_events,
    line_statistics,
    with_event_counts,
)
from anomaloom.operators.incidents import (
    classify,
    effective_score,
    gate_by_model,
    incident_record,
    triggered_experts,
)
from anomaloom.operators.joins import lookup_join
from anomaloom.operators.models import normal_class_name, score
from anomaloom.operators.vocab import SHOWN_TOKENS, unknown_tokens
from anomaloom.session import stage


def classify_lines(lines: DataFrame, key: Sequence[str], score_by_key: DataFrame | None = None) -> DataFrame:
    """Incident class per key straight from lines: extraction, conditional counts, rules.

    One shuffle of fifteen counters per key; token sequences are never built.
    """
    counted = event_counts(extract_events(lines), key)
    if score_by_key is not None:
        counted = counted.join(score_by_key, list(key), "left")
    return classify(effective_score(counted))


def analyze_lines(
    lines: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    vocab: DataFrame,
    model: PipelineModel,
    class_names: Sequence[str],
    sequence_length: int = 128,
    normal_index: int = 0,
) -> DataFrame:
    """Score, classify, gate and advise each key with events; nested ``incident`` and ``response``.

    The model reads what it was trained on, the last ``sequence_length`` events, and ``event_names``
    of the record are those. Rule counts, token statistics, extraction counters and the first unknown
    events cover all events of the key. The text is read once: its events are staged. Keys without
    an event are in :func:`rejected_keys`.
    """
    found = stage(line_events(lines.select(*key, *order, "line")), "line-events")
    statistics = key_statistics(found, key, order, vocab)
    tails = end_items(explode_events(found), key, _places(order), sequence_length, F.desc)
    rows = tails.withColumnRenamed("items", "tokens").join(statistics, list(key))
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in key))
    scored = score(rows.withColumn("event_name", name), model, class_names)
    labelled = scored.withColumns(
        {
            "input_source": F.lit("log_lines"),
            "input_value": F.concat(F.col("n_lines").cast("string"), F.lit(" line(s)")),
            "event_tokens_tail": last_items(F.col("tokens"), SHOWN_TOKENS),
            "sequence_length": F.lit(sequence_length),
        }
    )
    return incident_record(_advised(labelled, normal_class_name(class_names, normal_index)))


def key_statistics(found: DataFrame, key: Sequence[str], order: Sequence[str], vocab: DataFrame) -> DataFrame:
    """Counters of each key with events, over all its events, and its first unknown events.

    ``found`` is the output of ``line_events``; it is read for the counters and for the unknown events.
    """
    words = vocab.select(F.col("token").alias("event"), F.lit(True).alias("__in"))

    def known(events: DataFrame) -> DataFrame:
        return lookup_join(events, words, ["event"]).withColumn("known", F.col("__in").isNotNull())

    counts = line_statistics(found, key, known).where(F.col("event_token_count") > 0)
    unknown = lookup_join(explode_events(found), words, ["event"], "left_anti")
    shown = end_items(unknown, key, _places(order), SHOWN_TOKENS, F.asc)
    none = F.array().cast("array<string>")
    joined = counts.join(shown, list(key), "left").withColumn("unknown_event_tokens", F.coalesce("items", none))
    return joined.drop("items")


def _places(order: Sequence[str]) -> list[Column]:
    return [F.col(name) for name in (*order, "event_pos")]


def rejected_keys(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose lines hold no event: ``key, n_lines``."""
    found = line_events(lines.select(*key, "line"))
    counted = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.size("events")).alias("most"))
    return counted.where(F.col("most") == 0).drop("most")


def analyze_sequences(
    sequences: DataFrame,
    vocab: DataFrame,
    model: PipelineModel,
    class_names: Sequence[str],
    normal_index: int = 0,
) -> DataFrame:
    """The same for rows ``event_name, tokens`` that already hold their sequence."""
    scored = score(with_event_counts(sequences, F.transform("tokens", F.upper)), model, class_names)
    return _records(scored, vocab, normal_class_name(class_names, normal_index))


def _records(scored: DataFrame, vocab: DataFrame, normal: str) -> DataFrame:
    return incident_record(unknown_tokens(_advised(scored, normal), vocab))


def _advised(scored: DataFrame, normal: str) -> DataFrame:
    rated = scored.withColumns(
        {"score": F.col("prediction.anomaly_score"), "predicted_class": F.col("prediction.predicted_class")}
    )
    gated = gate_by_model(classify(rated), normal=normal)
    return heuristic_advice(gated.withColumn("triggered_experts", triggered_experts()))
