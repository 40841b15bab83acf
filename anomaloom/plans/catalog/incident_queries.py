"""Queries over classified blocks: rules, gate, alerts, statistics, advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.functions import rules
from anomaloom.operators import advice, incidents, statistics
from anomaloom.operators.events import with_event_counts
from anomaloom.operators.models import prediction_column
from anomaloom.operators.vocab import unknown_tokens
from anomaloom.plans.catalog.inputs import COUNTS, EV, EVENT_ORDER, RULE_EVENT_NUMBERS, RULES, counted_blocks, event_tokens
from anomaloom.plans.catalog.registry import query, table


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return incidents.classify(counted_blocks(spark, d))


@query(f"WITH {RULES} SELECT block_id, score, anomaly_type, severity, confidence, description FROM classified")
def classify_sequences(spark, d):
    return _classified(spark, d).select("block_id", "score", "anomaly_type", "severity", "confidence", "description")


@query(f"WITH {RULES} SELECT block_id, matched_rules FROM classified")
def matched_rules(spark, d):
    return _classified(spark, d).select("block_id", F.array_join("matched_rules", "|").alias("matched_rules"))


@query(f"WITH {RULES} SELECT anomaly_type, severity, count(*) AS n, max(confidence) AS top_confidence FROM classified GROUP BY 1, 2")
def severity(spark, d):
    return _classified(spark, d).groupBy("anomaly_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top_confidence")
    )


_RULE_NAMES = tuple(rules.DESCRIPTIONS)[:8]


@query(
    f"WITH {RULES} "
    + " UNION ALL ".join(
        f"SELECT block_id, '{name}' AS rule, m{i}::INTEGER AS matched, CASE WHEN m{i} THEN c{i} ELSE 0e0 END AS confidence FROM rated"
        for i, name in enumerate(_RULE_NAMES, 1)
    )
    + f" UNION ALL SELECT block_id, '{rules.UNKNOWN}', 1, c9 FROM rated"
)
def rule_confidences(spark, d):
    counted = counted_blocks(spark, d)
    known = [
        F.struct(
            F.lit(name).alias("rule"),
            match.cast("int").alias("matched"),
            F.when(match, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        )
        for name, match, confidence in rules.rule_table(rules.named_count, F.col("score"))
    ]
    fallback = F.struct(
        F.lit(rules.UNKNOWN).alias("rule"),
        F.lit(1).alias("matched"),
        rules.unknown_confidence(F.col("score")).alias("confidence"),
    )
    return counted.select("block_id", F.inline(F.array(*known, fallback)))


_COUNT_NAMES = [f"n_e{i}" for i in RULE_EVENT_NUMBERS]


@query(f"WITH {COUNTS} SELECT block_id, {', '.join(_COUNT_NAMES)} FROM counts")
def event_counts(spark, d):
    return counted_blocks(spark, d).select("block_id", *_COUNT_NAMES)


@query(f"WITH {RULES} SELECT block_id, anomaly_type, severity, confidence, description, matched_rules, recommended_action FROM classified")
def alerts(spark, d):
    alert = incidents.format_alert(_classified(spark, d))
    return alert.drop("alert_id", "timestamp").withColumn("matched_rules", F.array_join("matched_rules", "|"))


# A block has a score of its own where it saw an error, else only a fallback one, and a third kind
# has neither; a few lie outside 0…1.
_SCORES = EV + """,
records AS (
  SELECT block_id, max(CASE WHEN event_type = 'error' THEN value / 10e0 - 0.2e0 END) AS score,
         max(CASE WHEN event_type = 'purchase' THEN k / 100e0 END) AS anomaly_score
  FROM ev GROUP BY block_id)
"""


@query(f"WITH {_SCORES} SELECT block_id, round(greatest(0e0, least(1e0, coalesce(score, anomaly_score, 0e0))), 6) AS score FROM records")
def effective_score(spark, d):
    kind = F.col("event_type")
    records = event_tokens(spark, d).groupBy("block_id").agg(
        F.max(F.when(kind == "error", F.col("value") / 10.0 - 0.2)).alias("score"),
        F.max(F.when(kind == "purchase", F.col("k") / 100.0)).alias("anomaly_score"),
    )
    return incidents.effective_score(records).select("block_id", F.round("score", 6).alias("score"))


@query(f"""WITH {RULES}
SELECT block_id, (score >= 0.5e0)::INTEGER AS anomaly_detected,
  CASE WHEN score >= 0.5e0 THEN anomaly_type ELSE 'Normal' END AS anomaly_type,
  CASE WHEN score >= 0.5e0 THEN severity ELSE 'Low' END AS severity,
  CASE WHEN score >= 0.5e0 THEN confidence ELSE 1e0 END AS confidence,
  CASE WHEN score >= 0.5e0 THEN matched_rules ELSE '' END AS matched_rules,
  CASE WHEN score >= 0.5e0 THEN description ELSE 'No anomaly pattern detected.' END AS description
FROM classified""")
def gate_by_model(spark, d):
    return _gated(_classified(spark, d)).select(
        "block_id",
        F.col("anomaly_detected").cast("int").alias("anomaly_detected"),
        "anomaly_type", "severity", "confidence",
        F.array_join("matched_rules", "|").alias("matched_rules"),
        "description",
    )


def _gated(classified: DataFrame) -> DataFrame:
    predicted = F.when(F.col("score") >= 0.5, F.lit("Anomaly")).otherwise(F.lit("Normal"))
    return incidents.gate_by_model(classified.withColumn("predicted_class", predicted))


# --- statistics -----------------------------------------------------------------------------

_RECORDS = RULES + """,
loose AS (
  SELECT block_id, min(event_id) AS record_no,
    strftime(min(ts) FILTER (event_type = 'error'), '%Y-%m-%dT%H:%M:%SZ') AS stamp,
    CASE WHEN count(*) FILTER (event_type = 'signup') >= 3 THEN 'Manual_Review' END AS own_type,
    CASE WHEN count(*) FILTER (event_type = 'view') >= 3 THEN 'Low' END AS own_severity
  FROM ev GROUP BY block_id),
rated_records AS (
  SELECT block_id, record_no, stamp, score, coalesce(own_type, anomaly_type) AS anomaly_type,
    coalesce(own_severity, severity) AS severity
  FROM classified JOIN loose USING (block_id))
"""


def result_records(spark: SparkSession, d: str) -> DataFrame:
    """Loose records: events as a list or (every block with an error) as a string."""
    def times(name):
        return F.count_if(F.col("event_type") == name)

    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*EVENT_ORDER, "event"))), lambda e: e["event"])
    blocks = event_tokens(spark, d).groupBy("block_id").agg(
        F.min("event_id").alias("record_no"),
        F.date_format(F.min(F.when(F.col("event_type") == "error", F.col("ts"))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(times("signup") >= 3, F.lit("Manual_Review")).alias("anomaly_type"),
        F.when(times("view") >= 3, F.lit("Low")).alias("severity"),
        (F.max("k") / 100.0).alias("anomaly_score"),
        ordered.alias("events"),
    )
    as_text = F.col("timestamp").isNotNull()
    return blocks.select(
        "*",
        F.when(~as_text, F.col("events")).alias("event_names"),
        F.when(as_text, F.array_join("events", ", ")).alias("event_sequence"),
    ).drop("events")


@query(f"WITH {_RECORDS} SELECT anomaly_type, count(*) AS n, round(avg(score), 4) AS average_score FROM rated_records GROUP BY 1")
def anomaly_type_stats(spark, d):
    return statistics.anomaly_type_stats(statistics.classify_records(result_records(spark, d)))


@query(f"WITH {_RECORDS} SELECT severity AS most_common_severity FROM rated_records GROUP BY 1 ORDER BY count(*) DESC, min(record_no) LIMIT 1")
def most_common_severity(spark, d):
    return statistics.most_common_severity(statistics.classify_records(result_records(spark, d)), ["record_no"])


@query(f"""WITH {_RECORDS} SELECT stamp AS "timestamp", block_id, anomaly_type, severity, round(score, 4) AS score
FROM rated_records WHERE stamp IS NOT NULL ORDER BY stamp, record_no""")
def timeline(spark, d):
    return statistics.timeline(statistics.classify_records(result_records(spark, d)), ["record_no"])


# --- records and advice ---------------------------------------------------------------------

_GATED = RULES + """,
gated AS (
  SELECT block_id, score, score >= 0.5e0 AS detected,
    CASE WHEN score >= 0.5e0 THEN anomaly_type ELSE 'Normal' END AS anomaly_type,
    CASE WHEN score >= 0.5e0 THEN severity ELSE 'Low' END AS severity,
    CASE WHEN score >= 0.5e0 THEN confidence ELSE 1e0 END AS confidence,
    CASE WHEN score >= 0.5e0 THEN matched_rules ELSE '' END AS matched_rules,
    CASE WHEN score >= 0.5e0 THEN description ELSE 'No anomaly pattern detected.' END AS description
  FROM classified),
advised AS (
  SELECT *,
    CASE WHEN detected THEN severity || ' anomaly detected with type ''' || anomaly_type || ''' from expert signals (system_expert).'
      ELSE 'Current signal pattern is consistent with normal cloud workload behavior.' END AS reason,
    CASE WHEN detected THEN 'Isolate affected workload, block suspicious traffic/credentials, and inspect related host and network logs for root cause.'
      ELSE 'Continue monitoring; keep current alert thresholds and verify periodic model drift checks.' END AS action
  FROM gated)
"""


def _advised(spark: SparkSession, d: str) -> DataFrame:
    gated = _gated(_classified(spark, d)).withColumn("triggered_experts", incidents.triggered_experts())
    return advice.heuristic_advice(gated)


@query(f"WITH {_GATED} SELECT block_id, reason, action, 'heuristic' AS advice_source FROM advised")
def heuristic_advice(spark, d):
    return _advised(spark, d).select("block_id", "reason", "action", "advice_source")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Incident records of all blocks; the model stands in as the block's own score."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*EVENT_ORDER, "event"))), lambda e: F.lower(e["event"]))
    blocks = event_tokens(spark, d).groupBy(F.col("block_id").alias("event_name")).agg(
        ordered.alias("tokens"), (F.max("k") / 100.0).alias("score")
    )
    p = F.array(1.0 - F.col("score"), F.col("score"))
    scored = with_event_counts(blocks, F.transform("tokens", F.upper)).withColumn(
        "prediction", prediction_column(p, ["Normal", "Anomaly"], incidents.EXPERT)
    )
    # Events seen with errors are the known vocabulary.
    known = event_tokens(spark, d).where(F.col("event_type") == "error").where(F.col("value") > 50).select(F.lower("event").alias("token")).distinct()
    vocab = known.select("token", F.substring("token", 2, 9).cast("int").alias("token_id"))
    advised = advice.heuristic_advice(
        _gated(incidents.classify(scored)).withColumn("triggered_experts", incidents.triggered_experts())
    )
    return incidents.incident_record(unknown_tokens(advised, vocab, key=["event_name"]))


@query(f"""WITH {_GATED},
known AS (SELECT DISTINCT event FROM ev WHERE event_type = 'error' AND value > 50),
sequences AS (
  SELECT block_id, list(event ORDER BY ts, event_id) AS events,
    count(*) FILTER (event NOT IN (SELECT event FROM known)) AS unknown_n
  FROM ev GROUP BY block_id)
SELECT block_id AS event_name, detected::INTEGER AS anomaly_detected, anomaly_type, severity AS severity_level,
  round(1e0 - (1e0 - score), 6) AS anomaly_score, round(greatest(score, 1e0 - score), 6) AS confidence,
  CASE WHEN score > 0.5e0 THEN 'Anomaly' ELSE 'Normal' END AS predicted_label, reason, action,
  confidence AS classification_confidence, matched_rules,
  CAST(len(events) AS INTEGER) AS event_token_count, CAST(unknown_n AS INTEGER) AS unknown_event_count,
  CAST(len(events) - unknown_n AS INTEGER) AS known_event_count, array_to_string(events, ' ') AS event_names
FROM advised JOIN sequences USING (block_id)""")
def incident_record(spark, d):
    r = _records(spark, d)
    return r.select(
        "response.event_name",
        F.col("response.anomaly_detected").cast("int").alias("anomaly_detected"),
        "response.anomaly_type",
        "response.metadata.severity_level",
        F.round("response.anomaly_score", 6).alias("anomaly_score"),
        F.round("response.confidence", 6).alias("confidence"),
        "response.predicted_label", "response.reason", "response.action",
        "response.metadata.classification_confidence",
        F.array_join("incident.classification_matched_rules", "|").alias("matched_rules"),
        "response.input.event_token_count",
        "response.metadata.unknown_event_count",
        "response.metadata.known_event_count",
        F.array_join("incident.event_names", " ").alias("event_names"),
    )


_PROMPT_END = "\n".join(advice.PROMPT_LINES[13:])


@query(f"""WITH {_GATED},
sequences AS (SELECT block_id, list(event ORDER BY ts, event_id) AS events FROM ev GROUP BY block_id)
SELECT block_id AS event_name, 'Incident context:' || chr(10) || '- event_name: ' || block_id || chr(10)
  || '- anomaly_detected: ' || CASE WHEN detected THEN 'True' ELSE 'False' END || chr(10)
  || '- anomaly_type: ' || anomaly_type || chr(10) || '- severity_level: ' || severity || chr(10)
  || '- max_anomaly_score: ' || printf('%.4f', score) || chr(10)
  || '- triggered_experts: ' || CASE WHEN detected THEN '[''system_expert'']' ELSE '[]' END || chr(10)
  || '- classification_source: rule_based' || chr(10)
  || '- classification_confidence: ' || printf('%.4f', confidence) || chr(10)
  || '- classification_matched_rules: [' || CASE WHEN matched_rules = '' THEN '' ELSE '''' || replace(matched_rules, '|', ''', ''') || '''' END || ']' || chr(10)
  || '- classification_description: ' || description || chr(10)
  || '- event_names: [''' || array_to_string(events, ''', ''') || ''']' || chr(10)
  || '- expert_predictions: [{{''expert_name'': ''system_expert'', ''anomaly_score'': ' || CAST(1e0 - (1e0 - score) AS VARCHAR)
  || ', ''predicted_class'': ''' || CASE WHEN score > 0.5e0 THEN 'Anomaly' ELSE 'Normal' END || ''', ''confidence'': ' || CAST(greatest(score, 1e0 - score) AS VARCHAR)
  || ', ''metadata'': {{''class_probabilities'': {{''Normal'': ' || CAST(1e0 - score AS VARCHAR) || ', ''Anomaly'': ' || CAST(score AS VARCHAR) || '}}}}}}]' || chr(10)
  || '{_PROMPT_END}' AS prompt
FROM advised JOIN sequences USING (block_id)""")
def incident_prompt(spark, d):
    prompts = advice.incident_prompt(_records(spark, d))
    return prompts.select("incident.event_name", "prompt")


_ANSWERS = """
answers AS (
  SELECT conv_id, turn,
    CASE role WHEN 'user' THEN 'Sure: ' || j || ' as asked' WHEN 'assistant' THEN j ELSE text END AS response_text,
    replace(replace(text, '"', ''), chr(92), '') AS clean, role
  FROM (SELECT *, '{"reason": "' || replace(replace(replace(text, chr(92), ''), '"', ''), chr(10), ' ')
    || '", "action": "' || CASE WHEN length(text) % 2 = 0 THEN role ELSE ' ' END || '"}' AS j FROM conversations))
"""


@query(f"""WITH {_ANSWERS}, parsed AS (
  SELECT conv_id, turn, role IN ('user', 'assistant') AND action <> '' AND reason <> '' AS ok, reason, action
  FROM (SELECT conv_id, turn, role, trim(regexp_extract(response_text, '"reason": "([^"]*)"', 1)) AS reason,
               trim(regexp_extract(response_text, '"action": "([^"]*)"', 1)) AS action FROM answers))
SELECT conv_id, turn, CASE WHEN ok THEN reason ELSE 'fallback reason' END AS reason,
  CASE WHEN ok THEN action ELSE 'fallback action' END AS action,
  CASE WHEN ok THEN 'model' ELSE 'heuristic' END AS advice_source FROM parsed""")
def parse_advice(spark, d):
    text = F.col("text")
    plain = F.regexp_replace(F.regexp_replace(text, r'[\\"]', ""), "\n", " ")
    action = F.when(F.length(text) % 2 == 0, F.col("role")).otherwise(F.lit(" "))
    answer = F.concat(F.lit('{"reason": "'), plain, F.lit('", "action": "'), action, F.lit('"}'))
    wrapped = (
        F.when(F.col("role") == "user", F.concat(F.lit("Sure: "), answer, F.lit(" as asked")))
        .when(F.col("role") == "assistant", answer)
        .otherwise(text)
    )
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", wrapped.alias("response_text"),
        F.lit("fallback reason").alias("reason"), F.lit("fallback action").alias("action"),
        F.lit("heuristic").alias("advice_source"),
    )
    return advice.parse_advice(rows).drop("response_text")


@query("""
SELECT conv_id, turn, CASE WHEN n = 1 THEN CASE role WHEN 'user' THEN 'event_sequence' ELSE 'log_lines' END ELSE 'rejected' END AS outcome,
  CAST(CASE WHEN n <> 1 THEN 0 WHEN role = 'user' THEN 1
    ELSE len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10))) END AS INTEGER) AS n_lines
FROM (SELECT *, CASE WHEN role = 'system' THEN 2 WHEN trim(text) = '' THEN 0 ELSE 1 END AS n FROM conversations)""")
def single_input_gate(spark, d):
    requests = table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") != "assistant", F.col("text")).alias("event_sequence"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("log_text"),
        F.when(F.col("role") == "system", F.array("text")).alias("log_lines"),
    )
    accepted, rejected = advice.single_input_gate(requests)
    return accepted.select(
        "conv_id", "turn", F.col("input_source").alias("outcome"), F.size("lines").alias("n_lines")
    ).unionByName(rejected.select("conv_id", "turn", F.lit("rejected").alias("outcome"), F.lit(0).alias("n_lines")))
