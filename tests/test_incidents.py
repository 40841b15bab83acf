import json

import pytest
from pyspark.sql import functions as F

from anomaloom.functions import rules, text
from anomaloom.operators import advice, events, incidents, statistics

UNKNOWN = "Unknown_System_Anomaly"
CASCADE, CORRUPT, NET = "Cascading_Failure", "Data_Corruption", "Network_Connection_Error"

GOLDEN = [
    ("E1 E2 E3 E4 E1 E2 E4", 0.08, UNKNOWN, "Medium", 0.374, [UNKNOWN]),
    ("E5 E22 E6 E7 E9 E11 E14", 0.97, CASCADE, "Critical", 1.0, [CASCADE, CORRUPT, NET]),
    ("E5 E5 E5 E7 E24 E9 E14", 0.99, CASCADE, "Critical", 1.0, [CASCADE, "Node_Failure"]),
    ("E3 E5 E6 E7 E6 E7 E6 E7", 0.92, CASCADE, "Critical", 1.0, [CASCADE, NET]),
    (
        "E5 E6 E7 E22 E24 E15 E21 E9", 0.995, CASCADE, "Critical", 1.0,
        [CASCADE, "Node_Failure", CORRUPT, NET, "Replication_Failure"],
    ),
    ("E24 E9 E14", 0.90, "Node_Failure", "Critical", 0.882, ["Node_Failure"]),
    ("E22", 0.96, CORRUPT, "High", 0.872, [CORRUPT]),
    ("E1 E2 E3 E4", 0.12, UNKNOWN, "Medium", 0.386, [UNKNOWN]),
    ("", 0.5, UNKNOWN, "Medium", 0.5, [UNKNOWN]),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = spark.createDataFrame([(i, s, p) for i, (s, p, *_) in enumerate(GOLDEN)], "id int, s string, score double")
    counted = events.with_event_counts(rows, text.normalize_events(text.split_events(F.col("s"))))
    return incidents.classify(counted)


def test_golden_classification(classified):
    got = {r.id: r for r in classified.collect()}
    for i, (_, _, kind, severity, confidence, matched) in enumerate(GOLDEN):
        row = got[i]
        assert (row.anomaly_type, row.severity, row.confidence, row.matched_rules) == (kind, severity, confidence, matched)
        assert row.description == rules.DESCRIPTIONS[kind]


def test_network_rule_is_never_selected(classified):
    assert NET not in {r.anomaly_type for r in classified.collect()}


@pytest.mark.parametrize(
    ("kind", "action"),
    [
        (CORRUPT, "Trigger immediate block re-verification and re-replication"),
        ("Network_Other", "Check network connectivity between DataNodes"),
        ("Node_Failure_2", "Monitor for recurrence, log for review"),
    ],
)
def test_actions(spark, kind, action):
    assert spark.range(1).select(rules.recommended_action(F.lit(kind))).first()[0] == action


def test_alert_has_fresh_id_and_time(classified):
    alerts = incidents.format_alert(classified, "id").collect()
    assert len({a.alert_id for a in alerts}) == len(GOLDEN)
    assert alerts[0].timestamp is not None


def test_effective_score(spark):
    rows = spark.createDataFrame(
        [(0, 0.4, 0.9), (1, None, 0.9), (2, None, None), (3, 7.0, None), (4, -1.0, None), (5, float("nan"), None)],
        "id int, score double, anomaly_score double",
    )
    got = {r.id: r.score for r in incidents.effective_score(rows).collect()}
    assert got == {0: 0.4, 1: 0.9, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0}


def test_gate(spark, classified):
    gated = incidents.gate_by_model(
        classified.withColumn("predicted_class", F.when(F.col("id") == 0, "Normal").otherwise("Anomaly"))
    )
    normal = gated.where("id = 0").first()
    assert (normal.anomaly_detected, normal.anomaly_type, normal.severity, normal.confidence, normal.matched_rules) == (
        False, "Normal", "Low", 1.0, [],
    )
    assert gated.where("id = 6").first().anomaly_type == CORRUPT


def test_record_statistics(spark):
    records = spark.createDataFrame(
        [
            ("b1", 0.96, ["E22"], None, "2026-04-07T08:00:00Z", None, 1),
            ("b2", 0.99, None, "E24", "2026-04-07T08:05:00Z", None, 2),
            (None, 0.5, None, "e1, e2", "2026-01-01", "Mine", 3),
            ("b4", None, None, None, None, None, 4),
        ],
        "block_id string, score double, event_names array<string>, event_sequence string, timestamp string, anomaly_type string, n int",
    )
    rated = statistics.classify_records(records)
    counts = {r.anomaly_type: (r.n, r.average_score) for r in statistics.anomaly_type_stats(rated).collect()}
    assert counts == {CORRUPT: (1, 0.96), "Node_Failure": (1, 0.99), "Mine": (1, 0.5), UNKNOWN: (1, 0.0)}
    line = statistics.timeline(rated, ["n"]).collect()
    assert [r.block_id for r in line] == ["unknown", "b1", "b2"]
    assert statistics.most_common_severity(rated, ["n"]).first()[0] == "Medium"
    assert statistics.most_common_severity(rated.limit(0), ["n"]).first()[0] == "Unknown"


def test_severity_tie_goes_to_the_first(spark):
    rated = spark.createDataFrame([("High", 2), ("Low", 1), ("Low", 4), ("High", 3)], "severity string, n int")
    assert statistics.most_common_severity(rated, ["n"]).first()[0] == "Low"


def test_parse_advice(spark):
    answers = [
        '{"reason": " r ", "action": "a"}',
        'Here: {"reason": "r", "action": 5} ok',
        '{"reason": null, "action": true}',
        '{"reason": "r"}',
        "[1, 2]",
        "no json",
        "{'reason': 'r', 'action': 'a'}",
        None,
    ]
    rows = spark.createDataFrame(
        [(i, a, "R", "A", "heuristic") for i, a in enumerate(answers)],
        "id int, response_text string, reason string, action string, advice_source string",
    )
    got = [(r.reason, r.action, r.advice_source) for r in advice.parse_advice(rows).orderBy("id").collect()]
    assert got[:3] == [("r", "a", "model"), ("r", "5", "model"), ("None", "True", "model")]
    assert got[3:] == [("R", "A", "heuristic")] * 5


def test_prompt_layout(spark, classified):
    from anomaloom.operators.models import prediction_column

    p = F.array(1.0 - F.col("score"), F.col("score"))
    rows = classified.where("id = 6").select(
        "*", F.lit("blk").alias("event_name"), F.array(F.lit("e22")).alias("tokens"), F.lit(0).alias("event_token_count"),
        F.array(F.lit("e22")).alias("event_tokens_tail"), F.lit(0).alias("known_event_count"),
        F.lit(1).alias("unknown_event_count"), F.array(F.lit("e22")).alias("unknown_event_tokens"),
        prediction_column(p, ["Normal", "Anomaly"], "system_expert").alias("prediction"), F.lit("Anomaly").alias("predicted_class"),
    )
    record = incidents.incident_record(incidents.gate_by_model(rows))
    prompt = advice.incident_prompt(record).first().prompt
    assert "- max_anomaly_score: 0.9600\n- triggered_experts: ['system_expert']\n" in prompt
    assert "- event_names: ['E22']\n- expert_predictions: [{'expert_name': 'system_expert', 'anomaly_score': 0.96, " in prompt
    assert prompt.endswith('"action":"<short immediate action list>"}')
    nested = json.loads(record.select(F.to_json("response").alias("j")).first().j)
    assert nested["metadata"]["classification_matched_rules"] == [CORRUPT]


def test_single_input_gate(spark):
    rows = spark.createDataFrame(
        [(0, "E5 E6", None, None), (1, None, "a\nb\n", None), (2, None, " ", ["x"]), (3, "E5", "t", None), (4, None, None, [])],
        "id int, event_sequence string, log_text string, log_lines array<string>",
    )
    accepted, rejected = advice.single_input_gate(rows)
    got = {r.id: (r.input_source, r.lines) for r in accepted.collect()}
    assert got == {0: ("event_sequence", ["E5 E6"]), 1: ("log_lines", ["a", "b"]), 2: ("log_lines", ["x"])}
    assert {r.id for r in rejected.collect()} == {3, 4}


SAMPLE_LOG = """\
09:00:01 INFO FSNamesystem: BLOCK* allocate blk_7 for /data/part-7
09:00:02 INFO DataNode: Receiving block pool:blk_7 src=/10.1.1.1
09:00:03 INFO DataXceiver: writeBlock blk_7
09:00:04 INFO PacketResponder: PacketResponder 1 for block blk_7 success
09:00:05 INFO FsDatasetImpl: Finalized block blk_7
09:00:06 INFO BlockManager: BLOCK* addStoredBlock blk_7
09:00:07 INFO FSNamesystem: completeFile /data/part-7
09:00:08 INFO NameNode: state change to ACTIVE
09:00:09 WARN DataNode: Slow BlockReceiver write
09:00:10 ERROR DataNode: checksum mismatch in blk_7
09:00:11 ERROR DataNode: failed to write packet of blk_7
09:00:12 ERROR DataNode: broken pipe
09:00:13 ERROR FSNamesystem: BLOCK* invalidateBlocks blk_7
09:00:14 ERROR BlockManager: corrupt replica of blk_7
09:00:15 WARN BlockManager: blk_7 missing 2 replicas
09:00:16 INFO BlockManager: replicate blk_7 from here to there
"""


@pytest.mark.parametrize("repeats", [1, 300])
def test_log_file(spark, tmp_path, repeats):
    """All templates in one file; read as one split or as several, in file order."""
    from anomaloom.sources.logs import LOG_ORDER, read_log_files

    path = tmp_path / "sample.log"
    path.write_text(SAMPLE_LOG * repeats)
    expected = "e5 e26 e22 e11 e3 e21 e9 e23 e1 e17 e19 e19 e24 e24 e29 e13".split() * repeats
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = read_log_files(spark, str(path))
        place = [F.col(name) for name in (*LOG_ORDER, "event_pos")]
        chunks = events.assemble_sequences(events.extract_events(lines), ["source"], place, chunk=1000, rows_per_bucket=500)
        rows = chunks.orderBy("chunk_no").collect()
        stats = events.extraction_stats(lines).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [token for row in rows for token in row.tokens] == expected
    assert (stats.from_event_id, stats.from_template, stats.unmatched_lines) == (0, len(expected), 0)
