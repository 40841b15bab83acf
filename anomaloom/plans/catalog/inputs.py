"""Logs, sequences, labels and flows derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from anomaloom.operators.events import event_counts
from anomaloom.plans.catalog.registry import table

# --- events ---------------------------------------------------------------------------------


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their token and block (a user's day)."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        k.alias("k"),
        F.concat(F.lit("E"), (k % 29 + 1).cast("string")).alias("event"),
        F.concat(F.lit("blk_"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("block_id"),
    )


EVENT_ORDER = ("ts", "event_id")

EV = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, k,
         'E' || CAST(k % 29 + 1 AS VARCHAR) AS event,
         'blk_' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS block_id
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))
"""


def counted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-event counts and score of every block."""
    score = (F.max("k") / 100.0).alias("score")
    return event_counts(event_tokens(spark, sf_dir), ["block_id"], "event", score)


RULE_EVENT_NUMBERS = (5, 6, 7, 9, 15, 16, 18, 19, 20, 21, 22, 23, 24, 27, 28)

COUNTS = EV + """,
counts AS (
  SELECT block_id, max(k) / 100e0 AS score,
""" + ",\n".join(
    f"         count(*) FILTER (event = 'E{i}') AS n_e{i}" for i in RULE_EVENT_NUMBERS
) + """
  FROM ev GROUP BY block_id)
"""

_CASCADE = " + ".join(f"(n_e{i} > 0)::INTEGER" for i in (5, 6, 7, 15, 20, 21, 22, 24))

# The rules over count columns, once more in SQL.
RULES = COUNTS + f""",
rated AS (
  SELECT *,
    cascade >= 3 AS m1,
    n_e24 > 0 OR (n_e5 >= 3 AND n_e7 > 0) AS m2,
    n_e22 > 0 OR n_e16 > 0 OR n_e28 > 0 AS m3,
    n_e6 > 0 AND n_e7 > 0 AND n_e5 > 0 AS m4,
    n_e15 > 0 OR n_e21 > 0 OR n_e20 > 0 AS m5,
    (n_e6 > 0 AND n_e18 > 0) OR n_e19 > 0 AS m6,
    n_e5 >= 2 AND n_e6 = 0 AND n_e7 = 0 AS m7,
    n_e23 > 0 OR (n_e27 > 0 AND (n_e6 > 0 OR n_e7 > 0)) AS m8,
    round(least(1e0, 0.60e0 + 0.10e0 * cascade + 0.20e0 * score), 3) AS c1,
    round(least(1e0, 0.72e0 + 0.18e0 * score), 3) AS c2,
    round(least(1e0, 0.58e0 + 0.10e0 * (n_e22 + n_e16 + n_e28) + 0.20e0 * score), 3) AS c3,
    round(least(1e0, 0.56e0 + 0.07e0 * (n_e6 + n_e7) + 0.18e0 * score), 3) AS c4,
    round(least(1e0, 0.55e0 + 0.10e0 * (n_e15 + n_e21 + n_e20) + 0.20e0 * score), 3) AS c5,
    round(least(1e0, 0.52e0 + 0.15e0 * (n_e19 > 0)::INTEGER + 0.18e0 * score), 3) AS c6,
    round(least(1e0, 0.50e0 + 0.08e0 * n_e5 + 0.18e0 * score), 3) AS c7,
    round(least(1e0, 0.50e0 + 0.10e0 * (n_e23 > 0)::INTEGER + 0.18e0 * score), 3) AS c8,
    round(least(1e0, 0.35e0 + 0.30e0 * score), 3) AS c9
  FROM (SELECT *, {_CASCADE} AS cascade FROM counts)),
typed AS (
  SELECT *,
    CASE WHEN m1 THEN 'Cascading_Failure' WHEN m2 THEN 'Node_Failure' WHEN m3 THEN 'Data_Corruption'
         WHEN m4 THEN 'Network_Connection_Error' WHEN m5 THEN 'Replication_Failure'
         WHEN m6 THEN 'Storage_Write_Failure' WHEN m7 THEN 'PacketResponder_Crash'
         WHEN m8 THEN 'Pipeline_Failure' ELSE 'Unknown_System_Anomaly' END AS anomaly_type,
    CASE WHEN m1 THEN c1 WHEN m2 THEN c2 WHEN m3 THEN c3 WHEN m4 THEN c4 WHEN m5 THEN c5
         WHEN m6 THEN c6 WHEN m7 THEN c7 WHEN m8 THEN c8 ELSE c9 END AS confidence,
    coalesce(nullif(concat_ws('|', CASE WHEN m1 THEN 'Cascading_Failure' END, CASE WHEN m2 THEN 'Node_Failure' END,
      CASE WHEN m3 THEN 'Data_Corruption' END, CASE WHEN m4 THEN 'Network_Connection_Error' END,
      CASE WHEN m5 THEN 'Replication_Failure' END, CASE WHEN m6 THEN 'Storage_Write_Failure' END,
      CASE WHEN m7 THEN 'PacketResponder_Crash' END, CASE WHEN m8 THEN 'Pipeline_Failure' END), ''),
      'Unknown_System_Anomaly') AS matched_rules
  FROM rated),
classified AS (
  SELECT *,
    CASE anomaly_type WHEN 'Cascading_Failure' THEN 'Critical'
      WHEN 'Node_Failure' THEN CASE WHEN n_e24 > 0 THEN 'Critical' ELSE 'High' END
      WHEN 'Data_Corruption' THEN CASE WHEN score > 0.95e0 THEN 'High' ELSE 'Medium' END
      WHEN 'Network_Connection_Error' THEN CASE WHEN n_e6 + n_e7 >= 4 THEN 'High' ELSE 'Medium' END
      WHEN 'Replication_Failure' THEN 'High'
      WHEN 'Storage_Write_Failure' THEN CASE WHEN n_e9 > 0 THEN 'High' ELSE 'Medium' END
      ELSE 'Medium' END AS severity,
    CASE anomaly_type
      WHEN 'Cascading_Failure' THEN 'Multiple independent failure signals indicate a cascading cluster-wide incident.'
      WHEN 'Node_Failure' THEN 'A DataNode appears unhealthy or unreachable, causing block operations to fail.'
      WHEN 'Data_Corruption' THEN 'Corruption indicators suggest block contents or packets may be damaged.'
      WHEN 'Network_Connection_Error' THEN 'Transfer and receive errors point to unstable DataNode network connectivity.'
      WHEN 'Replication_Failure' THEN 'Replication mechanisms are failing to restore healthy block redundancy.'
      WHEN 'Storage_Write_Failure' THEN 'Block persistence operations are failing at the storage write/delete layer.'
      WHEN 'PacketResponder_Crash' THEN 'PacketResponder interruptions suggest responder thread/process instability.'
      WHEN 'Pipeline_Failure' THEN 'The HDFS write pipeline shows delivery/state failures during transfer.'
      ELSE 'No known error signature matched, but behavior remains anomalous.' END AS description,
    CASE WHEN anomaly_type = 'Data_Corruption' THEN 'Trigger immediate block re-verification and re-replication'
      WHEN anomaly_type = 'Node_Failure' THEN 'Isolate affected DataNode and redistribute its blocks'
      WHEN anomaly_type LIKE 'Network\\_%' ESCAPE '\\' THEN 'Check network connectivity between DataNodes'
      WHEN anomaly_type LIKE 'Replication\\_%' ESCAPE '\\' THEN 'Force re-replication of affected blocks'
      WHEN anomaly_type LIKE 'Cascading\\_%' ESCAPE '\\' THEN 'Alert on-call team immediately, check cluster health dashboard'
      ELSE 'Monitor for recurrence, log for review' END AS recommended_action
  FROM typed)
"""

# --- log lines ------------------------------------------------------------------------------

# Wording by k % 16; {b} is the event id, {e} the event token. The last but one has explicit ids, the
# last is unknown.
_WORDING = (
    "INFO FSNamesystem: BLOCK* allocate blk_{b} for /apps/part",
    "INFO DataNode: Receiving block blk_{b} src=/10.0.0.1",
    "INFO PacketResponder: PacketResponder 0 for block blk_{b} success",
    "INFO FSNamesystem: completeFile /apps/part blk_{b}",
    "INFO BlockManager: BLOCK* addStoredBlock blk_{b}",
    "INFO NameNode: State change to ACTIVE blk_{b}",
    "INFO DataXceiver: writeBlock blk_{b}",
    "INFO FsDatasetImpl: Finalized block blk_{b}",
    "WARN DataNode: Slow BlockReceiver write blk_{b}",
    "ERROR DataNode: Checksum mismatch blk_{b}",
    "ERROR DataNode: Broken pipe blk_{b}",
    "ERROR FSNamesystem: BLOCK* invalidateBlocks blk_{b}",
    "WARN BlockManager: blk_{b} missing 2 replicas",
    "INFO BlockManager: ask node to replicate blk_{b} to 10.0.0.2",
    "INFO audit: event_id={e} then e11 of blk_{b}",
    "DEBUG heartbeat of blk_{b}",
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw line per event; the source is the user."""
    events = event_tokens(spark, sf_dir)

    def filled(wording: str) -> Column:
        pieces = wording.replace("{b}", "\0b\0").replace("{e}", "\0e\0").split("\0")
        values = {"b": F.col("event_id").cast("string"), "e": F.col("event")}
        return F.concat(*(values.get(piece, F.lit(piece)) for piece in pieces))

    body = F.coalesce(*(F.when(F.col("k") % 16 == i, filled(wording)) for i, wording in enumerate(_WORDING)))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(
        "user_id", "event_id", "ts", "block_id", F.concat(stamp, F.lit(" "), body).alias("line")
    )


def _sql_wording(wording: str) -> str:
    return "'" + wording.replace("{b}", "' || CAST(event_id AS VARCHAR) || '").replace("{e}", "' || event || '") + "'"


LINES = EV + """,
lines AS (
  SELECT user_id, event_id, ts, block_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE k % 16
""" + "\n".join(f"    WHEN {i} THEN {_sql_wording(wording)}" for i, wording in enumerate(_WORDING)) + """
  END AS line FROM ev),
inferred AS (
  SELECT *, regexp_extract_all(lower(line), '\\be\\d+\\b') AS ids,
    CASE WHEN regexp_matches(line, 'allocate\\s+blk_', 'i') THEN 'e5'
      WHEN regexp_matches(line, 'receiving\\s+block', 'i') THEN 'e26'
      WHEN regexp_matches(line, 'packetresponder.*success', 'i') THEN 'e11'
      WHEN regexp_matches(line, 'completefile', 'i') THEN 'e9'
      WHEN regexp_matches(line, 'addstoredblock', 'i') THEN 'e21'
      WHEN regexp_matches(line, 'state change.*active', 'i') THEN 'e23'
      WHEN regexp_matches(line, 'writeblock', 'i') THEN 'e22'
      WHEN regexp_matches(line, 'finalized block', 'i') THEN 'e3'
      WHEN regexp_matches(line, 'slow blockreceiver', 'i') THEN 'e1'
      WHEN regexp_matches(line, 'checksum mismatch', 'i') THEN 'e17'
      WHEN regexp_matches(line, 'failed to write packet|broken pipe', 'i') THEN 'e19'
      WHEN regexp_matches(line, 'invalidateblocks|corrupt replica', 'i') THEN 'e24'
      WHEN regexp_matches(line, 'missing\\s+\\d+\\s+replicas', 'i') THEN 'e29'
      WHEN regexp_matches(line, 'replicate\\s+blk_.*\\s+to\\s+', 'i') THEN 'e13' END AS template
  FROM lines),
line_events AS (
  SELECT *, CASE WHEN len(ids) > 0 THEN ids WHEN template IS NOT NULL THEN [template] ELSE [] END AS found
  FROM inferred),
extracted AS (
  SELECT user_id, event_id, ts, block_id, CAST(p - 1 AS INTEGER) AS event_pos, found[p] AS event
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS p FROM line_events))
"""

# --- flows ----------------------------------------------------------------------------------

FLOW_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
FLOW_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")

_RAW_LABELS = (
    (1, "Benign"), (2, "DoS attacks-Hulk"), (3, "DDOS attack-HOIC"), (4, "FTP-BruteForce"),
    (5, "Brute Force -XSS"), (6, "Zeta-Storm"), (7, "Label"),
)


def raw_flow_label() -> Column:
    """Label spelling of a line item; some are blank, some header noise, some unknown."""
    named = F.coalesce(*(F.when(F.col("l_linenumber") == n, F.lit(text)) for n, text in _RAW_LABELS))
    return (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.lit(' "Bot" '))
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), F.lit("BENIGN"))
        .when(F.col("l_tax") == 0.08, F.lit("  "))
        .otherwise(named)
    )


FLOWS = """
flows AS (
  SELECT *, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN ' "Bot" '
      WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'BENIGN'
      WHEN l_tax = 0.08 THEN '  '
      ELSE CASE l_linenumber
""" + " ".join(f"WHEN {n} THEN '{text}'" for n, text in _RAW_LABELS) + """ END END AS raw_label
  FROM lineitem),
fine AS (
  SELECT *, CASE WHEN compact IN ('', 'label', 'labels', 'class', 'attack') THEN NULL
      WHEN compact = 'normal' OR contains(compact, 'benign') THEN 'Benign'
      WHEN contains(compact, 'ddos') AND contains(compact, 'hoic') THEN 'DDoS-HOIC'
      WHEN contains(compact, 'hulk') THEN 'DoS-Hulk'
      WHEN contains(compact, 'ftp') AND contains(compact, 'brute') THEN 'Brute Force-FTP'
      WHEN contains(compact, 'xss') THEN 'Web Attack-XSS'
      WHEN contains(compact, 'bot') THEN 'Botnet' END AS fine_label
  FROM (SELECT *, regexp_replace(lower(raw_label), '[^a-z0-9]+', '', 'g') AS compact FROM flows))
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flow rows with a raw label."""
    return table(spark, sf_dir, "lineitem").withColumn("raw_label", raw_flow_label())


def flow_order() -> list[Column]:
    return [F.col(name) for name in FLOW_ORDER]


# --- scored rows ----------------------------------------------------------------------------


def scored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, logits``: ten logits per vector from its first ten values."""
    vectors = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10.0)
    return vectors.select(F.col("vec_id").alias("id"), "label", logits.alias("logits"))


SCORED = """
long AS (
  SELECT vec_id AS id, label, CAST(i - 1 AS INTEGER) AS c, CAST(embedding[i] AS DOUBLE) * 10e0 AS logit
  FROM embeddings, range(1, 11) AS t(i)),
powers AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY id)) AS power FROM long),
probs AS (SELECT *, power / sum(power) OVER (PARTITION BY id) AS p FROM powers),
scored AS (
  SELECT id, label, max(p) AS top_p, CAST(min(c) FILTER (first_place = 1) AS INTEGER) AS prediction,
         sum(p) AS total_p, max(p) FILTER (c = 0) AS normal_p, max(p) FILTER (c = label) AS label_p
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, c) AS first_place FROM probs)
  GROUP BY id, label),
cells AS (SELECT CAST(a.i AS INTEGER) AS label, CAST(b.i AS INTEGER) AS prediction FROM range(10) a(i), range(10) b(i)),
confusion AS (
  SELECT cells.label, cells.prediction, count(scored.id) AS n FROM cells
  LEFT JOIN scored ON scored.label = cells.label AND scored.prediction = cells.prediction GROUP BY 1, 2),
sides AS (
  SELECT c.i AS class_index, (SELECT sum(n) FROM confusion WHERE label = c.i) AS support,
    (SELECT sum(n) FROM confusion WHERE prediction = c.i) AS said,
    (SELECT sum(n) FROM confusion WHERE label = c.i AND prediction = c.i) AS hit
  FROM range(10) c(i)),
rates AS (
  SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0e0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0e0 END AS recall FROM sides),
per_class AS (
  SELECT CAST(class_index AS INTEGER) AS class_index, 'class_' || CAST(class_index AS VARCHAR) AS class_name,
    precision, recall,
    CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1,
    CAST(support AS BIGINT) AS support FROM rates)
"""


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, anomaly, anomaly_score`` of labelled documents; many scores are tied."""
    documents = table(spark, sf_dir, "documents")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("anomaly"),
        ((F.col("n_chars") % 101) / 100.0).alias("anomaly_score"),
    )


JUDGED = """
judged AS (
  SELECT doc_id AS id, quality AS anomaly, (n_chars % 101) / 100e0 AS anomaly_score
  FROM labels JOIN documents USING (doc_id))
"""
