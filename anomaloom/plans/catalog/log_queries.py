"""Queries over log lines, token sequences, block labels and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.functions import labels, text
from anomaloom.operators import events, vocab
from anomaloom.plans.block_dataset import join_labels as join_block_labels
from anomaloom.plans.catalog.inputs import EV, EVENT_ORDER, LINES, RULES, event_tokens, log_lines
from anomaloom.plans.catalog.registry import query, table
from anomaloom.plans.log_analysis import classify_lines, key_statistics
from anomaloom.session import stage
from anomaloom.sources.datasets import parse_vocab
from anomaloom.sources.logs import lines_from_text as explode_lines


def _order():
    return [F.col(name) for name in EVENT_ORDER]


# --- lines and events -----------------------------------------------------------------------


@query(f"WITH {LINES} SELECT event_id, event_pos, event FROM extracted")
def extract_events(spark, d):
    return events.extract_events(log_lines(spark, d)).select("event_id", "event_pos", "event")


@query(f"""WITH {LINES} SELECT user_id, CAST(sum(len(ids)) AS BIGINT) AS from_event_id,
  count(*) FILTER (len(ids) = 0 AND template IS NOT NULL) AS from_template,
  count(*) FILTER (len(ids) = 0 AND template IS NULL) AS unmatched_lines FROM inferred GROUP BY 1""")
def extraction_stats(spark, d):
    return events.extraction_stats(log_lines(spark, d), ["user_id"])


@query(f"WITH {LINES} SELECT event_id, coalesce(template, '') AS template FROM inferred")
def template_inference(spark, d):
    inferred = text.infer_event_from_template(F.col("line"))
    return log_lines(spark, d).select("event_id", F.coalesce(inferred, F.lit("")).alias("template"))


@query(f"WITH {LINES} SELECT event_id, array_to_string(ids, ' ') AS ids FROM inferred")
def explicit_event_ids(spark, d):
    return log_lines(spark, d).select(
        "event_id", F.array_join(text.extract_event_ids(F.col("line")), " ").alias("ids")
    )


@query(f"""WITH {LINES}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_pos) - 1 AS pos FROM extracted)
SELECT user_id, CAST(pos // 16 AS INTEGER) AS chunk_no, string_agg(event, ' ' ORDER BY pos) AS tokens FROM placed GROUP BY 1, 2""")
def assemble_sequences(spark, d):
    found = stage(events.extract_events(log_lines(spark, d)), "events")
    chunks = events.assemble_sequences(found, ["user_id"], [*_order(), F.col("event_pos")], chunk=16)
    return chunks.withColumn("tokens", F.array_join("tokens", " "))


@query(f"""WITH {EV}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS event_count FROM ev)
SELECT user_id, string_agg(event, ' ' ORDER BY ts, event_id) AS tail, max(event_count) AS event_count FROM placed WHERE back <= 20 GROUP BY 1""")
def sequence_tails(spark, d):
    tails = events.sequence_tails(event_tokens(spark, d), ["user_id"], _order(), 20)
    return tails.withColumn("tail", F.array_join("tail", " "))


_LINE_RULES = (
    f"{LINES}, upper_events AS (SELECT block_id, upper(event) AS event, 0 AS k FROM extracted)"
    + RULES.removeprefix(EV).replace("FROM ev GROUP BY", "FROM upper_events GROUP BY")
)


@query(f"WITH {_LINE_RULES} SELECT block_id, anomaly_type, severity, confidence, matched_rules FROM classified")
def classify_log_lines(spark, d):
    classified = classify_lines(log_lines(spark, d), ["block_id"])
    return classified.select(
        "block_id", "anomaly_type", "severity", "confidence", F.array_join("matched_rules", "|").alias("matched_rules")
    )


@query("""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS parts FROM documents)))""")
def lines_from_text(spark, d):
    return explode_lines(table(spark, d, "documents").select("doc_id", "text"), "text")


# --- tokens ---------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(text, '[A-Za-z0-9_:\\-/\\.]+')"


def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.tokenize_sequence(F.col("text")).alias("tokens"))


@query(f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(lower(array_to_string(t, ' '))) AS tokens_md5
FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)""")
def tokenize_documents(spark, d):
    return document_tokens(spark, d).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


@query(f"""WITH {EV}, rows AS (
  SELECT block_id, list(event ORDER BY ts, event_id) AS events, max(event_type = 'error') AS failed, max(event_type = 'view') AS viewed FROM ev GROUP BY 1)
SELECT block_id, CASE WHEN failed OR viewed THEN array_to_string(events, '|') ELSE '' END AS tokens FROM rows""")
def sequence_tokens(spark, d):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*EVENT_ORDER, "event"))), lambda e: e["event"])
    kind = F.col("event_type")
    rows = event_tokens(spark, d).groupBy("block_id").agg(
        ordered.alias("events"), F.max(kind == "error").alias("failed"), F.max(kind == "view").alias("viewed")
    )
    tokens = text.tokens_from_sequence(
        F.when(F.col("failed"), F.col("events")), F.when(F.col("viewed"), F.array_join("events", " , "))
    )
    return rows.select("block_id", F.array_join(tokens, "|").alias("tokens"))


@query(f"WITH {EV} SELECT event_id, upper(event_type) AS upper_events, lower(event) AS lower_events FROM ev")
def normalize_events(spark, d):
    """Event names with stray blanks and empty entries."""
    raw = F.array(F.concat(F.lit(" "), "event_type", F.lit("\t")), F.lit(" "))
    return event_tokens(spark, d).select(
        "event_id",
        F.array_join(text.normalize_events(raw), "|").alias("upper_events"),
        F.array_join(text.token_case(F.array("event"), upper=False), "|").alias("lower_events"),
    )


# --- blocks and labels ----------------------------------------------------------------------

_RAW_BLOCK_LABEL = {
    "error": ' "Anomaly" ', "click": "normal", "view": "0", "signup": "'TRUE'", "purchase": "maybe",
}
_SQL_LABEL = "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 0 WHEN 'view' THEN 0 WHEN 'signup' THEN 1 END"


def raw_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label row per event, with quoted block ids and many label spellings."""
    spelled = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _RAW_BLOCK_LABEL.items()))
    return event_tokens(spark, d).select(
        F.concat(F.lit(' "'), "block_id", F.lit("\" ")).alias("BlockId"), spelled.alias("Label"), *EVENT_ORDER
    )


def clean_labels(spark: SparkSession, d: str) -> DataFrame:
    return raw_labels(spark, d).select(
        text.normalize_block_id(F.col("BlockId")).alias("block_id"),
        labels.parse_binary_label(F.col("Label")).alias("label"),
        *EVENT_ORDER,
    )


@query(f"WITH {EV} SELECT event_id, block_id, coalesce({_SQL_LABEL}, -1) AS label FROM ev")
def parse_block_labels(spark, d):
    return clean_labels(spark, d).select("event_id", "block_id", F.coalesce("label", F.lit(-1)).alias("label"))


_LABELS = f"""
labels_of AS (SELECT block_id, arg_max(label, (ts, event_id)) AS label
  FROM (SELECT block_id, ts, event_id, {_SQL_LABEL} AS label FROM ev) WHERE label IS NOT NULL GROUP BY 1)
"""


def block_labels(spark: SparkSession, d: str) -> DataFrame:
    known = clean_labels(spark, d).where(F.col("label").isNotNull())
    return events.last_wins(known, ["block_id"], EVENT_ORDER).select("block_id", "label")


@query(f"WITH {EV}, {_LABELS} SELECT block_id, label FROM labels_of")
def last_wins(spark, d):
    return block_labels(spark, d)


def block_traces(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*EVENT_ORDER, "event"))), lambda e: F.lower(e["event"]))
    return event_tokens(spark, d).groupBy("block_id").agg(ordered.alias("tokens"))


_TRACES = "traces AS (SELECT block_id, list(lower(event) ORDER BY ts, event_id) AS tokens FROM ev GROUP BY 1)"


@query(f"""WITH {EV}, {_LABELS}, {_TRACES}
SELECT block_id, array_to_string(tokens, ' ') AS tokens, label FROM traces JOIN labels_of USING (block_id) ORDER BY block_id""")
def join_labels(spark, d):
    joined = join_block_labels(block_traces(spark, d), block_labels(spark, d))
    return joined.select("block_id", F.array_join("tokens", " ").alias("tokens"), "label").orderBy("block_id")


# --- vocabulary -----------------------------------------------------------------------------

_DOC_TOKENS = f"""
words AS (
  SELECT doc_id, p, lower(t[p]) AS token FROM (
    SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))),
counted AS (SELECT token, count(*) AS n, min((doc_id, p)) AS first_at FROM words GROUP BY 1)
"""
_VOCAB = _DOC_TOKENS + """,
vocab AS (
  SELECT '<PAD>' AS token, 0 AS token_id UNION ALL SELECT '<UNK>', 1
  UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY n DESC, first_at) + 1 AS INTEGER)
  FROM (SELECT * FROM counted WHERE n >= 2 ORDER BY n DESC, first_at LIMIT 1998))
"""


@query(f"WITH {_DOC_TOKENS} SELECT token, n FROM counted")
def token_counts(spark, d):
    return vocab.token_counts(document_tokens(spark, d))


def tokens_and_vocab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Token arrays, staged because several passes read them, and their vocabulary."""
    tokens = stage(document_tokens(spark, d), "tokens")
    return tokens, vocab.build_vocab(tokens, ["doc_id"], max_vocab=2000)


@query(f"WITH {_VOCAB} SELECT token, token_id FROM vocab")
def vocab_topk(spark, d):
    return tokens_and_vocab(spark, d)[1]


_ENCODED = f"""WITH {_VOCAB}, sized AS (SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS total FROM documents),
ids AS (
  SELECT doc_id, p, coalesce(token_id, 1) AS id FROM words JOIN sized USING (doc_id) LEFT JOIN vocab USING (token) WHERE p > total - 128),
joined AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p) AS kept FROM ids GROUP BY 1)
SELECT doc_id, trim(repeat('0 ', greatest(128 - total, 0)) || coalesce(kept, '')) AS token_ids FROM sized LEFT JOIN joined USING (doc_id)"""


@query(_ENCODED)
def encode_sequences(spark, d):
    encoded = vocab.encode_tokens(*tokens_and_vocab(spark, d), 128, key=["doc_id"])
    return encoded.select("doc_id", F.array_join("token_ids", " ").alias("token_ids"))


@query(_ENCODED.replace("coalesce(token_id, 1)", "coalesce(token_id, 7)"))
def encode_large_vocab(spark, d):
    """The path of a vocabulary too large for an expression, with an id of its own for unknown tokens."""
    tokens, words = tokens_and_vocab(spark, d)
    own = F.when(F.col("token") == "<UNK>", F.lit(7)).otherwise(F.col("token_id"))
    encoded = vocab.encode_tokens(tokens, words.withColumn("token_id", own), 128, literal_entries=0)
    return encoded.select("doc_id", F.array_join("token_ids", " ").alias("token_ids"))


@query(f"""WITH {_VOCAB}, marked AS (
  SELECT doc_id, p, token, vocab.token IS NULL AS missing FROM words LEFT JOIN vocab USING (token)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, missing ORDER BY p) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) AS back FROM marked),
summed AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS total, CAST(count(*) FILTER (missing) AS INTEGER) AS unknown,
    string_agg(token, ' ' ORDER BY p) FILTER (missing AND m <= 20) AS shown, string_agg(token, ' ' ORDER BY p) FILTER (back <= 20) AS tail
  FROM numbered GROUP BY 1)
SELECT doc_id, coalesce(total, 0) AS event_token_count, coalesce(total - unknown, 0) AS known_event_count, coalesce(unknown, 0) AS unknown_event_count,
  coalesce(shown, '') AS unknown_event_tokens, coalesce(tail, '') AS event_tokens_tail FROM documents LEFT JOIN summed USING (doc_id)""")
def unknown_tokens(spark, d):
    marked = vocab.unknown_tokens(*tokens_and_vocab(spark, d), key=["doc_id"])
    return marked.drop("tokens").withColumns(
        {name: F.array_join(name, " ") for name in ("unknown_event_tokens", "event_tokens_tail")}
    )


@query("""WITH entries AS (SELECT event_id, 'k' AS token, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS token_id FROM events)
SELECT token, token_id, count(*) AS n FROM entries GROUP BY 1, 2 UNION ALL SELECT '<PAD>', 0, 1 UNION ALL SELECT '<UNK>', 1, 1""")
def read_vocab(spark, d):
    """The events' JSON maps, each read as a vocabulary document."""
    return parse_vocab(table(spark, d, "events").select("props"), "props").groupBy("token", "token_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"""WITH {_VOCAB}, sized AS (SELECT doc_id, len({_TOKENS}) AS total FROM documents),
used AS (SELECT max(token_id) AS top FROM vocab JOIN words USING (token) JOIN sized USING (doc_id) WHERE p > total - 128)
SELECT CAST(top + 1 AS INTEGER) AS vocab_size FROM used""")
def infer_vocab_size(spark, d):
    encoded = vocab.encode_tokens(*tokens_and_vocab(spark, d), 128, key=["doc_id"])
    return vocab.infer_vocab_size(encoded)


_KNOWN_LINES = "SELECT DISTINCT event FROM extracted WHERE event_id % 50 = 0"


@query(f"""WITH {LINES}, known AS ({_KNOWN_LINES}), day_of AS (SELECT *, strftime(ts, '%Y%m%d') AS day FROM extracted),
unknown AS (SELECT day, event, row_number() OVER (PARTITION BY day ORDER BY ts, event_id, event_pos) AS nth FROM day_of WHERE event NOT IN (FROM known)),
shown AS (SELECT day, string_agg(event, ' ' ORDER BY nth) AS first_unknown, max(total) AS unknown_event_count
  FROM (SELECT *, count(*) OVER (PARTITION BY day) AS total FROM unknown) WHERE nth <= 20 GROUP BY 1),
lines_of AS (SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n_lines, CAST(sum(len(ids)) AS BIGINT) AS from_event_id,
  count(*) FILTER (len(ids) = 0 AND template IS NOT NULL) AS from_template, count(*) FILTER (len(ids) = 0 AND template IS NULL) AS unmatched_lines
  FROM inferred GROUP BY 1),
counts_of AS (SELECT day, count(*) AS event_token_count, count(*) FILTER (lower(event) = 'e5') AS n_e5, count(*) FILTER (lower(event) = 'e22') AS n_e22 FROM day_of GROUP BY 1)
SELECT day, n_lines, from_event_id, from_template, unmatched_lines, event_token_count, n_e5, n_e22, coalesce(unknown_event_count, 0) AS unknown_event_count,
  event_token_count - coalesce(unknown_event_count, 0) AS known_event_count, coalesce(first_unknown, '') AS unknown_event_tokens
FROM lines_of JOIN counts_of USING (day) LEFT JOIN shown USING (day)""")
def log_record_stats(spark, d):
    """All counters of a record with a day as the key, far more events than a model reads."""
    lines = log_lines(spark, d).withColumn("day", F.date_format("ts", "yyyyMMdd"))
    found = stage(events.line_events(lines.select("day", *EVENT_ORDER, "line")), "line-events")
    words = events.extract_events(log_lines(spark, d)).where("event_id % 50 = 0").select(F.col("event").alias("token")).distinct()
    counted = key_statistics(found, ["day"], EVENT_ORDER, words)
    return counted.select(
        "day", "n_lines", "from_event_id", "from_template", "unmatched_lines", "event_token_count", "n_e5", "n_e22",
        "unknown_event_count", "known_event_count", F.array_join("unknown_event_tokens", " ").alias("unknown_event_tokens"),
    )
