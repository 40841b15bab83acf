"""Queries of the corpus operators over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.llm.byte_pairs import encode_digests
from anomaloom.llm.byte_repeats import remove_byte_repeats
from anomaloom.llm.grid_join import join_near_vectors
from anomaloom.llm.jaccard_join import jaccard_join
from anomaloom.llm.mixing import mix_sources
from anomaloom.llm.multi_index import nearest
from anomaloom.llm.packing import pack
from anomaloom.llm.quality import Settings, fit_quality, score_quality
from anomaloom.llm.secrets import scan_secrets
from anomaloom.llm.source_audit import audit_sources
from anomaloom.llm.spelling import spelling_variants
from anomaloom.llm.token_files import read_token_files, write_token_files
from anomaloom.llm.word_repeats import remove_word_repeats
from anomaloom.session import shared_folder

#: Share of label 1 from which a text is predicted as good.
QUALITY_THRESHOLD = 0.3
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` gives the same result in plain SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; every executor has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda w : w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i : array_to_string(w[i:i+2], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, sym.y FROM r JOIN sym ON r.y = sym.x)
  SELECT x, min(y) AS m FROM r GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM sym GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  coalesce(degree.n, 0)::BIGINT AS n_links
FROM sets LEFT JOIN reach ON reach.x = doc_id LEFT JOIN degree ON degree.x = doc_id
"""
)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined on three-word shingle sets at a Jaccard similarity of 0.9."""
    joined = jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return joined.select(F.col("row_id").alias("doc_id"), "n_shingles", "component_id", "n_links")


@query(
    r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w : w <> '') AS w FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+19], ' ')) AS h FROM spots JOIN words USING (doc_id)),
repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM repeats),
lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k : js IS NULL OR NOT list_contains(js, k)), ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""
)
def op10_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier too."""
    cut = remove_word_repeats(table(spark, sf_dir, "documents"), window=20, with_text=False)
    return cut.select(F.col("row_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    settings = Settings()
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = fit_quality(docs.select("doc_id", "text"), labels.where(~held_out), settings)
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    scored = score_quality(rows, weights, settings.bits)
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, length=2048)
    return packed.withColumnRenamed("row_id", "doc_id")


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back through their index."""
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, folder).withColumnRenamed("row_id", "doc_id")


@query()
def op2_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that start anywhere else too."""
    cut = remove_byte_repeats(table(spark, sf_dir, "documents"), window=400, with_text=False)
    return cut.withColumnRenamed("row_id", "doc_id")


@query()
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns, and literals assigned to sensitive names."""
    return scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


@query(
    """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x)
  SELECT x, min(y) AS m FROM r GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN reach ON reach.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""
)
def op1_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings joined at a cosine of 0.9."""
    joined = join_near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.9)
    return joined.withColumnRenamed("row_id", "vec_id")


@query()
def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth embedding."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, F.col("vec_id") % 100 == 0, neighbours=10).withColumnRenamed("row_id", "vec_id")


@query()
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the domains of the labelled table to their target shares."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.withColumnRenamed("row_id", "doc_id").drop("row_hash")


@query(
    r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30),
uses AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs)
  SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM uses GROUP BY ALL),
lang_sizes AS (SELECT lang, sum(n)::HUGEINT AS size FROM uses GROUP BY lang),
lang_uses AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM uses GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (coalesce(s.size, 0) + 5 * v))::BIGINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN vocab USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
lang_shares AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (size + 5 * v))::BIGINT AS q
  FROM lang_uses JOIN lang_sizes USING (lang) JOIN vocab USING (lang)),
distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN distances d ON d.lang = g.lang AND d.source = g.source AND d.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
)
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of every language, and the terms that mark a source."""
    return audit_sources(table(spark, sf_dir, "documents"))


@query(
    r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS uses FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
steps AS (
  SELECT list_transform(range(256), lambda b : list_reduce(list_prepend(b, range(8)),
    lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
marks AS (
  SELECT doc_id, run, uses, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
sums AS (
  SELECT run, uses, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
    lambda i : ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b : xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM marks, steps),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word, uses FROM sums),
words AS (
  SELECT word, sum(uses)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(uses) >= 5),
short AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM short a JOIN short b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM short a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM short a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 5 * n),
chain AS (
  SELECT word, form AS root, 1 AS depth FROM forms
  UNION ALL SELECT chain.word, forms.form, depth + 1 FROM chain JOIN forms ON forms.word = chain.root),
roots AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, words.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))


@query()
def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the byte-pair ranks, and decoded again."""
    import public_tokenizers

    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_digests(table(spark, sf_dir, "documents"), ranks, pattern).withColumnRenamed("row_id", "doc_id")
