"""The pipeline's stages, each held against a plain version over its own input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomaloom.llm.queries import QUERIES, SQL, tokenizer_file
from anomaloom.llm.secrets import redacted
from compare import connect, differences
from odd import CLASHING
from test_joins import brute_jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage over the smallest documents and some odd rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(None, "no id but words enough to be a text of its own"), (9001, None), (9002, ""), (9003, "token = 'abcdef123456'"), (9003, "token = 'abcdef123456'")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("x"), "n_chars": F.length("text").cast("long")}
    )
    docs = docs.unionByName(extra.select(*docs.columns)).withColumns({name: F.lit("clash") for name in CLASHING})
    found = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        found.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in found}


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_quality_stage_keeps_good_rows(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    rows = before.join(labels, "doc_id").where("quality = 1").select("doc_id").collect()
    assert all(r.doc_id in kept for r in rows)


def test_quality_stage_rejects_what_labels_reject(spark):
    """With some hundred labels; the smallest table has 13 rows of label 0."""
    sf_dir = "/root/testdata/sf0.01"
    after = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert np.mean([r.doc_id not in kept for r in rows if r.quality == 0]) > 0.85
    assert np.mean([r.doc_id in kept for r in rows if r.quality == 1]) > 0.99


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    wanted = {i for i, (_, _, first) in brute_jaccard(rows, 5, 80).items() if i == first}
    kept = [r.doc_id for r in after.select("doc_id").collect()]
    assert {i for i in kept if i is not None} == wanted
    assert len(kept) == len(set(kept))


def test_secret_stage(stages):
    before, after = stages["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    got = after.collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert r.text == (None if text is None else redacted(text, "[SECRET]"))
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_mixing_stage_keeps_rows_once(spark, stages):
    before, after = stages["mixing"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = [r.doc_id for r in after.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= {r.doc_id for r in before.collect()}
    clean = [r.doc_id for r in before.join(labels.where("quality = 1 AND toxic = 0"), "doc_id").collect()]
    assert np.mean([i in kept for i in clean]) >= 0.95


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    before, after = stages["packing"]
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        place = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == place and r.ids_crc32 == zlib.crc32(ids[place : place + r.length].tobytes())
            place += r.length
        assert place == len(ids)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= 5
