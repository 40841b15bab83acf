"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage is one of the operators of ``anomaloom.llm`` over all rows that the stage before it kept.
A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.llm.jaccard_join import jaccard_join
from anomaloom.llm.mixing import Settings as MixSettings
from anomaloom.llm.mixing import apply_rates, mix_sources
from anomaloom.llm.packing import pack
from anomaloom.llm.quality import Settings as QualitySettings
from anomaloom.llm.quality import fit_quality, score_quality
from anomaloom.llm.queries import QUALITY_THRESHOLD, tokenizer_file
from anomaloom.llm.rows import first_of_groups
from anomaloom.llm.secrets import redact_secrets
from anomaloom.session import shared_folder

#: Shares of expected tokens; low quality has been rejected before and is not matched.
MIX_TARGETS = {"good": 0.98, "toxic": 0.02}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labels, does not reject."""
    settings = QualitySettings()
    weights = fit_quality(docs.select("doc_id", "text"), _labels(spark, sf_dir), settings)
    rows = docs.withColumn("__quality_body", F.coalesce("text", F.lit("")).cast("binary"))
    scored = score_quality(rows, weights, settings.bits, "__quality_body", "__quality_score")
    return scored.where(F.col("__quality_score") >= QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 or more alike: the smallest id.

    Documents without words are linked with nothing, and all stay.
    """
    return first_of_groups(docs, jaccard_join(docs, shingle=5, percent=80))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced; ``n_chars`` follows the text."""
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that their rates keep; none is repeated."""
    rates = mix_sources(docs, _labels(spark, sf_dir), MixSettings(targets=MIX_TARGETS, most=1.0))
    return apply_rates(docs, rates, repeat=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, one row per piece of a document."""
    packed = pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, length=2048)
    return packed.withColumnRenamed("row_id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Training, lexing and tokenising are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
