"""Block traces and labels to an encoded, split dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.operators.classes import class_table
from anomaloom.operators.evaluation import dataset_summary
from anomaloom.operators.splits import DEFAULT_RATIOS, DEFAULT_SEED, check_ratios, stratified_split
from anomaloom.operators.vocab import build_vocab, check_vocab_limits, encode_tokens
from anomaloom.session import in_staging, stage
from anomaloom.sources.csv_files import read_block_labels, read_event_traces
from anomaloom.sources.datasets import write_dataset

CLASS_NAMES = ("Normal", "Anomaly")


def join_labels(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Traces that have a label. Both sides hold one row per block, so no key is hot."""
    return traces.join(labels, "block_id", "inner")


@dataclass(frozen=True)
class BlockDataset:
    rows: DataFrame
    vocab: DataFrame
    summary: DataFrame


@in_staging
def prepare_block_dataset(
    spark: SparkSession,
    trace_path: str,
    label_path: str,
    output: str,
    sequence_length: int = 128,
    max_vocab: int = 8192,
    min_frequency: int = 2,
    ratios: Sequence[float] = DEFAULT_RATIOS,
    seed: int = DEFAULT_SEED,
) -> BlockDataset:
    """Read, join, encode, split and write ``block_id, X, y`` by split, with vocabulary and classes.

    The joined rows are staged once: vocabulary, split and encoding read them again.
    """
    check_vocab_limits(sequence_length, max_vocab, min_frequency)
    check_ratios(ratios)
    joined = stage(
        join_labels(read_event_traces(spark, trace_path), read_block_labels(spark, label_path)), "blocks"
    )
    if joined.isEmpty():
        raise ValueError("no block has both a trace and a label")
    vocab = build_vocab(joined, ["block_id"], "tokens", max_vocab, min_frequency)
    splits = stratified_split(joined.select("block_id", F.col("label").alias("y")), "y", ["block_id"], ratios, seed)
    encoded = encode_tokens(joined, vocab, sequence_length, output="X", key=["block_id"])
    rows = encoded.select("block_id", "X").join(splits, "block_id")
    write_dataset(rows, output, {"vocab": vocab, "classes": class_table(spark, CLASS_NAMES)})
    written = spark.read.parquet(f"{output}/data")
    return BlockDataset(written, spark.read.parquet(f"{output}/vocab"), dataset_summary(written))
