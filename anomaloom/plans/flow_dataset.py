"""Flow CSVs to normalised, split windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.functions.labels import check_label_schema
from anomaloom.operators.classes import (
    RARE_BUCKET,
    class_counts,
    index_classes,
    merge_rare_classes,
    ordered_classes,
)
from anomaloom.operators.flows import FEATURE_COUNT, valid_flows
from anomaloom.operators.normalization import (
    apply_normalization,
    fitted_stats,
    normalization_stats,
    normalized_padding,
)
from anomaloom.operators.splits import DEFAULT_RATIOS, DEFAULT_SEED, check_ratios, stratified_split
from anomaloom.operators.windows import (
    DEFAULT_LENGTH,
    DEFAULT_STRIDE,
    cap_windows,
    check_window_shape,
    lay_out_windows,
    row_cap_per_file,
    valid_row_number,
    window_keys,
)
from anomaloom.session import in_staging, stage
from anomaloom.sources.csv_files import read_flow_csvs
from anomaloom.sources.datasets import write_dataset


@dataclass(frozen=True)
class FlowDataset:
    rows: DataFrame
    classes: DataFrame
    stats: DataFrame
    summary: DataFrame
    feature_names: list[str]


@in_staging
def prepare_flow_dataset(
    spark: SparkSession,
    directory: str,
    output: str,
    length: int = DEFAULT_LENGTH,
    stride: int = DEFAULT_STRIDE,
    feature_count: int = FEATURE_COUNT,
    schema: str = "fine",
    force: bool = True,
    min_support: int = 1,
    rare_bucket: str = RARE_BUCKET,
    max_windows: int | None = None,
    max_files: int | None = None,
    max_rows_per_file: int | None = None,
    add_totals: bool = True,
    ratios: Sequence[float] = DEFAULT_RATIOS,
    seed: int = DEFAULT_SEED,
) -> FlowDataset:
    """Read, clean, number, sample, split, normalise and write ``file, w, X, y`` by split.

    Rows are parsed once and staged, then numbered and staged again, so that every later pass reads
    the columns it needs; sampling, class order and split work on window keys alone; rows are
    normalised before they are laid out into windows.

    All windows are kept unless ``max_windows`` asks for a uniform sample of at most so many, taken
    before the class order, the split and the normalisation.
    """
    check_window_shape(length, stride)
    check_label_schema(schema)
    check_ratios(ratios)
    if feature_count <= 0:
        raise ValueError("feature count must be positive")
    table = read_flow_csvs(spark, directory, max_files, feature_count, add_totals)
    raw = table.rows if max_rows_per_file is None else row_cap_per_file(table.rows, max_rows_per_file)
    parsed = stage(valid_flows(raw, schema, force), "parsed")
    numbered = stage(valid_row_number(parsed), "flows")

    keys = cap_windows(window_keys(numbered, length, stride), max_windows, seed)
    merged = merge_rare_classes(keys, min_support, "label", schema, rare_bucket)
    classes = ordered_classes(merged, "label", schema, force, rare_bucket)
    indexed = index_classes(merged, classes)
    split = stage(stratified_split(indexed, "y", ["file", "w"], ratios, seed), "windows")
    if split.isEmpty():
        raise ValueError(f"no windows in {directory}")

    stats = normalization_stats(numbered, split.where(F.col("split") == "train"), length, stride)
    mean, std = fitted_stats(stats)
    scaled = apply_normalization(numbered, mean, std)
    windows = lay_out_windows(
        scaled, length, stride, selected=split.select("file", "w"), pad=normalized_padding(mean, std)
    )
    rows = windows.join(split.select("file", "w", "y", "split"), ["file", "w"]).withColumnRenamed("window", "X")
    names = spark.createDataFrame(list(enumerate(table.feature_names)), "feature_index int, feature_name string")
    write_dataset(rows, output, {"classes": classes, "normalization": stats, "features": names})
    written = spark.read.parquet(f"{output}/data")
    summary = class_counts(written.select("split", "y"), spark.read.parquet(f"{output}/classes"), "y", ["split"])
    return FlowDataset(
        written, spark.read.parquet(f"{output}/classes"), spark.read.parquet(f"{output}/normalization"), summary,
        table.feature_names,
    )
