"""Sliding windows over the rows of each file.

Rows are numbered per file first (``row_number_*`` in the ranking module). A window is named by its
file and index ``w``: it starts at row ``w * stride`` (from 0) and spans ``length`` rows. A file with
fewer rows has one window, padded in front with zero rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.functions.numeric import let
from anomaloom.operators.ranking import hash_bucket, hash_order, row_number_by_bucket, row_number_in_order

# Rows of a file that are laid out together, beside the rows shared with the next block.
BLOCK_ROWS = 1024
DEFAULT_LENGTH, DEFAULT_STRIDE = 64, 4


def check_window_shape(length: int, stride: int) -> None:
    if length <= 0:
        raise ValueError("window length must be positive")
    if stride <= 0:
        raise ValueError("stride must be positive")


def valid_row_number(df: DataFrame, output: str = "rn", at_most: int | None = None) -> DataFrame:
    """Number the rows of each scanned file; one file split is the largest unit that is sorted."""
    return row_number_by_bucket(df, ["file"], ["block_start"], ["line_id"], output, at_most)


def row_cap_per_file(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each scanned file."""
    if n <= 0:
        raise ValueError("max rows per file must be positive")
    return valid_row_number(df, "__rn", at_most=n).drop("__rn")


def number_rows(df: DataFrame, file: str, order: Sequence[Column], output: str = "rn", **sizes: int) -> DataFrame:
    """Number the rows of each file by explicit sort columns."""
    return row_number_in_order(df, [file], order, output, **sizes)


def window_keys(
    numbered: DataFrame, length: int, stride: int, file: str = "file", label: str = "label"
) -> DataFrame:
    """``file, w, n_rows, label`` of every window; only row numbers and labels are read.

    The label is that of the last row; ``n_rows`` is below ``length`` for a padded window.
    """
    check_window_shape(length, stride)
    light = numbered.select(file, "rn", label)
    full = light.where((F.col("rn") >= length) & ((F.col("rn") - length) % stride == 0)).select(
        file,
        F.floor((F.col("rn") - length) / stride).cast("bigint").alias("w"),
        F.lit(length).cast("bigint").alias("n_rows"),
        label,
    )
    # A file is short if it has no row number ``length``; later rows need no look.
    short = (
        light.where(F.col("rn") <= length)
        .groupBy(file)
        .agg(F.max("rn").cast("bigint").alias("n_rows"), F.max_by(label, "rn").alias(label))
        .where(F.col("n_rows") < length)
        .select(file, F.lit(0).cast("bigint").alias("w"), "n_rows", label)
    )
    return full.unionByName(short)


def cap_windows(keys: DataFrame, max_windows: int | None, seed: int, file: str = "file") -> DataFrame:
    """A uniform sample of at most ``max_windows`` windows: the smallest seeded hashes.

    Works on window keys, before any window is laid out.
    """
    if max_windows is None:
        return keys
    hashed = keys.withColumn("__h", hash_order(seed, F.col(file), F.col("w"))).withColumn(
        "__hb", hash_bucket(F.col("__h"))
    )
    kept = row_number_by_bucket(hashed, [], ["__hb"], ["__h", file, "w"], "__rank", at_most=max_windows)
    return kept.select(*keys.columns)


def lay_out_windows(
    numbered: DataFrame,
    length: int,
    stride: int,
    file: str = "file",
    features: str = "features",
    selected: DataFrame | None = None,
    pad: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``file, w, window`` with ``window`` an array of ``length`` feature arrays.

    Rows are shipped in blocks of about ``block_rows`` with the overlap repeated once per block, not
    once per window, and a block is the most one task holds of a file. With ``selected`` (window
    keys) only the blocks of these windows are shipped. ``pad`` is the row put before short files,
    zeros by default.
    """
    check_window_shape(length, stride)
    step = stride * math.ceil(max(block_rows, length) / stride)
    overlap = max(length - stride, 0)
    at = F.col("rn") - 1
    own = F.floor(at / step)
    homes = F.when((at % step < overlap) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    copies = numbered.select(file, "rn", features, F.explode(homes).alias("__block"))
    wanted = None
    if selected is not None:
        wanted = (
            selected.select(file, "w", F.floor(F.col("w") * stride / step).alias("__block"))
            .groupBy(file, "__block")
            .agg(F.collect_list("w").alias("__wanted"))
        )
        copies = copies.join(wanted.select(file, "__block"), [file, "__block"], "left_semi")
    blocks = copies.groupBy(file, "__block").agg(
        F.sort_array(F.collect_list(F.struct("rn", F.col(features).alias("x")))).alias("__rows")
    )
    blocks = blocks.withColumns({"__first": F.col("__block") * step, "__last": F.element_at("__rows", -1)["rn"]})
    if wanted is not None:
        starts = F.transform("__wanted", lambda w: w * stride)
        blocks = blocks.join(wanted, [file, "__block"])
    else:
        end = F.least(F.col("__first") + (step - stride), F.col("__last") - length)
        starts = (
            F.when(end >= F.col("__first"), F.sequence(F.col("__first"), end, F.lit(stride).cast("bigint")))
            .when(F.col("__last") < length, F.array(F.lit(0).cast("bigint")))
            .otherwise(F.array().cast("array<bigint>"))
        )
    if pad is None:
        pad = F.transform(F.element_at("__rows", 1)["x"], lambda _: F.lit(0).cast("float"))

    def window(rows: Column) -> Column:
        padding = F.array_repeat(pad, F.greatest(F.lit(length) - F.size(rows), F.lit(0)))
        return F.when(F.size(rows) == length, rows).otherwise(F.concat(padding, rows))

    def cut(rows: Column) -> Column:
        def one(start: Column) -> Column:
            begin = (start - F.col("__first") + 1).cast("int")
            shape = let(F.slice(rows, begin, F.lit(length)), window)
            return F.struct(F.floor(start / stride).cast("bigint").alias("w"), shape.alias("window"))

        return F.transform(starts, one)

    # The windows of a block are cut side by side, so its rows are not copied once per window. An inner
    # generator would be given a filter that cuts them all a second time.
    laid_out = blocks.select(file, F.inline_outer(let(F.col("__rows")["x"], cut)))
    return laid_out.where(F.col("w").isNotNull())
