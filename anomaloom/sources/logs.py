"""Raw log text as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from anomaloom.functions.text import split_inner_lines, split_lines
from anomaloom.sources.csv_files import with_position


def read_log_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, block_start, line_id, part, line`` in file order by the three middle columns.

    Splittable: no file is read by one task as a whole. ``part`` counts pieces of a text line at
    rarer line ends (form feed and the like).
    """
    lines = with_position(spark.read.text(path))
    return lines.select(
        F.col("file").alias("source"),
        "block_start",
        "line_id",
        F.posexplode(split_inner_lines(F.col("value"))).alias("part", "line"),
    )


LOG_ORDER = ("block_start", "line_id", "part")


def lines_from_text(df: DataFrame, text_col: str) -> DataFrame:
    """One row per line of a multi-line text or array column, numbered from 0 in ``line_no``."""
    kind = df.schema[text_col].dataType.typeName()
    lines = F.col(text_col) if kind == "array" else split_lines(F.col(text_col))
    others = [name for name in df.columns if name != text_col]
    return df.select(*others, F.posexplode(lines).alias("line_no", "line"))
