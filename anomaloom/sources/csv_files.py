"""CSV sources: block traces, block labels, flow directories."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from anomaloom.functions.labels import parse_binary_label
from anomaloom.functions.text import normalize_block_id, tokenize_sequence
from anomaloom.operators.events import last_wins
from anomaloom.operators.flows import feature_names, select_feature_columns, total_cells, with_flow_features
from anomaloom.sources.columns import (
    BLOCK_COLUMNS,
    BLOCK_LABEL_COLUMNS,
    FLOW_LABEL_COLUMNS,
    SEQUENCE_COLUMNS,
    require_column,
)
from anomaloom.sources.containers import opened

# Place of a row in its input: file, then split, then a number that grows inside the split.
POSITION = ("file", "block_start", "line_id")
#: Bytes that one read takes from the head of a file.
HEAD_BYTES = 64 << 10
_LINE_END = re.compile(rb"[\r\n]")


def with_position(df: DataFrame) -> DataFrame:
    """Add the place columns to a fresh file scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
    )


def list_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> list[str]:
    """Matching files, sorted by name (file contents are not read)."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return sorted(row.path for row in listing.select("path").collect())


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header cells of one CSV file; empty for an empty file."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select("value")
    first = lines.first()
    return next(csv.reader([first.value.removeprefix("\ufeff")]), []) if first else []


def _first_lines(listed: DataFrame) -> DataFrame:
    """``path, header``: the first line of every listed file that is not empty. A task opens its files and
    reads them up to the first line break; compressed ones (``.gz``, ``.bz2``, ``.zst``) are unpacked that far."""

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lines = [first_line(path) for path in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(lines, pa.string())], names=["path", "header"])

    heads = listed.select("path").mapInArrow(read, "path string, header string")
    return heads.where(F.col("header").isNotNull())


def first_line(path: str, piece: int = HEAD_BYTES) -> str | None:
    """First line of a file; None for an empty one."""
    store, place = opened(path)
    held = bytearray()
    with store.open_input_stream(place) as file:
        while more := file.read(piece):
            end = _LINE_END.search(more)
            held += more[: end.start()] if end else more
            if end:
                return held.decode("utf-8-sig", "replace")
    return held.decode("utf-8-sig", "replace") if held else None


def _scanned_lines(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """``path, header`` by a scan, for file systems that only Spark can open."""
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .text(directory)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
        .where(F.col("start") == 0)
        .withColumn("id", F.monotonically_increasing_id())
    )
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    first = lines.groupBy("file").agg(F.min_by("value", "id").alias("header"))
    return first.join(listed.select("path", F.col("_metadata.file_path").alias("file")), "file").select("path", "header")


def distinct_headers(
    spark: SparkSession, directory: str, max_files: int | None = None, pattern: str = "*.csv"
) -> list[tuple[tuple[str, ...], list[str]]]:
    """Each distinct header of the files of a folder with the files that have it, in name order.

    One job reads the first bytes of every file, whatever its size; headers that are equal as text come
    back once, with the paths their scans need. ``max_files`` takes the first files by name. On a file
    system that :mod:`pyarrow.fs` cannot open, the headers come from a scan.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path")
    if max_files is not None:
        listed = listed.orderBy("path").limit(max_files)
    any_file = listed.first()
    if any_file is None:
        return []
    if _opens(any_file.path):
        first = _first_lines(listed)
    else:
        first = _scanned_lines(spark, directory, pattern).join(listed, "path", "left_semi")
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    found = [
        (tuple(next(csv.reader([row["header"].removeprefix("\ufeff")]), [])), row["paths"])
        for row in grouped.collect()
    ]
    return sorted(((header, paths) for header, paths in found if header), key=lambda item: item[1][0])


def _opens(path: str) -> bool:
    try:
        store, place = opened(path)
        return store.get_file_info(place).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, OSError):
        return False


def _read_rows(spark: SparkSession, paths: str | list[str], width: int, multi_line: bool = False) -> DataFrame:
    schema = ", ".join(f"c{i} STRING" for i in range(width))
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(paths)
    )


def _cells(header: Sequence[str]) -> dict[str, Column]:
    """Header name -> cell; of equal names the last, as a row read into a dict has it."""
    return {name: F.col(f"c{at}") for at, name in enumerate(header)}


def _read_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], dict[str, Column]]:
    header = read_header(spark, path)
    if not header:
        raise ValueError(f"{path} has no CSV header")
    return with_position(_read_rows(spark, path, len(header))), header, _cells(header)


def read_event_traces(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, tokens`` of a trace CSV; rows without id or tokens are dropped, the later row of
    a block wins."""
    rows, header, cells = _read_table(spark, path)
    block = require_column(header, BLOCK_COLUMNS, path)
    sequence = require_column(header, SEQUENCE_COLUMNS, path)
    traces = rows.select(
        normalize_block_id(cells[block]).alias("block_id"),
        tokenize_sequence(cells[sequence]).alias("tokens"),
        *POSITION,
    ).where((F.col("block_id") != "") & (F.size("tokens") > 0))
    return last_wins(traces, ["block_id"], POSITION).drop(*POSITION)


def read_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, label`` of a label CSV; rows without id or readable label are dropped, the later
    row of a block wins."""
    rows, header, cells = _read_table(spark, path)
    block = require_column(header, BLOCK_COLUMNS, path)
    label = require_column(header, BLOCK_LABEL_COLUMNS, path)
    labels = rows.select(
        normalize_block_id(cells[block]).alias("block_id"),
        parse_binary_label(cells[label]).alias("label"),
        *POSITION,
    ).where((F.col("block_id") != "") & F.col("label").isNotNull())
    return last_wins(labels, ["block_id"], POSITION).drop(*POSITION)


@dataclass(frozen=True)
class FlowTable:
    """Parsed flow rows (place columns, ``raw_label``, ``features``) and the feature names."""

    rows: DataFrame
    feature_names: list[str]


def read_flow_csvs(
    spark: SparkSession,
    directory: str,
    max_files: int | None = None,
    target_count: int = 80,
    add_totals: bool = True,
    multi_line: bool = False,
) -> FlowTable:
    """All flow CSVs of a folder, one scan per distinct header.

    The first header sets the features; the other files are read by name, and a column they lack
    counts as 0. Files without a header are skipped. With ``multi_line`` a quoted cell may hold line
    breaks; such files cannot be split, so each is read by one task.
    """
    if max_files is not None and max_files <= 0:
        raise ValueError("max_files must be positive")
    by_header = distinct_headers(spark, directory, max_files)
    if not by_header:
        if not list_files(spark, directory):
            raise FileNotFoundError(f"no CSV files in {directory}")
        raise ValueError(f"no CSV header in {directory}")
    first = by_header[0][0]
    label = require_column(first, FLOW_LABEL_COLUMNS, directory)
    sources = select_feature_columns(first, label)
    if not sources:
        raise ValueError(f"no feature columns in {directory}")
    parts = []
    for header, files in by_header:
        cells = _cells(header)
        raw_label = cells[require_column(header, FLOW_LABEL_COLUMNS, files[0])]
        values = [cells.get(name, F.lit("0")) for name in sources]
        totals = total_cells(cells) if add_totals else ()
        scanned = with_position(_read_rows(spark, files, len(header), multi_line))
        featured = with_flow_features(scanned, values, totals, target_count)
        parts.append(featured.select(*POSITION, F.coalesce(raw_label, F.lit("")).alias("raw_label"), "features"))
    rows = reduce(DataFrame.unionByName, parts)
    return FlowTable(rows, feature_names(sources, target_count, add_totals))
