"""Row keys, text columns and Arrow batches shared by the corpus operators.

A row is keyed by its id and a hash of its text: the key is the same whenever a lost task runs
again, null and repeated ids are allowed, and rows that share a key share their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

KEY = ("row_id", "row_hash")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row_id, row_hash, body``: the text as UTF-8 bytes, a null text as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.xxhash64(text, F.length(text)).alias("row_hash"),
        text.cast("binary").alias("body"),
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of the row keys; the hash leads, so null ids do not meet in one task."""
    return (left["row_hash"] == right["row_hash"]) & left["row_id"].eqNullSafe(right["row_id"])


def whole_groups(
    stream: Iterator[pa.RecordBatch], key: str, least_rows: int
) -> Iterator[pa.Table]:
    """Tables of whole groups, of ``least_rows`` rows or more but for the last one.

    The stream is sorted by ``key`` within the task; a group that crosses batches is kept together.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in stream:
        if not batch.num_rows:
            continue
        keys = batch[key]
        if held and rows >= least_rows and held[-1][key][-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        if keys[0] != keys[-1] and rows + batch.num_rows >= least_rows:
            last = pc.index(keys, keys[-1]).as_py()
            if rows + last >= least_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held, rows, batch = [], 0, batch.slice(last)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def with_splits(asked: DataFrame, seed_runs: int) -> DataFrame:
    """``asked`` with ``splits``: over how many tasks the rows of its ``seed`` go, at ``seed_runs`` a task.

    Only seeds of more rows than that are sent to every task, at most one for ``seed_runs`` rows; the rows
    stay where they are, so those of a frequent seed do not meet in one task.
    """
    splits = F.ceil(F.count(F.lit(1)) / seed_runs).cast("int").alias("splits")
    frequent = asked.groupBy("seed").agg(splits).where(F.col("splits") > 1)
    return asked.join(F.broadcast(frequent), "seed", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))


def first_of_groups(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per class: that of the smallest id, by the hash of the text where ids are equal.

    ``classes`` has ``row_id, row_hash, class_id`` for every row; rows with a null class all stay. Of
    rows equal in id and text one stays per class.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = docs.columns
    keyed = docs.withColumns(
        {"__row_id": F.col(id_col).cast("long"), "__row_hash": F.xxhash64(text, F.length(text))}
    )
    ranked = F.struct(F.col("row_id").isNull().alias("unnamed"), "row_id", "row_hash")
    chosen = (
        classes.where(F.col("class_id").isNotNull())
        .groupBy("class_id")
        .agg(F.min(ranked).alias("first"))
        .select(F.col("first.row_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))
    )
    alone = classes.where(F.col("class_id").isNull()).select(
        F.col("row_id").alias("first_id"), F.col("row_hash").alias("first_hash")
    ).distinct()

    def same(side: DataFrame) -> Column:
        return (F.col("__row_hash") == side["first_hash"]) & F.col("__row_id").eqNullSafe(side["first_id"])

    kept = keyed.join(chosen, same(chosen), "left_semi")
    # Equal rows of a class fall together; grouping by the key needs no order.
    single = kept.groupBy("__row_id", "__row_hash").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return single.unionByName(keyed.join(alone, same(alone), "left_semi").select(*names))
