"""Exact ranks and prefix sums that never sort a whole group in one task.

A plain window over a group puts the group into one task. Here each group is cut into buckets that
follow the sort order; the sizes of the buckets are summed up to offsets (a small table), and only
the rows of one bucket are sorted together: rank = offset of the bucket + rank inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

# Rows that one task may sort without a further cut.
BUCKET_ROWS = 2_000_000
MAX_BUCKETS = 20_000
# Sampled rows per bucket when cut points are sought.
SAMPLED_ROWS = 200
# Whole numbers up to here keep their identity as doubles.
_EXACT_DOUBLE = 2.0**53


def hash_order(seed: int, *cols: Column) -> Column:
    """Seeded pseudo-random sort key, equal on every run and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(col.cast("string") for col in cols)))


def hash_bucket(key: Column) -> Column:
    """65 536 even buckets in the order of :func:`hash_order` keys."""
    return F.substring(key, 1, 4)


def _partitioned(group: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*group) if group else Window.partitionBy(F.lit("all"))


def bucket_offsets(
    df: DataFrame, group: Sequence[str], bucket: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """For every (group, bucket): the totals of ``sums`` over the earlier buckets of the group."""
    keys = [*group, *bucket]
    totals = df.groupBy(*keys).agg(*(total.alias(name) for name, total in sums.items()))
    earlier = _partitioned(group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in sums)
    )


def row_number_by_bucket(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[Column | str],
    output: str,
    at_most: int | None = None,
) -> DataFrame:
    """Exact 1-based row number in each group.

    ``bucket`` columns must follow ``order`` inside a group and, with the group columns, be
    non-null. ``at_most`` keeps the first rows of each group and drops the buckets beyond them
    before anything is sorted.
    """
    keys = [*group, *bucket]
    offsets = bucket_offsets(df, group, bucket, {"__before": F.count(F.lit(1))})
    rows = df
    if at_most is not None:
        offsets = offsets.where(F.col("__before") < at_most)
        rows = df.join(offsets.select(*keys), keys, "left_semi")
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = (
        rows.withColumn(output, F.row_number().over(inside))
        .join(offsets, keys, "inner")
        .withColumn(output, F.col(output) + F.col("__before"))
        .drop("__before")
        .select(*df.columns, output)
    )
    return ranked if at_most is None else ranked.where(F.col(output) <= at_most)


def ordered_buckets(
    df: DataFrame,
    order: Sequence[Column],
    prefix: str = "__b",
    rows_per_bucket: int = BUCKET_ROWS,
    max_buckets: int = MAX_BUCKETS,
) -> tuple[DataFrame, list[str]]:
    """Add bucket columns that follow the numeric sort columns ``order`` (ascending).

    Cut points are approximate quantiles (any cut is right, even ones are fast). A value so frequent
    that it fills a bucket alone gets one to itself, and its rows are cut again by the next sort
    column, so one value holding a third of the rows is still spread. Input up to
    ``rows_per_bucket`` rows needs no cut and gets no column.
    """
    added: list[str] = []
    tied: Column | None = None
    keyed = df
    for depth, col in enumerate(order):
        key, bucket = f"{prefix}key{depth}", f"{prefix}{depth}"
        keyed = keyed.withColumn(key, F.coalesce(col.cast("double"), F.lit(float("-inf"))))
        scope = keyed if tied is None else keyed.where(tied)
        cuts, frequent = _cut_points(scope, key, rows_per_bucket, max_buckets)
        if not cuts:
            keyed = keyed.drop(key)
            break
        cutter = Bucketizer(
            splits=[float("-inf"), *cuts, float("inf")], inputCol=key, outputCol=bucket, handleInvalid="keep"
        )
        keyed = cutter.transform(keyed).drop(key).withColumn(bucket, F.col(bucket).cast("int"))
        if tied is not None:
            keyed = keyed.withColumn(bucket, F.when(tied, F.col(bucket)).otherwise(F.lit(0)))
        added.append(bucket)
        # Bucket i is [cut i-1, cut i), so the value at position i of the cuts opens bucket i + 1.
        alone = [cuts.index(value) + 1 for value in frequent]
        if not alone:
            break
        here = F.col(bucket).isin(*alone)
        tied = here if tied is None else tied & here
    return keyed, added


def _cut_points(
    scope: DataFrame, key: str, rows_per_bucket: int, max_buckets: int
) -> tuple[list[float], list[float]]:
    """Inner cut points of ``key``, and the values that have a bucket to themselves.

    Quantiles of a sample of a few hundred rows per bucket: the summaries that all tasks send to one
    stay small, and cut points need not be exact.
    """
    n = scope.count()
    wanted = min(max_buckets, math.ceil(n / rows_per_bucket))
    if wanted < 2:
        return [], []
    fraction = SAMPLED_ROWS * wanted / n
    sample = scope if fraction > 0.5 else scope.sample(fraction, seed=0)
    steps = [i / wanted for i in range(1, wanted)]
    quantiles = sample.agg(F.percentile_approx(key, steps, max(1000, 4 * wanted))).first()[0] or []
    seen: dict[float, int] = {}
    for value in quantiles:
        if math.isfinite(value):
            seen[value] = seen.get(value, 0) + 1
    cuts = set(seen)
    frequent = []
    for value, times in seen.items():
        if times > 1 and abs(value) < _EXACT_DOUBLE:
            frequent.append(value)
            cuts.add(math.nextafter(value, math.inf))
    return sorted(cuts), sorted(frequent)


def row_number_in_order(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    output: str,
    at_most: int | None = None,
    **sizes: int,
) -> DataFrame:
    """Exact row number by number, time or text columns (nulls first), for groups of any size.

    Only groups of more than ``rows_per_bucket`` rows are cut; the others are sorted whole, so that
    many small groups do not become as many buckets as rows.
    """
    check_order(df, order)
    rows_per_bucket = sizes.get("rows_per_bucket", BUCKET_ROWS)
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    large = counts.where(F.col("__n") > rows_per_bucket)
    if large.isEmpty():
        return _numbered_whole(df, group, order, output, at_most)
    # A struct is never null itself, and equal to another one with nulls at the same places.
    keyed = df.withColumn("__group", F.struct(*group) if group else F.struct(F.lit("all").alias("all")))
    named = large.select((F.struct(*group) if group else F.struct(F.lit("all").alias("all"))).alias("__group"))
    cut, buckets = ordered_buckets(keyed.join(named, "__group", "left_semi"), sort_keys(df, order), **sizes)
    if not buckets:
        return _numbered_whole(df, group, order, output, at_most)
    ranked = row_number_by_bucket(cut, ["__group"], buckets, list(order), output, at_most)
    ranked = ranked.withColumn(output, F.col(output).cast("bigint")).select(*df.columns, output)
    if not group:
        return ranked
    rest = keyed.join(named, "__group", "left_anti").drop("__group")
    return ranked.unionByName(_numbered_whole(rest, group, order, output, at_most))


def _numbered_whole(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], output: str, at_most: int | None
) -> DataFrame:
    whole = _partitioned(group).orderBy(*order)
    ranked = df.withColumn(output, F.row_number().over(whole).cast("bigint"))
    return ranked if at_most is None else ranked.where(F.col(output) <= at_most)


def check_order(df: DataFrame, order: Sequence[Column]) -> None:
    """An error for sort columns that cannot be cut, at any table size."""
    for col in order:
        kind = df.select(col.alias("c")).schema["c"].dataType.typeName()
        if kind in ("array", "map", "struct", "variant"):
            raise ValueError(f"cannot rank by a column of type {kind}")


# Bytes of text that one sort number holds, and numbers of a text column at most.
_TEXT_BYTES, _TEXT_KEYS = 6, 8


def sort_keys(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """Numbers that follow the sort columns, for :func:`ordered_buckets`.

    Numbers, dates and timestamps are one number each. A text is its bytes, six per number, and then
    its length; if a text is longer than those numbers hold, no later column may cut, and the list
    ends there. Other types cannot be cut and raise an error at any table size.
    """
    check_order(df, order)
    keys: list[Column] = []
    for col in order:
        kind = df.select(col.alias("c")).schema["c"].dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz", "date"):
            keys.append(F.unix_micros(col.cast("timestamp")).cast("double"))
        elif kind in ("string", "varchar", "char", "binary"):
            raw = col.cast("binary")
            digits = F.rpad(F.hex(F.substring(raw, 1, _TEXT_BYTES * _TEXT_KEYS)), 2 * _TEXT_BYTES * _TEXT_KEYS, "0")
            for at in range(_TEXT_KEYS):
                part = F.substring(digits, 2 * _TEXT_BYTES * at + 1, 2 * _TEXT_BYTES)
                keys.append(F.conv(part, 16, 10).cast("double"))
            keys.append(F.octet_length(raw).cast("double"))
            longest = df.agg(F.max(F.octet_length(raw))).first()[0]
            if (longest or 0) > _TEXT_BYTES * _TEXT_KEYS:
                keys.pop()
                break
        else:
            keys.append(col.cast("double"))
    return keys


def average_ranks(df: DataFrame, value: str, output: str = "avg_rank", **sizes: int) -> DataFrame:
    """One row per distinct value: its row count ``n`` and 1-based rank, ties averaged."""
    distinct = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return _rank_distinct(distinct, value, "n", output, **sizes)


def _rank_distinct(distinct: DataFrame, value: str, n: str, output: str, **sizes: int) -> DataFrame:
    summed = prefix_sums(distinct, [F.col(value)], {n: "__upto"}, **sizes)
    return summed.withColumn(output, F.col("__upto") - F.col(n) + (F.col(n) + 1) / 2).drop("__upto")


def prefix_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], **sizes: int
) -> DataFrame:
    """Running sums over the whole table in sort order: ``{column: output}``, own row included."""
    cut, buckets = ordered_buckets(df, sort_keys(df, order), **sizes)
    inside = _partitioned(buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut
    for column, output in sums.items():
        summed = summed.withColumn(output, F.sum(column).over(inside))
    if not buckets:
        return summed
    offsets = bucket_offsets(cut, [], buckets, {f"__off_{c}": F.sum(c) for c in sums})
    summed = summed.join(offsets, buckets, "inner")
    for column, output in sums.items():
        summed = summed.withColumn(output, F.col(output) + F.col(f"__off_{column}"))
    return summed.select(*df.columns, *sums.values())
