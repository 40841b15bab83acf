"""Events of log lines, their sequences and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from anomaloom.functions import rules
from anomaloom.functions.text import (
    extract_event_ids,
    infer_event_from_ascii,
    infer_event_from_template,
    is_ascii,
)
from anomaloom.operators.computed import computed
from anomaloom.operators.ranking import row_number_in_order

# Tokens per row of an assembled sequence.
CHUNK = 4096


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key. Combined map-side, so a key with many copies ships one per task."""
    rest = [name for name in df.columns if name not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*key).agg(newest).select(*key, *(F.col(f"__row.{name}").alias(name) for name in rest)).select(
        *df.columns
    )


def line_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Each line's columns but the text, its ``events`` (the explicit ids, else the one its wording
    tells), and ``id_count``, how many of them are explicit."""
    others = [name for name in lines.columns if name != line]
    text = lines.select(*others, F.coalesce(F.col(line), F.lit("")).alias("__text"))
    read = computed(text, __ids=extract_event_ids(F.col("__text")), __low=F.lower("__text"))
    inferred = F.when(is_ascii(F.col("__text")), infer_event_from_ascii(F.col("__low"))).otherwise(
        infer_event_from_template(F.col("__text"))
    )
    events = F.when(F.size("__ids") > 0, F.col("__ids")).otherwise(F.array_compact(F.array(inferred)))
    return computed(read, events=events).select(*others, "events", F.size("__ids").alias("id_count"))


def extract_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row per event: the line's columns but the text, ``event_pos`` in the line, ``event``."""
    return explode_events(line_events(lines, line))


def explode_events(found: DataFrame) -> DataFrame:
    """The events of :func:`line_events` one by one."""
    others = [name for name in found.columns if name not in ("events", "id_count")]
    return found.select(*others, F.posexplode("events").alias("event_pos", "event"))


def extraction_stats(lines: DataFrame, key: Sequence[str] = (), line: str = "line") -> DataFrame:
    """Per key (over everything without one): ids found, events inferred, lines without either."""
    return count_extraction(line_events(lines.select(*key, line), line), key)


def count_extraction(found: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The counters of :func:`extraction_stats` from the output of :func:`line_events`."""
    return found.groupBy(*key).agg(
        F.coalesce(F.sum("id_count"), F.lit(0)).cast("bigint").alias("from_event_id"),
        F.count_if((F.col("id_count") == 0) & (F.size("events") > 0)).alias("from_template"),
        F.count_if(F.size("events") == 0).alias("unmatched_lines"),
    )


def assemble_sequences(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    event: str = "event",
    chunk: int = CHUNK,
    **sizes: int,
) -> DataFrame:
    """The events of each key in order: ``key, chunk_no, tokens``.

    A sequence up to ``chunk`` events is one row; a longer one continues in further rows, so no row
    grows with the size of its key. ``sizes`` are passed to the ranking.
    """
    numbered = row_number_in_order(events, key, order, "__pos", **sizes)
    numbered = numbered.withColumn("chunk_no", F.floor((F.col("__pos") - 1) / chunk).cast("int"))
    pieces = numbered.groupBy(*key, "chunk_no").agg(
        F.sort_array(F.collect_list(F.struct("__pos", F.col(event).alias("token")))).alias("__items")
    )
    return pieces.select(*key, "chunk_no", F.col("__items.token").alias("tokens"))


def sequence_tails(
    events: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, event: str = "event", salt: int = 64
) -> DataFrame:
    """The last ``n`` events of each key as one array, and ``event_count``."""
    tails = end_items(events, key, order, n, F.desc, event, salt)
    totals = events.groupBy(*key).agg(F.count(F.lit(1)).alias("event_count"))
    return tails.join(totals, list(key)).select(*key, F.col("items").alias("tail"), "event_count")


def end_items(
    events: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    n: int,
    direction: Callable[[str], Column] = F.asc,
    event: str = "event",
    salt: int = 64,
) -> DataFrame:
    """``key, items``: the first (``F.asc``) or last (``F.desc``) ``n`` events of each key, in order.

    Two steps: the ``n`` of each of ``salt`` random shares of a key, then of what is left, so a hot key
    is spread over ``salt`` tasks.
    """
    shares = events.withColumn("__place", F.struct(*order)).withColumn(
        "__share", F.pmod(F.xxhash64("__place"), F.lit(salt)).cast("int")
    )
    within = Window.partitionBy(*key, "__share").orderBy(direction("__place"))
    kept = shares.withColumn("__at", F.row_number().over(within)).where(F.col("__at") <= n)
    again = Window.partitionBy(*key).orderBy(direction("__place"))
    kept = kept.withColumn("__at", F.row_number().over(again)).where(F.col("__at") <= n)
    ends = kept.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("__place", F.col(event).alias("token")))).alias("__items")
    )
    return ends.select(*key, F.col("__items.token").alias("items"))


def line_statistics(found: DataFrame, key: Sequence[str], known: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All counters of a key in one aggregate over the output of :func:`line_events`: rule counts, event
    counts, extraction counters and ``n_lines``.

    ``known`` adds a boolean column ``known`` to rows that have ``event``.
    """
    exploded = found.select(*key, "id_count", F.posexplode_outer("events").alias("pos", "event"))
    opens = F.coalesce(F.col("pos") == 0, F.lit(True))  # one row per line
    ids = F.when(opens, F.col("id_count")).otherwise(0)
    there = F.col("event").isNotNull()
    return event_counts(
        known(exploded),
        key,
        "event",
        F.count_if(opens).alias("n_lines"),
        F.count("event").alias("event_token_count"),
        F.count_if(there & F.col("known")).alias("known_event_count"),
        F.count_if(there & ~F.col("known")).alias("unknown_event_count"),
        F.coalesce(F.sum(ids), F.lit(0)).cast("bigint").alias("from_event_id"),
        F.count_if(opens & (F.col("id_count") == 0) & there).alias("from_template"),
        F.count_if(~there).alias("unmatched_lines"),
    )


def event_counts(events: DataFrame, key: Sequence[str], event: str = "event", *extra: Column) -> DataFrame:
    """Counts of the rule events per key; ``extra`` aggregates ride on the same shuffle."""
    return events.groupBy(*key).agg(*rules.counts_in_group(F.upper(F.col(event))), *extra)


def with_event_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """Counts of the rule events in an array column of each row."""
    return df.select("*", *rules.counts_in_array(tokens))
