"""How unexpected the events of a sequence are, by interpolated n-gram probabilities.

Counts of events after one and two events before them are tables; an event's probability mixes the
estimates of the contexts that the training rows have seen. No order of events is kept in a task beyond a
row's own array, and all look-ups are joins on the distinct grams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.session import stage

#: Weights of the estimates after two events, after one, without context, and of the even share.
WEIGHTS = (0.6, 0.25, 0.1, 0.05)


@dataclass(frozen=True)
class NextEvents:
    """Distinct grams of the training rows with their counts: ``a, b, event, n``; a and b are the events two
    and one before, null before the start."""

    grams: DataFrame


def event_grams(sequences: DataFrame, tokens: str = "tokens", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, a, b, event, n``: how often an event follows two others, per key.

    Null arrays and null events are left out; the events around a null one become neighbours.
    """
    events = F.filter(tokens, lambda t: t.isNotNull())
    before = lambda back: F.when(F.col("__at") >= back, F.get("__events", F.col("__at") - back))
    placed = sequences.select(*keys, events.alias("__events")).select(
        *keys, "__events", F.posexplode("__events").alias("__at", "event")
    )
    grams = placed.select(*keys, before(2).alias("a"), before(1).alias("b"), "event")
    return grams.groupBy(*keys, "a", "b", "event").agg(F.count(F.lit(1)).alias("n"))


def fit_next_events(sequences: DataFrame, tokens: str = "tokens") -> NextEvents:
    """Gram counts of the training sequences, staged."""
    return NextEvents(stage(event_grams(sequences, tokens), "grams"))


def event_probabilities(
    model: NextEvents, grams: DataFrame, weights: Sequence[float] = WEIGHTS
) -> DataFrame:
    """``a, b, event, p`` of distinct grams.

    ``p`` mixes n(a b event) / n(a b), n(b event) / n(b), n(event) / n and 1 / (distinct events + 1), by
    ``weights``; a context that the training rows lack passes its weight on to the shorter one, so the
    probabilities of all known events and one unknown event add up to 1. Without training rows every
    event has probability 1.
    """
    if len(weights) != 4 or min(weights) < 0 or abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("weights are four shares that add up to 1")
    counts = model.grams

    def total(keys: Sequence[str], name: str) -> DataFrame:
        return counts.groupBy(*keys).agg(F.sum("n").alias(name))

    found = grams
    tables = (
        (counts.select("a", "b", "event", F.col("n").alias("abe")), ("a", "b", "event")),
        (total(["a", "b"], "ab"), ("a", "b")),
        (total(["b", "event"], "be"), ("b", "event")),
        (total(["b"], "b_all"), ("b",)),
        (total(["event"], "e"), ("event",)),
    )
    for other, keys in tables:
        # A null is the start here, and equal to itself.
        renamed = other.withColumnsRenamed({key: f"__{key}" for key in keys})
        same = [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys]
        found = found.join(renamed, same, "left").drop(*(f"__{key}" for key in keys))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("event").alias("kinds")).first()
    if not size.n:
        return found.select("a", "b", "event", F.lit(1.0).alias("p"))
    found = found.withColumn("__n", F.lit(size.n))
    even = F.lit(1.0 / (size.kinds + 1))
    first, second, third, last = (F.lit(float(w)) for w in weights)

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part), F.lit(0)) / F.col(whole)

    base = share("e", "__n")
    short = F.when(F.col("b_all") > 0, share("be", "b_all"))
    long = F.when(F.col("ab") > 0, share("abe", "ab"))
    short_part = F.coalesce(first * long + second * short, (first + second) * short)
    p = (
        F.when(short.isNull(), (first + second + third) * base + last * even)
        .otherwise(short_part + third * base + last * even)
    )
    return found.select("a", "b", "event", p.alias("p"))


def sequence_surprise(
    sequences: DataFrame,
    model: NextEvents,
    keys: Sequence[str],
    tokens: str = "tokens",
    weights: Sequence[float] = WEIGHTS,
) -> DataFrame:
    """``keys, n_events, surprise, peak``: the mean and the largest of -ln p over a sequence's events.

    Rows that share their keys count as parts of one sequence group, each with its own start; keys without
    an event are left out. The grams of a key are combined before the look-up, and probabilities are
    computed once per distinct gram.
    """
    own = stage(event_grams(sequences, tokens, keys), "sequence-grams")
    distinct = own.select("a", "b", "event").distinct()
    rated = event_probabilities(model, distinct, weights).select(
        F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("event").alias("__event"), (-F.ln("p")).alias("__cost")
    )
    same = [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in ("a", "b", "event")]
    costs = own.join(rated, same)
    return costs.groupBy(*keys).agg(
        F.sum("n").alias("n_events"),
        (F.sum(F.col("n") * F.col("__cost")) / F.sum("n")).alias("surprise"),
        F.max("__cost").alias("peak"),
    )
