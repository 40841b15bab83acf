"""Mixing sources to target weights by soft membership, with DataFrame and SQL functions only.

A classifier learnt from the labelled table gives every document its posterior over domains. Document
rates (expected numbers of copies, 0 or more) start at 1 and follow gradient steps of a least squares
problem, projected on their bounds, until the expected tokens of every domain match the targets or no
step brings them nearer. The projection is a lazy one: steps add up before it, so it is never nested.
All documents take part in every step, which is one scan of a thin table and a few sums.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.session import stage

_log = logging.getLogger(__name__)

#: Domains of the labelled table, in the order of the posteriors; the first is the reference class.
DOMAINS = ("good", "low", "toxic")
#: Words that tell a domain from the first one, at most.
TELLING_WORDS = 1000
#: Ridge that keeps the weights of separable classes finite.
_RIDGE = 1.0
_FEATURES = 7
#: Lengths of a step that one scan tries, each a quarter of the one before.
_LENGTHS = 6
#: Part of a step at which the function counts as risen no more.
_LEAST_REACH = 1e-15
#: Part of the tolerance that the smoothing may take at first, for a move of 1.
_SMOOTH = 0.1
#: By how much the smoothing is lessened while that narrows the gap, and by how much it must.
_LESS_SMOOTH = 1e-2
_NARROWED = 0.95


@dataclass(frozen=True)
class Settings:
    """Parameters of the mixture.

    ``targets``: share of the tokens of the domains that are matched; shares are scaled to sum 1.
    ``total``: expected tokens of all matched domains; by default as many as leave the first of them
    at its present tokens. ``most``: largest rate. ``sample_rows`` bounds the labelled rows that the classifier is learnt
    from (about so many, by a hash of the id); all else covers all rows.
    """

    targets: Mapping[str, float] = field(default_factory=lambda: {"good": 0.94, "low": 0.04, "toxic": 0.02})
    total: float | None = None
    most: float | None = None
    sample_rows: int = 10_000
    class_steps: int = 12
    tolerance: float = 1e-6


@dataclass(frozen=True)
class Domains:
    """Classifier: telling words per further domain, and its weights (none without labelled rows)."""

    words: Sequence[Sequence[str]]
    weights: Sequence[Sequence[float] | None]


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of a labelled row's domain: toxic, else low or good quality; null if labels are missing."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), " ")


def learn_domains(docs: DataFrame, labels: DataFrame, settings: Settings) -> Domains:
    """Learn the classifier from a bounded sample of labelled documents.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, quality, toxic``. Rows with a null id or label are
    not learnt from. A domain without labelled rows gets no posterior; without any, all is the first's.
    """
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).dropna()
    count = known.count()
    share = int(min(1.0, settings.sample_rows / max(count, 1)) * (1 << 30))
    # About ``sample_rows`` pairs of numbers at most: bounded, so broadcast.
    sample = F.broadcast(
        known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share).withColumnRenamed("doc_id", "known_id")
    )
    rows = docs.select("doc_id", _words(F.col("text")).alias("words")).join(sample, F.col("doc_id") == F.col("known_id"))
    rows = stage(rows.select("domain", "words"), "labelled")
    sizes = dict(rows.groupBy("domain").count().collect())
    words = [_telling_words(rows, sizes, domain) for domain in range(1, len(DOMAINS))]
    numbers = stage(rows.select("domain", F.array(*_features(F.col("words"), words)).alias("x")), "features")
    weights = [
        _logistic(numbers, domain, settings.class_steps) if sizes.get(0) and sizes.get(domain) else None
        for domain in range(1, len(DOMAINS))
    ]
    return Domains(words, weights)


def _telling_words(rows: DataFrame, sizes: dict[int, int], domain: int) -> list[str]:
    """Words far more frequent, by documents, in a domain than in the first one."""
    spread = rows.where(F.col("domain").isin(0, domain)).select(
        "domain", F.explode(F.array_distinct("words")).alias("word")
    )
    counts = spread.groupBy("word").agg(
        F.count_if(F.col("domain") == domain).alias("here"), F.count_if(F.col("domain") == 0).alias("there")
    )
    lift = (F.col("here") + 0.5) / (sizes.get(domain, 0) + 1.0) / ((F.col("there") + 0.5) / (sizes.get(0, 0) + 1.0))
    best = (
        counts.where((F.col("here") >= 3) & (lift >= 4.0) & (F.length("word") > 0))
        .orderBy(F.desc(F.log(lift) * F.col("here")), "word")
        .limit(TELLING_WORDS)
    )
    return [row["word"] for row in best.collect()]


def _features(words: Column, telling: Sequence[Sequence[str]]) -> list[Column]:
    """Numbers of about unit size that describe a text's words."""
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    distinct = F.greatest(F.size(F.array_distinct(words)), F.lit(1)).cast("double")
    out = [F.lit(1.0), F.log1p(count) / 10.0, distinct / count]
    for known in telling:
        hits = (
            F.size(F.array_intersect(words, F.array(*(F.lit(word) for word in known)))).cast("double")
            if known
            else F.lit(0.0)
        )
        out += [F.log1p(hits), hits / distinct]
    return out


def _dot(x: Sequence[Column], w: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for column, weight in zip(x, w):
        total = total + column * F.lit(float(weight))
    return total


def _logistic(numbers: DataFrame, domain: int, steps: int) -> list[float]:
    """Ridge logistic regression of a domain against the first one, by Newton steps."""
    rows = numbers.where(F.col("domain").isin(0, domain))
    x = [F.col("x")[i] for i in range(_FEATURES)]
    y = (F.col("domain") == domain).cast("double")
    w = np.zeros(_FEATURES)
    places = [(i, j) for i in range(_FEATURES) for j in range(i + 1)]
    for _ in range(steps):
        p = 1.0 / (1.0 + F.exp(-_dot(x, w)))
        slopes = [F.sum((p - y) * x[i]) for i in range(_FEATURES)]
        bends = [F.sum(p * (1.0 - p) * x[i] * x[j]) for i, j in places]
        sums = [float(v) for v in rows.agg(*(s.alias(f"s{i}") for i, s in enumerate([*slopes, *bends]))).first()]
        bend = np.eye(_FEATURES) * _RIDGE
        for (i, j), value in zip(places, sums[_FEATURES:]):
            bend[i, j] += value
            if i != j:
                bend[j, i] += value
        move = np.linalg.solve(bend, np.array(sums[:_FEATURES]) + _RIDGE * w)
        w = w - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    return w.tolist()


def posteriors(words: Column, domains: Domains) -> list[Column]:
    """Posterior of every domain for the words of a text."""
    x = _features(words, domains.words)
    odds = [F.lit(1.0)]
    for weights in domains.weights:
        odds.append(F.lit(0.0) if weights is None else F.exp(F.greatest(F.least(_dot(x, weights), F.lit(30.0)), F.lit(-30.0))))
    total = sum(odds[1:], odds[0])
    return [odd / total for odd in odds]


def mix_sources(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document with its domain posteriors and its rate in the mixture.

    Returns ``row_id`` (the id), ``row_hash`` (of the text), ``n_tokens`` (words between blanks of the
    whole text), ``p_<domain>`` for each domain and ``rate``. A target that no document can serve (no
    expected tokens) is left out. Null and empty texts have no tokens and follow the same rates. Null
    and repeated ids, equal rows and other columns change nothing; an empty table gives an empty result.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    domains = learn_domains(named, labels, settings)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = named.select(
        F.col("doc_id").alias("row_id"),
        F.xxhash64(text, F.length(text)).alias("row_hash"),
        F.when(F.length(text) > 0, F.size(_words(text))).otherwise(0).cast("long").alias("n_tokens"),
        F.array(*posteriors(_words(text), domains)).alias("p"),
    )
    thin = stage(words, "posteriors")
    return thin.select(
        "row_id",
        "row_hash",
        "n_tokens",
        *(F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)),
        _rates(thin, settings).alias("rate"),
    )


def _rates(thin: DataFrame, settings: Settings) -> Column:
    """Rates of least squares: expected tokens of the matched domains against their targets."""
    matched = [i for i, name in enumerate(DOMAINS) if settings.targets.get(name, 0.0) > 0]
    p = [F.col("p")[i] for i in matched]
    n = F.col("n_tokens").cast("double")
    now = _expected(thin, n, p)
    served = [k for k, tokens in enumerate(now) if tokens > 0]
    if not served:
        return F.lit(1.0)
    p, matched, now = [p[k] for k in served], [matched[k] for k in served], now[served]
    shares = np.array([settings.targets[DOMAINS[i]] for i in matched])
    shares = shares / shares.sum()
    total = settings.total if settings.total is not None else now[0] / shares[0]
    return _projected(thin, settings, n, p, shares * total)


def _projected(thin: DataFrame, settings: Settings, n: Column, p: Sequence[Column], goal: np.ndarray) -> Column:
    """Rates from 0 to ``most`` of least squares; of equally good ones those nearest to 1, by tokens.

    The steps of all rounds are summed up and projected once: the rate is 1 less the posteriors times
    ``moved``, cut to its bounds. What is left of the gap is the gradient of a concave function of
    ``moved``, smoothed so that it has a maximum where the targets cannot be met. A step goes along the
    gradient in the metric of the documents between the bounds, as far as the function rises most of
    some lengths tried in one scan, so no step can overshoot. Rounds go on to the optimality condition, or
    until the function rises no more. The smoothing weighs the squares of the moves of all rates: with an
    upper bound these are small, without one it is lessened as long as that narrows the gap. A gap that
    is left is logged.
    """
    size = len(p)
    scale = float(goal.sum())
    allowed = settings.tolerance * scale
    smooth = allowed * _SMOOTH
    moved = np.zeros(size)
    last = math.inf
    while True:
        moved, gap = _ascended(thin, settings.most, n, p, goal, smooth, moved, allowed * _SMOOTH)
        widest = float(np.abs(gap).max())
        if settings.most is not None or widest <= allowed or widest > _NARROWED * last:
            break
        last, smooth = widest, smooth * _LESS_SMOOTH
    if widest > allowed:
        _log.warning("rates of at most %s leave a gap of %s tokens to the targets %s", settings.most, gap, goal)
    return _rate_of(F.lit(1.0) - _dot(p, moved), settings.most)


def _rate_of(want: Column, most: float | None) -> Column:
    return F.greatest(F.lit(0.0), want if most is None else F.least(F.lit(float(most)), want))


def _ascended(
    thin: DataFrame, most: float | None, n: Column, p: Sequence[Column], goal: np.ndarray, smooth: float, moved: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """The move at the function's maximum from ``moved`` on, and the gap there."""
    reach = 1.0
    value, gap, free = _dual(thin, most, n, p, goal, smooth, [moved])[0]
    while reach > _LEAST_REACH:
        slope = gap - smooth * moved
        if np.abs(slope).max() <= least:
            break
        step = np.linalg.solve(free + np.eye(len(p)) * smooth, slope)
        lengths = [moved + step * reach * 4.0**-k for k in range(_LENGTHS)]
        tried = _dual(thin, most, n, p, goal, smooth, lengths)
        best = int(np.argmax([found[0] for found in tried]))
        if tried[best][0] > value:
            moved, reach = lengths[best], 1.0
            value, gap, free = tried[best]
        else:
            reach *= 4.0**-_LENGTHS
    return moved, gap


def _dual(
    thin: DataFrame, most: float | None, n: Column, p: Sequence[Column], goal: np.ndarray, smooth: float, tried: Sequence[np.ndarray]
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Value, gap of the expected tokens and shared tokens of the documents between the bounds, per try."""
    rows = thin.select(
        n.alias("n"),
        *(column.alias(f"p{k}") for k, column in enumerate(p)),
        *((F.lit(1.0) - _dot(p, moved)).alias(f"u{t}") for t, moved in enumerate(tried)),
    )
    size = len(p)
    sums = []
    for t in range(len(tried)):
        want = F.col(f"u{t}")
        rate = _rate_of(want, most)
        # The bounds count as between them: at the start all documents may lie at the upper one.
        inside = want >= 0 if most is None else (want >= 0) & (want <= most)
        free = F.col("n") * F.when(inside, 1.0).otherwise(0.0)
        # Half the square of the move, and the priced tokens.
        sums.append(F.sum(F.col("n") * (0.5 * (rate - 1.0) * (rate - 1.0) + (1.0 - want) * rate)))
        sums += [F.sum(F.col("n") * rate * F.col(f"p{k}")) for k in range(size)]
        sums += [F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(size) for j in range(size)]
    row = rows.agg(*(column.alias(f"s{i}") for i, column in enumerate(sums))).first()
    found = np.array([float(value or 0.0) for value in row]).reshape(len(tried), -1)
    return [
        (
            float(line[0] - moved @ goal - 0.5 * smooth * moved @ moved),
            line[1 : size + 1] - goal,
            line[size + 1 :].reshape(size, size),
        )
        for line, moved in zip(found, tried)
    ]


def _expected(thin: DataFrame, n: Column, p: Sequence[Column]) -> np.ndarray:
    """Expected tokens of the domains at a rate of 1."""
    row = thin.agg(*(F.sum(n * column).alias(f"t{k}") for k, column in enumerate(p))).first() if p else ()
    return np.array([float(value or 0.0) for value in row])


def apply_rates(
    docs: DataFrame,
    rates: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repeat: bool = True,
    snap: float = 0.02,
) -> DataFrame:
    """``docs`` with every row as often as its rate says, the broken part decided by a hash of the row.

    Without ``repeat`` rates above 1 count as 1. A rate within ``snap`` of 1 counts as 1 too, so that
    ordinary documents neither vanish nor double by chance; with ``snap=0`` the expected tokens are those
    that were solved for. Null texts count as empty, null and repeated ids and equal rows (by id and text)
    share a rate, an empty table stays empty, and texts of any length go through unread but for a hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__mix_hash": F.xxhash64(text, F.length(text)), "__mix_id": F.col(id_col).cast("long")})
    one = (
        rates.groupBy("row_id", "row_hash")
        .agg(F.first("rate").alias("__mix_rate"))
        .withColumnsRenamed({"row_id": "__mix_row_id", "row_hash": "__mix_row_hash"})
    )
    same = (F.col("__mix_hash") == F.col("__mix_row_hash")) & F.col("__mix_id").eqNullSafe(F.col("__mix_row_id"))
    chance = F.pmod(F.xxhash64("__mix_hash", "__mix_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.col("__mix_rate") if repeat else F.least(F.col("__mix_rate"), F.lit(1.0))
    rate = F.when(F.abs(rate - 1.0) <= snap, 1.0).otherwise(rate)
    counted = keyed.join(one, same).withColumn("__mix_copies", F.floor(rate + chance).cast("int"))
    kept = counted.where(F.col("__mix_copies") > 0)
    if repeat:
        kept = kept.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return kept.select(*docs.columns)
