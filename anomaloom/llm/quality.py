"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Training reads a bounded sample of the labelled rows; the weights are one vector of ``2 ** bits``
numbers, whatever the corpus holds. Scoring is a sparse dot product per text inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from anomaloom.llm.hashing import BASE_A, BASE_B, U64, Texts, gram_hashes, mix, texts_of
from anomaloom.llm.rows import whole_groups

@dataclass(frozen=True)
class Settings:
    """Parameters of the classifier.

    ``sample_rows`` bounds the labelled rows that training reads (about so many, taken by a hash of
    their id); everything else covers all rows. The sample is dealt to ``shards`` tasks by another
    hash; each follows the regularised leader over its share, ``epochs`` times and until it has made
    ``least_updates``, and the weights are averaged.
    """

    bits: int = 18
    sample_rows: int = 16_000
    shards: int = 6
    epochs: int = 3
    least_updates: int = 6_000
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5


# Shares of a text's words that have such a trait, as features beside the n-grams.
_TRAITS = 8


def text_features(texts: Texts, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of every text's features.

    Features are the hashed words and word pairs as log frequencies, scaled to unit length; the shape
    of words (case, marks, digits, repeats) as hashed shares of all words; and a constant.
    """
    starts, ends, text = texts.words()
    hashes = texts.word_hashes(starts, ends, lower=True)
    pairs = gram_hashes(hashes, 2, BASE_A)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
    traits = _word_traits(texts, starts, ends, hashes, text)
    size = 1 << bits
    shift = U64(64 - bits)
    ones = (mix(hashes ^ U64(BASE_B)) >> shift).astype(np.int64)
    twos = (mix(pairs) >> shift).astype(np.int64)
    for i in range(len(texts)):
        low, high = bounds[i], bounds[i + 1]
        grams, counts = np.unique(np.concatenate([ones[low:high], twos[low : max(high - 1, low)]]), return_counts=True)
        values = np.log1p(counts)
        norm = np.sqrt((values * values).sum()) or 1.0
        shares = traits[low:high].mean(axis=0) if high > low else np.zeros(_TRAITS)
        yield (
            np.concatenate([grams, np.arange(size, size + 2 * _TRAITS + 2)]),
            np.concatenate([values / norm, shares, shares > 0.2, [1.0, float(high == low)]]),
        )


def _word_traits(texts: Texts, starts, ends, hashes, text) -> np.ndarray:
    data = texts.data

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    digit = (data >= 48) & (data <= 57)
    mark = (data < 128) & ~upper & ~lower & ~digit & (data > 32)
    ordinary = np.isin(data, np.frombuffer(b".,;:'-", dtype=np.uint8))
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    odd = share(mark & ~ordinary)
    size = ends - starts
    return np.stack(
        [share(upper) > 0.6, odd > 0, odd > 0.3, share(digit) > 0.5, share(mark) > 0.5, same, size > 20, size == 1],
        axis=1,
    ).astype(np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights learnt from labelled documents.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, quality`` (0 or 1). Rows with a null id or label
    are not learnt from; an id with both labels is learnt as either. Without labelled rows all
    weights are zero and every text scores 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    count = known.count()
    keep = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(
        min(1.0, settings.sample_rows / max(count, 1)) * (1 << 30)
    )
    # At most about ``sample_rows`` pairs of numbers: bounded, so broadcast.
    sample = F.broadcast(known.where(keep).withColumnRenamed("doc_id", "labelled_id"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    rows = docs.select("doc_id", text).join(sample, F.col("doc_id") == F.col("labelled_id"))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(settings.shards))
    models = (
        rows.select("doc_id", F.col("quality").cast("int").alias("label"), "body", shard.alias("shard"))
        .repartition(settings.shards, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_train(settings), "shard long, n long, weights binary")
        .collect()
    )
    size = (1 << settings.bits) + 2 * _TRAITS + 2
    total = sum(model["n"] for model in models)
    weights = np.zeros(size)
    for model in sorted(models, key=lambda m: m["shard"]):
        weights += np.frombuffer(model["weights"], np.float64) * (model["n"] / total)
    return weights


def _train(settings: Settings):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, "shard", 1):
            for shard in table["shard"].unique().to_pylist():
                part = table.filter(pc.equal(table["shard"], shard))
                rows = []
                for batch in part.to_batches():
                    for texts in texts_of(batch["body"]):
                        rows += list(text_features(texts, settings.bits))
                weights = train_ftrl(
                    rows, part["label"].to_numpy().astype(float), part["doc_id"].to_numpy(), settings
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([len(rows)]), pa.array([weights.tobytes()])],
                    names=["shard", "n", "weights"],
                )

    return run


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, settings: Settings
) -> np.ndarray:
    """Follow the regularised leader over some rows, in an order fixed by a hash of the ids."""
    size = (1 << settings.bits) + 2 * _TRAITS + 2
    z, n = np.zeros(size), np.zeros(size)
    for epoch in range(max(settings.epochs, -(-settings.least_updates // max(len(rows), 1)))):
        for row in np.lexsort((labels, mix(ids.view(np.uint64) + U64(epoch * 1_000_003 + 1)))):
            f, x = rows[row]
            zf, nf = z[f], n[f]
            w = _leader(zf, nf, settings)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[row]) * x
            grown = nf + g * g
            z[f] = zf + g - (np.sqrt(grown) - np.sqrt(nf)) / settings.alpha * w
            n[f] = grown
    return _leader(z, n, settings)


def _leader(z: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    rate = (settings.beta + np.sqrt(n)) / settings.alpha + settings.l2
    return -(z - np.sign(z) * np.minimum(np.abs(z), settings.l1)) / rate


def score_quality(
    texts: DataFrame, weights: np.ndarray, bits: int, body_col: str = "body", score_col: str = "score"
) -> DataFrame:
    """Replace the binary column ``body_col`` of the texts by their ``score_col`` (0 to 1).

    The weights (2 ** bits numbers) go out once per executor. Empty texts get a score too. Rows and other
    columns stay as they are.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kept = [name for name in texts.columns if name != body_col]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in stream:
            scores = [
                1.0 / (1.0 + np.exp(-np.clip(float(w[f] @ x), -35, 35)))
                for part in texts_of(batch[body_col])
                for f, x in text_features(part, bits)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in kept), pa.array(scores, pa.float64())], names=[*kept, score_col]
            )

    schema = texts.select(*kept).withColumn(score_col, F.lit(0.0)).schema
    return texts.mapInArrow(run, schema)
