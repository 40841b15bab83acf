"""Approximate nearest neighbours by multi-index hashing.

Rotations learnt on a sample turn vectors into binary codes. A code is split into substrings; two codes
within a Hamming radius r agree, by the pigeonhole principle, on some substring but for r // m bits, so
probing every substring's index with the values that near finds every code within r. Candidates
are ranked by their exact distance. Queries go out in blocks of bounded size; each task
keeps its best candidates of every query, and the best of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from anomaloom.llm.vectors import directions, matrix, sampled, usable, vector_sizes
from anomaloom.session import stage

#: Queries that are sent out together; more take further passes over the vectors.
QUERY_BLOCK = 20_000
#: Bits of a substring, and the least number of bits of a code.
SUBSTRING_BITS = 16
CODE_BITS = 256
_ROUNDS = 15
#: Share of the sample's true neighbours that the learnt radius takes in.
_TAKEN_IN = 0.98
_SAMPLE_QUERIES = 400
_FOUND = "query_id long, row_id long, score double"


@dataclass(frozen=True)
class Codes:
    """Learnt centre and directions (``bits`` columns), and the Hamming radius of candidates."""

    centre: np.ndarray
    planes: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        bits = (vectors - self.centre) @ self.planes > 0
        return np.packbits(bits, axis=1).view(np.uint64)


def learn_codes(sample: np.ndarray, neighbours: int, bits: int = CODE_BITS) -> Codes:
    """Iterative quantisation: rotations of the principal directions that bring vectors near to corners."""
    size = sample.shape[1]
    if not len(sample) or not size:
        return Codes(np.zeros(size), np.zeros((size, bits)), bits)
    centre = sample.mean(axis=0)
    shifted = sample - centre
    basis = directions(sample, size)
    front = shifted @ basis
    rng = np.random.default_rng(0)
    planes = []
    for _ in range(-(-bits // size)):
        turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        for _ in range(_ROUNDS):
            corners = np.sign(front @ turn)
            left, _, right = np.linalg.svd(front.T @ corners)
            turn = left @ right
        planes.append(basis @ turn)
    codes = Codes(centre, np.concatenate(planes, axis=1)[:, :bits], bits)
    return Codes(centre, codes.planes, _radius(sample, codes, neighbours, bits))


def _radius(sample: np.ndarray, codes: Codes, neighbours: int, bits: int) -> int:
    """Hamming radius that holds nearly all true neighbours of some sampled vectors.

    Neighbours in a sample lie further off than in the whole table, so the radius errs to the wide side.
    """
    asked = sample[: min(_SAMPLE_QUERIES, len(sample))]
    words, asked_words = codes.of(sample), codes.of(asked)
    found = []
    lengths = (sample * sample).sum(axis=1)
    for i, vector in enumerate(asked):
        far = lengths - 2.0 * (sample @ vector)
        far[i] = np.inf
        take = min(neighbours, len(sample) - 1)
        if take > 0:
            found.append(_hamming(asked_words[i : i + 1], words[np.argpartition(far, take - 1)[:take]])[0])
    return int(np.quantile(np.concatenate(found), _TAKEN_IN)) if found else bits


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)), dtype=np.int32)
    for word in range(a.shape[1]):
        total += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return total


class MultiIndex:
    """Substring indexes over the codes of some vectors."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @cached_property
    def order(self) -> np.ndarray:
        """For every substring the rows by its value."""
        return np.argsort(self.words.view(np.uint16), axis=0, kind="stable")

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.take_along_axis(self.words.view(np.uint16), self.order, axis=0)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within ``radius`` of ``code``."""
        flips = substring_flips(min(radius // self.words.view(np.uint16).shape[1], SUBSTRING_BITS))
        if len(flips) >= len(self.words):
            # More values to probe than codes: reading all codes finds the same ones sooner.
            rows = np.arange(len(self.words))
        else:
            found = []
            for part, value in enumerate(code.view(np.uint16)):
                probes = value ^ flips
                low = np.searchsorted(self.sorted[:, part], probes, side="left")
                high = np.searchsorted(self.sorted[:, part], probes, side="right")
                hit = np.flatnonzero(high > low)
                found += [self.order[a:b, part] for a, b in zip(low[hit], high[hit])]
            rows = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return rows[_hamming(code[None, :], self.words[rows])[0] <= radius]


_FLIPS: dict[int, np.ndarray] = {}


def substring_flips(most: int) -> np.ndarray:
    """All masks of up to ``most`` bits of a substring."""
    if most not in _FLIPS:
        masks = [sum(1 << bit for bit in chosen) for n in range(most + 1) for chosen in combinations(range(SUBSTRING_BITS), n)]
        _FLIPS[most] = np.array(masks, dtype=np.uint16)
    return _FLIPS[most]


def nearest(
    rows: DataFrame,
    is_query: Column,
    neighbours: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = CODE_BITS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``neighbours`` nearest rows of every query row but itself, by Euclidean distance.

    Returns ``query_id, rank`` (from 1, ties to the smaller id), ``row_id, score`` (the distance of the
    original vectors, in double precision). All rows are indexed; codes and radius are learnt on a bounded
    sample. Where a task's radius holds fewer than ``neighbours`` codes it is widened to the
    nearest codes, so a query has as many neighbours as there are candidates.

    Rows with a null id take no part, nor do vectors that are null, empty or zero, or hold null or
    non-finite components. A query's candidates are the vectors with as many components; codes are learnt
    for each number of components. Rows that share an id are neighbours of others each, and never of the
    query with that id. An empty table gives an empty result.

    Queries pass the driver in blocks of ``query_block``; a block's findings are written down and its
    vectors given up before the next one, so the driver never holds more than one block.
    """
    fine = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    found = rows.sparkSession.createDataFrame([], _FOUND)
    for size in vector_sizes(fine, vector_col):
        same = fine.where(F.size(vector_col) == size)
        for part in _nearest_of_size(same, is_query, neighbours, id_col, vector_col, bits, query_block, size):
            found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("score", "row_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "row_id", "score")


def _nearest_of_size(
    fine: DataFrame, is_query: Column, neighbours: int, id_col: str, vector_col: str, bits: int, query_block: int, size: int
) -> Iterator[DataFrame]:
    """Staged findings of every block of queries among vectors of one size."""
    named = fine.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).alias("vector"))
    codes = learn_codes(sampled(named, "vector", size), neighbours, bits)
    queries = fine.where(is_query).select(
        F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    blocks = max(1, -(-queries.count() // query_block))
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if asked.num_rows:
            yield _search(named, asked, size, codes, neighbours)


def _search(rows: DataFrame, asked: pa.Table, size: int, codes: Codes, neighbours: int) -> DataFrame:
    asked = asked.combine_chunks()
    ids = asked["query_id"].to_numpy()
    vectors = matrix(asked["vector"].chunk(0), size)
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors, codes))

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, codes = shared.value
        words = codes.of(vectors)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        for batch in stream:
            if not batch.num_rows:
                continue
            there = matrix(batch["vector"], size)
            own = batch["row_id"].to_numpy()
            index = MultiIndex(codes.of(there))
            for i in range(len(ids)):
                near = index.within(words[i], codes.radius)
                near = near[own[near] != ids[i]]
                if len(near) < neighbours:
                    near = _nearest_codes(index, words[i], own != ids[i], neighbours)
                offset = there[near] - vectors[i]
                score = np.concatenate([best[i][0], np.sqrt((offset * offset).sum(axis=1))])
                label = np.concatenate([best[i][1], own[near]])
                keep = np.lexsort((label, score))[:neighbours]
                best[i] = (score[keep], label[keep])
        sizes = [len(score) for score, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids, sizes)),
                    pa.array(np.concatenate([label for _, label in best])),
                    pa.array(np.concatenate([score for score, _ in best])),
                ],
                names=["query_id", "row_id", "score"],
            )

    numbers = rows.select("row_id", F.col("vector").cast("array<double>").alias("vector"))
    found = stage(numbers.mapInArrow(search, _FOUND), "nearest")
    shared.destroy()
    return found


def _nearest_codes(index: MultiIndex, code: np.ndarray, allowed: np.ndarray, count: int) -> np.ndarray:
    """The rows of the nearest codes, all that tie with the last one included."""
    rows = np.flatnonzero(allowed)
    far = _hamming(code[None, :], index.words[rows])[0]
    if len(rows) <= count:
        return rows
    return rows[far <= np.partition(far, count - 1)[count - 1]]
