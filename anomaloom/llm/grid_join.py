"""Embedding near-dedup by epsilon grid order join.

Unit vectors are sorted by the grid cells of their leading principal coordinates (cell width: the join
distance). The sorted sequence is cut into intervals, and a few that follow each other are stored as a
strip. Strips meet in a nested loop over the stored table, so no strip is shipped for another one's sake
and the disk holds each vector a fixed number of times; strips whose boxes are further apart than the join
distance are passed over. In a task blocks of two strips that are provably distant are skipped, more
coordinates rule out single pairs, and the rest is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from anomaloom.llm.components import connected_components
from anomaloom.llm.vectors import directions, matrix, sampled, usable, vector_sizes
from anomaloom.session import stage

#: Coordinates that make the grid; one more holds the length of what they leave.
GRID_COORDINATES = 8
#: Vectors of an interval, and of the blocks in which a task compares two strips.
INTERVAL = 2048
_LEAF = 256
#: Intervals of a strip, and bytes of its vectors, at most about.
_STRIP = 8
_STRIP_BYTES = 8 << 20
#: Bytes of the pairs of strips that go to Python at once, if a pair has not more.
_PAIR_BYTES = 8 << 20
#: Blocks of the second strip that are compared with a block of the first one at once.
_BLOCKS = 8
#: Tasks of the join for each core, at least about, and parts of the table that a part meets in a task at most.
_TASKS_PER_CORE = 8
_MET_PARTS = 32
#: Strips that a task keeps ready, and links it holds before it reduces them to one per vector.
_READY = 6
_HELD_LINKS = 1 << 20
#: Components of the vectors that the coarse comparison left and that are decided together, about.
_WAITING = 1 << 18
#: Slack of the box test and of the first, coarse comparison, far above rounding.
_SLACK = 1e-9
#: Share of pairs left by the coarse comparison from which a block is compared as a whole.
_DENSE = 1 / 16

_STRIPS = (
    "strip long, low array<double>, high array<double>, nodes binary, named binary, copies binary, "
    "key_a binary, key_b binary, vectors binary"
)
_CLASSES = "key_a long, key_b long, node long, named boolean, copies long"
_LINKS = "node long, named boolean, root long, n long"


def join_near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    similarity: float = 0.9,
    interval: int = INTERVAL,
) -> DataFrame:
    """One row per vector with its links and its component.

    Two vectors are linked when their cosine, in double precision, is ``similarity`` (above 0) or
    more. Returns ``row_id`` (the id), ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable by links, itself included) and ``kept`` (whether the id is that smallest).

    Vectors that are null, empty or zero, or hold null or non-finite components link with nothing; the
    others are compared with all that have as many components. Equal vectors are compared once. Rows that share an id
    are one node; rows without an id take part, their ``component_id`` is null if no linked row has
    an id, and they are not kept. An empty table gives an empty result.
    """
    named = rows.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).alias("vector"))
    # Equal vectors are known by 128 bits, so that none is shipped to be grouped or to find its links.
    fine = named.where(usable(F.col("vector"))).withColumns(
        {"key_a": F.xxhash64("vector"), "key_b": F.xxhash64(F.lit("second"), "vector")}
    )
    epsilon = math.sqrt(max(0.0, 2.0 - 2.0 * similarity))
    spark = rows.sparkSession
    classes, links = [], []
    for size in vector_sizes(fine, "vector"):
        same = fine.where(F.size("vector") == size)
        sample = _unit(sampled(same, "vector", size))
        lead = directions(sample, size)
        strips = stage(_strips(same, size, lead[:, :GRID_COORDINATES], epsilon, interval), "strips")
        classes.append(strips.select("nodes", "named", "copies", "key_a", "key_b").mapInArrow(_rows, _CLASSES))
        links.append(_links(strips, size, lead[:, : _width(sample, lead, similarity)], epsilon, similarity))
    with _batches_of(spark, _PAIR_BYTES):
        found = stage(reduce(DataFrame.unionByName, links, spark.createDataFrame([], _LINKS)), "links")
    linked = stage(_linked(found), "linked")
    # Only vectors that have links or copies are looked up; every other row is alone.
    tied = (
        reduce(DataFrame.unionByName, classes, spark.createDataFrame([], _CLASSES))
        .join(linked, "node", "left")
        .where(F.col("n").isNotNull() | (F.col("copies") > 1))
        .select(
            "key_a",
            "key_b",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("tied_links"),
            F.when(F.col("n").isNotNull(), F.col("least_id")).when(F.col("named"), F.col("node")).alias("tied_id"),
        )
    )
    full = fine.join(stage(tied, "tied"), ["key_a", "key_b"], "left").select(
        "row_id",
        F.coalesce("tied_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("tied_links").isNull(), F.col("row_id")).otherwise(F.col("tied_id")).alias("component_id"),
    )
    alone = named.where(~usable(F.col("vector"))).select(
        "row_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("component_id")
    )
    return full.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(False))
    )


@contextmanager
def _batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes for what runs inside; a task holds several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _linked(links: DataFrame) -> DataFrame:
    """``node, n, least_id`` of every node with links: their number, and the smallest id of its component."""
    reached = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"), F.max("named").alias("named"))
    nodes = counts.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min(F.when(F.col("named"), F.col("node"))).alias("least_id"))
    return nodes.join(least, "component").select("node", "n", "least_id")


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components neither overflow nor vanish.
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, initial=0.0, keepdims=True), 5e-324)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 5e-324)


def _coordinates(unit: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Leading coordinates and the length of the rest: distances in them never exceed true ones."""
    front = unit @ lead
    rest = np.sqrt(np.maximum(0.0, 1.0 - (front * front).sum(axis=1)))
    return np.column_stack([front, rest])


def _cells(unit: np.ndarray, lead: np.ndarray, width: float) -> np.ndarray:
    """Grid cells, summed column by column: equal vectors get equal cells wherever they stand in a batch."""
    front = np.zeros((len(unit), lead.shape[1]))
    for column, weights in zip(unit.T, lead):
        front += column[:, None] * weights
    rest = np.ones(len(unit))
    for column in front.T:
        rest -= column * column
    at = np.column_stack([front, np.sqrt(np.maximum(0.0, rest))])
    return np.floor(at / width).astype(np.int32)


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each run of equal keys, with the least id and the sum of the copies."""
    key_a, key_b = batch["key_a"].to_numpy(), batch["key_b"].to_numpy()
    first = np.flatnonzero(np.r_[True, (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])])
    if len(first) == batch.num_rows:
        return batch
    ids = batch["least_id"]
    least = np.minimum.reduceat(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), first)
    unnamed = np.logical_and.reduceat(ids.is_null().to_numpy(zero_copy_only=False), first)
    made = {
        "least_id": pa.array(least, mask=unnamed),
        "copies": pa.array(np.add.reduceat(batch["copies"].to_numpy(), first)),
    }
    kept = batch.take(pa.array(first))
    return pa.RecordBatch.from_arrays([made.get(n, kept[n]) for n in kept.schema.names], names=kept.schema.names)


def _strips(rows: DataFrame, size: int, lead: np.ndarray, epsilon: float, interval: int) -> DataFrame:
    """Classes of equal vectors in grid order, cut into strips; vectors are shipped once."""
    width = max(epsilon, 1e-3)
    kind = rows.schema["vector"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    stored = np.dtype(np.float32 if single else np.float64)
    vector = f"array<{'float' if single else 'double'}>"
    cells = f"cells array<int>, key_a long, key_b long, least_id long, copies long, vector {vector}"
    most = interval * max(1, min(_STRIP, _STRIP_BYTES // (interval * size * stored.itemsize)))

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            order = np.lexsort((batch["key_b"].to_numpy(), batch["key_a"].to_numpy()))
            batch = _merged(batch.take(pa.array(order)))
            cell = _cells(_unit(matrix(batch["vector"], size)), lead, width)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(cell) + 1, dtype=np.int32) * cell.shape[1]), pa.array(cell.ravel())
            )
            yield pa.RecordBatch.from_arrays([lists, *batch.columns], names=["cells", *batch.schema.names])

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in classes(stream):
            while batch.num_rows:
                part = batch.slice(0, most - count)
                held.append(part)
                count += part.num_rows
                batch = batch.slice(part.num_rows)
                if count == most:
                    yield pack(number, held)
                    number, held, count = number + 1, [], 0
        if held:
            yield pack(number, held)

    def classes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors as one row; they follow each other, also across batches."""
        last: list[pa.RecordBatch] = []
        for batch in stream:
            if batch.num_rows:
                names = batch.schema.names
                batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
                batch = _merged(pa.Table.from_batches([*last, batch]).combine_chunks().to_batches()[0])
                last = [batch.slice(batch.num_rows - 1)]
                yield batch.slice(0, batch.num_rows - 1)
        yield from last

    def pack(strip: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = matrix(table["vector"].chunk(0), size)
        at = _coordinates(_unit(vectors), lead)
        ids = table["least_id"].chunk(0)
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        key_a = table["key_a"].to_numpy()
        # A class without an id is a node of its own, by its key.
        nodes = np.where(named, ids.fill_null(0).to_numpy(), key_a)
        columns = [nodes, named, table["copies"].to_numpy(), key_a, table["key_b"].to_numpy(), vectors.astype(stored)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([strip]),
                pa.array([at.min(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([at.max(axis=0).tolist()], pa.list_(pa.float64())),
                *(pa.array([np.ascontiguousarray(column).tobytes()]) for column in columns),
            ],
            names=["strip", "low", "high", "nodes", "named", "copies", "key_a", "key_b", "vectors"],
        )

    shipped = rows.select(
        "key_a",
        "key_b",
        F.col("row_id").alias("least_id"),
        F.lit(1).cast("long").alias("copies"),
        F.col("vector").cast(vector).alias("vector"),
    )
    # The keys are part of the order: equal vectors meet in one task, a crowded cell is dealt over several.
    order = [F.col("cells"), F.col("key_a"), F.col("key_b")]
    return (
        shipped.mapInArrow(place, cells).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _STRIPS)
    )


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of strips, a row each."""
    kinds = {"key_a": np.int64, "key_b": np.int64, "nodes": np.int64, "named": np.bool_, "copies": np.int64}
    for batch in stream:
        for i in range(batch.num_rows):
            columns = [pa.array(np.frombuffer(batch[name][i].as_py(), kind)) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names=["key_a", "key_b", "node", "named", "copies"])


def _width(sample: np.ndarray, lead: np.ndarray, similarity: float) -> int:
    """How many coordinates rule out pairs at the least cost, by a sample: each costs, and so does a pair left."""
    size = lead.shape[1]
    at = sample[:1000] @ lead
    if len(at) < 2:
        return size
    costs = {}
    for width in np.unique(np.linspace(min(GRID_COORDINATES, size), size, 16).astype(int)).tolist():
        front = at[:, :width]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (front * front).sum(axis=1)))
        left = np.count_nonzero(front @ front.T + np.outer(rest, rest) >= similarity - _SLACK) - len(at)
        costs[0.1 + 0.01 * width + 300 * max(0, left) / (len(at) * (len(at) - 1))] = width
    return costs[min(costs)]


def _links(strips: DataFrame, size: int, lead: np.ndarray, epsilon: float, similarity: float) -> DataFrame:
    # float32 rounds products of unit vectors by less.
    least = similarity - _SLACK - 4 * (lead.shape[1] + 2) * 2.0**-24
    given = ("nodes", "named", "copies", "vectors")

    def side(mark: str) -> DataFrame:
        return strips.select(
            F.col("strip").alias(mark), *(F.col(c).alias(f"{c}_{mark}") for c in ("low", "high", *given))
        )

    gaps = F.zip_with(
        F.zip_with("low_y", "high_x", lambda a, b: F.greatest(F.lit(0.0), a - b)),
        F.zip_with("low_x", "high_y", lambda a, b: F.greatest(F.lit(0.0), a - b)),
        lambda a, b: (a + b) * (a + b),
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap) <= epsilon * epsilon + _SLACK
    # Either of two strips may come first, so that every part of the table has about as many pairs.
    first, second = F.least("x", "y"), F.greatest("x", "y")
    turn = (F.col("x") < F.col("y")) == (F.xxhash64(first, second).bitwiseAND(F.lit(1)) == 0)
    once = (F.col("x") == F.col("y")) | turn
    # A nested loop reads the stored strips again for each part of them: pairs of strips take no disk.
    met = side("x").coalesce(_parts(strips)).join(side("y").hint("shuffle_replicate_nl"), once & near)

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Strip] = {}

        def strip(batch: pa.RecordBatch, i: int, mark: str) -> Strip:
            number = batch[mark][i].as_py()
            found = ready.pop(number, None) or Strip.read(
                *(batch[f"{name}_{mark}"][i].as_py() for name in given), size, lead
            )
            ready[number] = found
            if len(ready) > _READY:
                del ready[next(iter(ready))]
            return found

        for batch in stream:
            for i in range(batch.num_rows):
                found = compare_strips(strip(batch, i, "x"), strip(batch, i, "y"), epsilon, similarity, least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["node", "named", "root", "n"])

    wanted = [f"{name}_{mark}" for mark in "xy" for name in given]
    return met.select("x", "y", *wanted).mapInArrow(compare, _LINKS)


def _parts(strips: DataFrame) -> int:
    """Parts of the first side: each meets each part of the second one in a task."""
    there = strips.rdd.getNumPartitions()
    tasks = _TASKS_PER_CORE * strips.sparkSession.sparkContext.defaultParallelism
    return max(1, min(there, max(-(-there // _MET_PARTS), -(-tasks // max(1, there)))))


@dataclass(eq=False)
class Strip:
    """Vectors of a strip with their coordinates, and the boxes of its blocks."""

    nodes: np.ndarray
    named: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    front: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def read(cls, nodes: bytes, named: bytes, copies: bytes, vectors: bytes, size: int, lead: np.ndarray) -> Strip:
        numbers = np.frombuffer(nodes, np.int64)
        kind = np.float32 if len(vectors) == len(numbers) * size * 4 else np.float64
        given = np.frombuffer(vectors, kind).reshape(-1, size)
        front = np.empty((len(given), lead.shape[1] + 1), dtype=np.float32)
        boxes = []
        # Block by block: a strip in double precision would take a multiple of its memory.
        for start in range(0, len(given), _LEAF):
            at = _coordinates(_unit(given[start : start + _LEAF].astype(np.float64)), lead)
            front[start : start + _LEAF] = at
            boxes.append((at.min(axis=0), at.max(axis=0)))
        low, high = (np.array(ends) for ends in zip(*boxes))
        return cls(numbers, np.frombuffer(named, np.bool_), np.frombuffer(copies, np.int64), given, front, low, high)

    def unit(self, places) -> np.ndarray:
        return _unit(self.vectors[places].astype(np.float64))


def compare_strips(x: Strip, y: Strip, epsilon: float, similarity: float, least: float):
    """Linked nodes of two strips, their local roots, and their links weighted by copies."""
    same = x is y
    count = len(x.nodes)
    total = count if same else count + len(y.nodes)
    links = np.zeros(total, dtype=np.int64)
    links_x, links_y = links[:count], links if same else links[count:]
    edges = Edges(total)
    gap = np.maximum(0.0, np.maximum(y.low[None] - x.high[:, None], x.low[:, None] - y.high[None]))
    near = (gap * gap).sum(axis=2) <= epsilon * epsilon + _SLACK
    if same:
        near = np.triu(near)

    def add(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Links of the pairs of places of ``x`` and of ``y`` that are near enough."""
        p, q = (np.concatenate(places) for places in zip(*pairs))
        if same:
            p, q = p[p < q], q[p < q]
        step = max(1, _WAITING // x.vectors.shape[1])
        for start in range(0, len(p), step):
            decide(p[start : start + step], q[start : start + step])

    def decide(p: np.ndarray, q: np.ndarray) -> None:
        cosine = np.einsum("ij,ij->i", x.unit(p), y.unit(q))
        linked = cosine >= similarity
        for k in np.flatnonzero(np.abs(cosine - similarity) < _SLACK):
            linked[k] = _linked_exactly(x.vectors[p[k]], y.vectors[q[k]], similarity)
        p, q = p[linked], q[linked]
        np.add.at(links_x, p, y.copies[q])
        np.add.at(links_y, q, x.copies[p])
        edges.add(p, q if same else q + count)

    def add_block(a: int, b: int, c: int, d: int) -> None:
        """The same for a whole block, of which many pairs are left."""
        cosine = x.unit(slice(a, b)) @ y.unit(slice(c, d)).T
        linked = cosine >= similarity
        for i, j in zip(*np.nonzero(np.abs(cosine - similarity) < _SLACK)):
            linked[i, j] = _linked_exactly(x.vectors[a + i], y.vectors[c + j], similarity)
        if same and a == c:
            linked = np.triu(linked, 1)
        rows, columns = linked.any(axis=1), linked.any(axis=0)
        if not rows.any():
            return
        links_x[a:b] += linked @ y.copies[c:d]
        links_y[c:d] += x.copies[a:b] @ linked
        # Join every row with its first partner, and every column with its first one, until all are one.
        label = np.concatenate([np.arange(b - a), np.arange(d - c) + (b - a)])
        _merge(linked, rows, columns, label)
        shift = 0 if same else count
        places = np.concatenate([np.arange(a, b), np.arange(c, d) + shift])
        tied = np.flatnonzero(np.concatenate([rows, columns]))
        edges.add(places[tied], places[label[tied]])

    bound = np.empty(_LEAF * _LEAF * _BLOCKS, dtype=np.float32)
    left = np.empty(len(bound), dtype=np.bool_)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i in range(len(x.low)):
        a, b = i * _LEAF, min((i + 1) * _LEAF, count)
        for first, last in _runs(np.flatnonzero(near[i])):
            c, d = first * _LEAF, min(last * _LEAF, len(y.nodes))
            size = (b - a) * (d - c)
            np.matmul(x.front[a:b], y.front[c:d].T, out=bound[:size].reshape(b - a, d - c))
            np.greater_equal(bound[:size], least, out=left[:size])
            if np.count_nonzero(left[:size]) > _DENSE * size:
                for start in range(c, d, _LEAF):
                    add_block(a, b, start, min(start + _LEAF, d))
            else:
                p, q = np.divmod(_places(left[:size]), d - c)
                waiting.append((p + a, q + c))
                held += len(p)
            if held * x.vectors.shape[1] > _WAITING:
                add(waiting)
                waiting, held = [], 0
    if waiting:
        add(waiting)
    linked = np.flatnonzero(links)
    nodes, named = (x.nodes, x.named) if same else (np.concatenate([x.nodes, y.nodes]), np.concatenate([x.named, y.named]))
    return nodes[linked], named[linked], nodes[edges.roots()[linked]], links[linked]


def _linked_exactly(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    p, q = p.astype(np.float64), q.astype(np.float64)
    return (p @ q) / (math.sqrt(p @ p) * math.sqrt(q @ q)) >= similarity


def _places(marks: np.ndarray) -> np.ndarray:
    """Places of the few true ones, found eight at a time."""
    whole = len(marks) - len(marks) % 8
    words = np.flatnonzero(marks[:whole].view(np.uint64) != 0)
    places = np.concatenate([(words[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(marks))])
    return places[marks[places]]


def _runs(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of up to ``_BLOCKS`` blocks that follow each other: first, and one behind the last."""
    for run in np.split(blocks, np.flatnonzero(np.diff(blocks) != 1) + 1):
        for k in range(0, len(run), _BLOCKS):
            yield int(run[k]), int(run[min(k + _BLOCKS, len(run)) - 1]) + 1


class Edges:
    """Links among ``count`` places, reduced to one per place whenever many are held."""

    def __init__(self, count: int) -> None:
        self.label = np.arange(count)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.number = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.number += len(a)
            if self.number > _HELD_LINKS:
                self.roots()

    def roots(self) -> np.ndarray:
        """The smallest place that each place is connected with."""
        if not self.held:
            return self.label
        a, b = (np.concatenate(ends) for ends in zip(*self.held))
        self.held, self.number = [], 0
        label = self.label
        while True:
            p, q = label[a], label[b]
            open_ = p != q
            if not open_.any():
                self.label = label
                return label
            a, b, p, q = a[open_], b[open_], p[open_], q[open_]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while ((jumped := label[label]) != label).any():
                label = jumped


def _merge(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray, label: np.ndarray) -> None:
    """Give all rows and columns of a connected part of a link matrix the same, smallest label."""
    n = len(rows)
    most = len(label)
    while True:
        before = label.copy()
        label[n:][columns] = np.minimum(
            label[n:], np.where(linked, label[:n, None], most).min(axis=0, initial=most)
        )[columns]
        label[:n][rows] = np.minimum(label[:n], np.where(linked, label[None, n:], most).min(axis=1, initial=most))[rows]
        if (before == label).all():
            return
