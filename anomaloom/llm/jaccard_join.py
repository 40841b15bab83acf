"""N-gram Jaccard join by PartEnum signatures.

Sets that share a signature are candidates, and only they. Candidates whose sizes or sketches
(counters, a sound lower bound of their difference) rule out a link fall away where they meet: in one
task as long as a signature has few sets, else the signature is cut into blocks and every pair of blocks
meets in a task of its own. The rest of a signature is tied together by few links, never by all pairs;
the connected groups of these links are cut into blocks of bounded size, and every pair of blocks is
joined exactly in a task: sets that share a signature are compared by their shingles. Equal sets are
compared once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anomaloom.llm.components import connected_components
from anomaloom.llm.hashing import texts_of
from anomaloom.llm.rows import keyed_texts, same_row, whole_groups
from anomaloom.llm.shingles import Sets, SketchTable, set_keys, shingle_sets, signatures, sketches
from anomaloom.session import stage

#: Sets of one block; a task joins two blocks at most.
BLOCK_SETS = 1500
#: Sets of one block of a signature; a signature with no more is not cut.
SIGNATURE_SETS = 1000
#: Sets whose signatures a task remembers as sent; equal sets sign once per task.
REMEMBERED_SETS = 500_000
#: Cells of row hashes by which texts are looked through before they are shipped.
HASH_CELLS = 1 << 18
#: Signatures with up to so many sets have their pairs filtered one by one, larger ones row by row.
FEW_SETS = 48

_SETS = "row_id long, row_hash long, n_shingles long, key_a long, key_b long, sketch binary"
_SETS_ARROW = pa.schema(
    [
        ("row_id", pa.int64()),
        ("row_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("key_a", pa.int64()),
        ("key_b", pa.int64()),
        ("sketch", pa.binary()),
    ]
)
_SIGNED_ARROW = pa.schema([("signature", pa.int64()), ("key_a", pa.int64())])
_SHARED = "signature long, key_a long, block long"
_SHARED_ARROW = pa.schema([("signature", pa.int64()), ("key_a", pa.int64()), ("block", pa.int64())])
_LINKS_ARROW = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    block_sets: int = BLOCK_SETS,
    signature_sets: int = SIGNATURE_SETS,
) -> DataFrame:
    """One row per document with the class of documents it is linked to.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets
    (A-Z lower-cased; a text with fewer words than ``shingle`` has its whole word sequence as one).
    Returns ``row_id`` (the id), ``row_hash`` (of the text), ``n_shingles``, ``n_links`` (documents
    linked directly), ``component_id`` (smallest id reachable by links, itself included) and
    ``class_id`` (a number that all rows of a component share, also where ids are null).

    Null, empty and blank texts have an empty set and are linked with nothing. Rows with equal text are
    linked with each other. Rows that share an id are one node. Rows without an id take part;
    their ``component_id`` is null if no linked row has an id. An empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    texts = keyed_texts(docs, id_col, text_col)
    rows = stage(texts.mapInArrow(_describe(shingle), _SETS), "sets")
    filled = rows.where("n_shingles > 0")
    classes = (
        filled.groupBy("key_a", "key_b")
        .agg(
            F.min(F.struct("row_hash", "row_id")).alias("rep"),
            F.min("row_id").alias("least_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.max("sketch").alias("sketch"),
        )
        .withColumn("node", F.coalesce("least_id", "key_a"))
    )
    classes = stage(classes, "classes")
    # Signatures go to the shuffle straight from the texts: they are the bulk, and nothing else reads them.
    shared = (
        texts.mapInArrow(_sign(shingle, percent), "signature long, key_a long")
        .repartition("signature")
        .sortWithinPartitions("signature", "key_a")
        .mapInArrow(_shared_signatures(signature_sets), _SHARED)
    )
    candidates = (
        _met(stage(shared, "shared"))
        .join(classes.select("key_a", "n_shingles", "sketch"), "key_a")
        .repartition("task")
        .sortWithinPartitions("task")
        .mapInArrow(_near_candidates(percent), "a long, b long")
    )
    groups = connected_components(candidates)
    links = stage(_verified(texts, classes, groups, shingle, percent, block_sets), "links")
    reached = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = (
        classes.join(linked, "node", "left")
        .join(reached, "node", "left")
        .select(
            "key_a",
            "key_b",
            "least_id",
            F.coalesce("component", "node").alias("class_id"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    least = nodes.groupBy("class_id").agg(F.min("least_id").alias("component_id"))
    named = nodes.join(least, "class_id").drop("least_id")
    rows = rows.drop("sketch")
    empty = rows.where("n_shingles = 0").select(
        "row_id",
        "row_hash",
        "n_shingles",
        F.lit(0).cast("long").alias("n_links"),
        F.col("row_id").alias("component_id"),
        F.lit(None).cast("long").alias("class_id"),
    )
    full = (
        rows.where("n_shingles > 0")
        .join(named, ["key_a", "key_b"])
        .select("row_id", "row_hash", "n_shingles", "n_links", "component_id", "class_id")
    )
    return full.unionByName(empty)


class _Remembered:
    """Which sets a task sees for the first time, as far as it remembers."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def fresh(self, key_a: np.ndarray, key_b: np.ndarray) -> np.ndarray:
        first = np.zeros(len(key_a), dtype=bool)
        for i, key in enumerate(zip(key_a.tolist(), key_b.tolist())):
            if key not in self.seen:
                first[i] = True
                self.seen.add(key)
        if len(self.seen) > REMEMBERED_SETS:
            self.seen.clear()
        return first


def _describe(shingle: int):
    """Size, key and sketch of every row's set; equal sets are sketched once per task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Remembered()
        for batch in stream:
            for texts in texts_of(batch["body"]):
                sets = shingle_sets(texts, shingle)
                key_a, key_b = set_keys(sets)
                drawn = sketches(sets, remembered.fresh(key_a, key_b))
                rows = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["row_id"],
                        rows["row_hash"],
                        pa.array(sets.sizes),
                        pa.array(key_a),
                        pa.array(key_b),
                        pa.array(drawn, pa.binary()),
                    ],
                    schema=_SETS_ARROW,
                )

    return run


def _sign(shingle: int, percent: int):
    """Signatures of the sets; equal sets sign once per task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _Remembered()
        for batch in stream:
            for texts in texts_of(batch["body"]):
                sets = shingle_sets(texts, shingle)
                key_a, key_b = set_keys(sets)
                signed, owner = signatures(sets, percent, remembered.fresh(key_a, key_b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed.view(np.int64)), pa.array(key_a[owner])], schema=_SIGNED_ARROW
                )

    return run


def _shared_signatures(most: int):
    """Distinct rows of the signatures that more than one set has; rows come sorted.

    ``block`` numbers the blocks of ``most`` sets of a signature that has more, and is -1 for the others.
    Keeps ``most`` rows between batches, so a signature of any frequency passes in bounded memory.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        signed, sets = none, none
        large = last_set = None  # the signature that has been found to need blocks, and its last set
        sent = 0
        for batch in stream:
            if not batch.num_rows:
                continue
            signed = np.concatenate([signed, batch["signature"].to_numpy()])
            sets = np.concatenate([sets, batch["key_a"].to_numpy()])
            new = np.ones(len(signed), dtype=bool)
            new[1:] = (signed[1:] != signed[:-1]) | (sets[1:] != sets[:-1])
            if large is not None:
                new[0] = signed[0] != large or sets[0] != last_set
            signed, sets = signed[new], sets[new]
            if not len(signed):
                continue
            starts = np.flatnonzero(np.concatenate([[True], signed[1:] != signed[:-1]]))
            rows = np.diff(np.append(starts, len(signed)))
            total = rows.copy()
            place = np.arange(len(signed)) - np.repeat(starts, rows)
            if large is not None and signed[0] == large:
                total[0] += sent
                place[: rows[0]] += sent
            block = np.where(np.repeat(total > most, rows), place // most, -1)
            take = np.repeat(total > 1, rows)
            # The last signature waits as long as it may turn out to be shared or to need blocks.
            waits = total[-1] <= most
            if waits:
                take[starts[-1] :] = False
            if take.any():
                yield _shared_batch(signed[take], sets[take], block[take])
            if waits:
                large = None
                signed, sets = signed[starts[-1] :], sets[starts[-1] :]
            else:
                large, last_set, sent = signed[-1], sets[-1], total[-1]
                signed, sets = none, none
        if len(signed) > 1:
            yield _shared_batch(signed, sets, np.full(len(signed), -1, dtype=np.int64))

    return run


def _shared_batch(signed: np.ndarray, sets: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed), pa.array(sets), pa.array(block)], schema=_SHARED_ARROW)


def _met(shared: DataFrame) -> DataFrame:
    """``task, side, key_a``: where the sets of a signature meet; sides are those of ``across``."""
    small = shared.where("block < 0").select(
        F.col("signature").alias("task"), F.lit(-1).cast("long").alias("side"), "key_a"
    )
    large = shared.where("block >= 0")
    blocks = large.groupBy("signature").agg(F.max("block").alias("last"))
    # By signature and block: no key has more rows than a block has sets.
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    paired = large.join(blocks, ["signature", "block"]).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))
    )
    return small.unionByName(
        paired.select(
            F.xxhash64("signature", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
            (F.col("block") * 2 + (F.col("block") == F.col("other")).cast("long")).alias("side"),
            "key_a",
        )
    )


def across(side: np.ndarray, i, j) -> np.ndarray:
    """Whether a task takes the pairs of rows ``i`` and ``j``.

    ``side`` is -1 where a task holds a whole group; else twice the block's number, plus one in the
    task that joins the block with itself. A task of two blocks takes pairs across them only.
    """
    return (side[j] < 0) | (side[j] % 2 == 1) | (side[j] != side[i])


def _near_candidates(percent: int):
    """Links that keep together all sets of a signature which may be similar."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, "task", 5000):
            keys = table["key_a"].to_numpy()
            drawn = SketchTable(table["sketch"].to_pylist(), table["n_shingles"].to_numpy())
            pairs = candidate_links(table["task"].to_numpy(), table["side"].to_numpy(), drawn, percent)
            if len(pairs):
                links = np.unique(np.sort(keys[pairs], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def candidate_links(task: np.ndarray, side: np.ndarray, drawn: SketchTable, percent: int) -> np.ndarray:
    """Pairs of rows that connect all rows of one task which may be similar; rows lie by task."""
    edges = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
    counts = np.diff(edges)
    few = np.repeat(counts <= FEW_SETS, counts)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for step in range(1, FEW_SETS):
        i = np.flatnonzero(few[:-step] & (task[:-step] == task[step:]))
        if not len(i):
            break
        i = i[across(side, i, i + step)]
        i = i[drawn.near(i, i + step, percent)]
        found.append(np.stack([i, i + step], axis=1))
    for low, high in zip(edges[:-1][counts > FEW_SETS], edges[1:][counts > FEW_SETS]):
        # From row to row, a set that may be similar to the row joins its part; parts are tied by stars.
        order = low + np.argsort(drawn.sizes[low:high], kind="stable")
        ends = np.searchsorted(drawn.sizes[order], drawn.sizes[order] * 100 // percent, side="right")
        part = np.arange(len(order))
        for place, row in enumerate(order):
            others = np.arange(place + 1, ends[place])
            others = others[(part[others] != part[place]) & across(side, row, order[others])]
            near = others[drawn.near(np.full(len(others), row), order[others], percent)]
            if len(near):
                joined = np.unique(part[near])
                found.append(np.stack([np.full(len(joined), row), order[joined]], axis=1))
                part[np.isin(part, joined)] = part[place]
    return np.concatenate(found)


def _verified(
    texts: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, percent: int, block_sets: int
) -> DataFrame:
    """``node, root, n``: in a pair of blocks, a node's links (weighted by copies) and its local root."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("blocks"))
    members = (
        classes.join(groups, classes["key_a"] == groups["node"])
        .select(
            "component",
            classes["node"],
            "copies",
            F.col("rep.row_hash").alias("row_hash"),
            F.col("rep.row_id").alias("row_id"),
        )
        .join(sizes, "component")
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    )
    # Texts of other rows stay where they are: a table of at most HASH_CELLS numbers goes to every task.
    hash_cell = F.pmod(F.col("row_hash"), F.lit(HASH_CELLS))
    cells = F.broadcast(members.select(hash_cell.alias("hash_cell")).distinct())
    wanted = texts.join(cells, hash_cell == F.col("hash_cell"), "left_semi")
    bodies = (
        members.join(wanted, same_row(members, wanted), "inner")
        .groupBy("component", "node", "copies", "blocks", "own")
        .agg(F.first("body").alias("body"))
    )
    paired = bodies.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select(
        F.when(F.col("blocks") > 1, F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")))
        .otherwise(F.col("component"))
        .alias("task"),
        "node",
        "copies",
        F.when(F.col("blocks") > 1, F.col("own") * 2 + (F.col("own") == F.col("other")).cast("long"))
        .otherwise(F.lit(-1).cast("long"))
        .alias("side"),
        "body",
    )
    return (
        paired.repartition("task")
        .sortWithinPartitions("task")
        .mapInArrow(_join_blocks(shingle, percent), "node long, root long, n long")
    )


def _join_blocks(shingle: int, percent: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(stream, "task", 300):
            table = table.combine_chunks()
            nodes, roots, counts = join_sets(
                _sets_of(table, shingle),
                table["task"].to_numpy(),
                table["side"].to_numpy(),
                table["node"].to_numpy(),
                table["copies"].to_numpy(),
                percent,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(roots), pa.array(counts)], schema=_LINKS_ARROW
            )

    return run


def _sets_of(table: pa.Table, shingle: int) -> Sets:
    parts = [
        shingle_sets(texts, shingle) for chunk in table["body"].chunks for texts in texts_of(chunk)
    ]
    sizes = np.concatenate([part.sizes for part in parts])
    return Sets(np.concatenate([part.members for part in parts]), np.concatenate([[0], np.cumsum(sizes)]))


def join_sets(
    sets: Sets, task: np.ndarray, side: np.ndarray, node: np.ndarray, copies: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between the sets of each task: linked nodes, their local roots, their link counts.

    ``side`` tells the blocks of a task, as in ``across``.
    """
    count = len(node)
    signed, owner = signatures(sets, percent, np.ones(count, dtype=bool))
    order = np.lexsort((owner, signed))
    signed, owner = signed[order], owner[order]
    ends = np.concatenate([np.flatnonzero(signed[1:] != signed[:-1]) + 1, [len(signed)]])
    starts = np.concatenate([[0], ends[:-1]])
    partners: list[list[np.ndarray]] = [[] for _ in range(count)]
    seen: set[bytes] = set()
    for low, high in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        bucket = owner[low:high]
        if (mark := bucket.tobytes()) in seen:
            continue
        seen.add(mark)
        for place, member in enumerate(bucket[:-1]):
            partners[member].append(bucket[place + 1 :])
    shingles, numbers = np.unique(sets.members, return_inverse=True)
    present = np.zeros(len(shingles), dtype=bool)
    sizes = sets.sizes
    links = np.zeros(count, dtype=np.int64)
    parent = np.arange(count)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(count):
        if not partners[i]:
            continue
        js = np.unique(np.concatenate(partners[i]))
        fits = 100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])
        js = js[(task[js] == task[i]) & across(side, i, js) & fits]
        if not len(js):
            continue
        mine = numbers[sets.bounds[i] : sets.bounds[i + 1]]
        present[mine] = True
        theirs = np.concatenate([numbers[sets.bounds[j] : sets.bounds[j + 1]] for j in js])
        hits = np.concatenate([[0], np.cumsum(present[theirs])])
        edge = np.concatenate([[0], np.cumsum(sizes[js])])
        shared = hits[edge[1:]] - hits[edge[:-1]]
        present[mine] = False
        js = js[100 * shared >= percent * (sizes[i] + sizes[js] - shared)]
        links[i] += copies[js].sum()
        links[js] += copies[i]
        for j in js:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    linked = np.flatnonzero(links)
    roots = np.array([root(int(i)) for i in linked], dtype=np.int64)
    return node[linked], node[roots], links[linked]
