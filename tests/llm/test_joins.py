"""Near-duplicate joins against brute force."""

import math
import os
import threading
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pytest

from anomaloom.llm.components import connected_components
from anomaloom.llm.grid_join import Edges, Strip, _cells, _places, _unit, compare_strips, join_near_vectors
from anomaloom.llm.jaccard_join import _met, _shared_signatures, across, candidate_links, jaccard_join
from anomaloom.llm.rows import first_of_groups
from anomaloom.llm.shingles import CELLS, Sets, SketchTable, band_of, most_differences, similar, sketches
from odd import frame, odd_rows, unnamed_rows, words


def components(ids, linked):
    found = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    return found


def shingles(text, size):
    raw = (text or "").encode().lower().split()
    if len(raw) < size:
        return {tuple(raw)} if raw else set()
    return {tuple(raw[i : i + size]) for i in range(len(raw) - size + 1)}


def brute_jaccard(rows, size, percent):
    sets = {i: shingles(text, size) for i, text in rows}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = components(sets, linked)
    return {i: (len(sets[i]), sum(i in pair for pair in linked), found[i]) for i in sets}


def near_rows():
    """Chains of ever further copies, and groups that share a passage only."""
    rows, number = [], 100
    for group in range(6):
        text = words(12 * (group + 1), group)
        for step in range(8):
            text = text[: step * 2] + [f"new{group}{step}"] + text[step * 2 + 1 :]
            rows.append((number, " ".join(text)))
            number += 1
    passage = words(20, 77)
    for i in range(10):
        rows.append((number + i, " ".join(passage + words(10, 200 + i))))
    return rows


@pytest.mark.parametrize("size,percent,block,signature", [(3, 90, 1500, 1000), (5, 80, 1500, 2), (3, 70, 3, 3)])
def test_jaccard_join(spark, size, percent, block, signature):
    rows = odd_rows() + near_rows()
    docs = frame(spark, rows)
    got = jaccard_join(docs, shingle=size, percent=percent, block_sets=block, signature_sets=signature).collect()
    assert {r.row_id: (r.n_shingles, r.n_links, r.component_id) for r in got} == brute_jaccard(rows, size, percent)
    assert len(got) == len(rows)


def test_jaccard_join_without_ids(spark):
    got = jaccard_join(frame(spark, unnamed_rows()), shingle=3, percent=90).collect()
    by_id = sorted(((r.row_id, r.component_id, r.n_links) for r in got), key=str)
    assert by_id == sorted([(None, 1, 3), (None, None, 0), (1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 3, 0)], key=str)


def test_one_row_of_each_group_stays(spark):
    docs = frame(spark, unnamed_rows())
    kept = first_of_groups(docs, jaccard_join(docs, shingle=3, percent=90))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


def test_empty_tables(spark):
    assert jaccard_join(frame(spark, [])).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert join_near_vectors(empty).collect() == []
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bands_hold_all_partners():
    for percent in (70, 80, 90):
        for size in range(1, 400):
            for other in range(size, size * 100 // percent + 1):
                band = band_of(size, percent)
                assert band_of(other, percent) - band in (0, 1)
                least_shared = -(-percent * (size + other) // (100 + percent))
                assert size + other - 2 * least_shared <= most_differences(band, percent)


def test_components_of_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    found = {r.node: r.component for r in got}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_cosine(rows, similarity):
    fine = {
        i: np.array(v, dtype=float)
        for i, v in rows
        if v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    }
    linked = []
    for a in fine:
        for b in fine:
            if a < b and len(fine[a]) == len(fine[b]):
                x, y = fine[a] / np.abs(fine[a]).max(), fine[b] / np.abs(fine[b]).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= similarity:
                    linked.append((a, b))
    found = components([i for i, _ in rows], linked)
    return {i: (sum(i in pair for pair in linked), found[i], found[i] == i) for i, _ in rows}


@pytest.mark.parametrize("interval", [2048, 16])
def test_grid_join(spark, interval):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    rows += [(400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 0.0, 0.0]), (404, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(405, [float("inf"), 1.0, 1.0, 1.0]), (406, [1.0, 2.0]), (410, [2.0, 4.0]), (411, [1.0, 2.1]), (412, [2.0, -1.0]), (407, [1e-30] * 4), (408, [2e-30] * 4), (409, [1e30] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS vector")
    got = join_near_vectors(df, similarity=0.9, interval=interval).collect()
    assert {r.row_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_cosine(rows, 0.9)
    assert len(got) == len(rows)


def test_vectors_without_ids(spark):
    rows = [(None, [1.0, 0.0]), (5, [2.0, 0.0]), (None, [0.0, 3.0]), (6, [1.0, 0.0])]
    got = join_near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(((r.row_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(None, 2, 5, False), (5, 2, 5, True), (None, 0, None, False), (6, 2, 5, False)], key=str
    )


def near_vectors(rng, count, groups, size=64):
    """Vectors without a direction of their own, and groups about one of them whose members are partly near."""
    vectors = rng.standard_normal((count, size))
    for group in range(groups):
        chosen = rng.choice(count, 40, replace=False)
        vectors[chosen] = vectors[chosen[0]] + rng.uniform(0.1, 0.6) * vectors[chosen]
    return vectors.astype(np.float32)


def linked_pairs(vectors, other, similarity):
    return _unit(vectors.astype(float)) @ _unit(other.astype(float)).T >= similarity


@contextmanager
def disk_watched(spark):
    """The largest size of each file that comes up among the shuffle files and in the shared folder."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    folders = [folder.getPath() for folder in manager.localDirs()] + [spark.conf.get("spark.checkpoint.dir")]
    seen, ended = {}, threading.Event()

    def look():
        for name in (os.path.join(at, name) for folder in folders for at, _, names in os.walk(folder) for name in names):
            with suppress(OSError):
                seen[name] = max(seen.get(name, 0), os.path.getsize(name))

    def watch():
        while not ended.wait(0.1):
            look()

    look()
    before = set(seen)
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        yield seen
    finally:
        ended.set()
        watcher.join()
        look()
        for name in before:
            del seen[name]


def test_grid_join_holds_vectors_on_disk_a_few_times(spark):
    vectors = near_vectors(np.random.default_rng(5), 6000, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    with disk_watched(spark) as files:
        got = {r.row_id: (r.n_links, r.component_id) for r in join_near_vectors(df, similarity=0.9, interval=64).collect()}
    near = np.triu(linked_pairs(vectors, vectors, 0.9), 1)
    found = components(range(6000), list(zip(*map(np.ndarray.tolist, np.nonzero(near)))))
    counts = near.sum(axis=0) + near.sum(axis=1)
    assert counts.max() > 5 and got == {i: (counts[i], found[i]) for i in range(6000)}
    assert sum(files.values()) < 8 * vectors.nbytes


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_join_of_repeated_vectors(spark, kind):
    rng = np.random.default_rng(8)
    vectors = near_vectors(rng, 60, 1, 5).round(1)
    vectors[0, 0], vectors[1] = 0.0, vectors[0]
    vectors[1, 0] = -0.0
    rows = [(int(i), vectors[v].tolist()) for i, v in enumerate(rng.choice(60, 400, p=np.r_[0.4, np.full(59, 0.6 / 59)]))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for interval in (2048, 3):
            got = join_near_vectors(df, similarity=0.9, interval=interval).collect()
            assert {r.row_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_cosine(rows, 0.9)
            assert len(got) == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_that_share_an_id_are_one_node(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.1, 1.0]), (9, [1.0, 0.1]), (3, [-1.0, 0.0]), (4, [0.0, -1.0]), (4, [0.1, -1.0])]
    got = join_near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.row_id, r.n_links, r.component_id) for r in got) == [
        (3, 0, 3), (4, 2, 4), (4, 2, 4), (5, 2, 5), (5, 2, 5), (7, 1, 5), (9, 1, 5)
    ]


@pytest.mark.parametrize("width", [8, 20, 64])
def test_strips_are_compared_as_a_whole(width):
    rng = np.random.default_rng(width)
    vectors = near_vectors(rng, 1300, 8)
    vectors[700:1100] = vectors[700] + 0.3 * vectors[700:1100]
    lead = np.linalg.qr(rng.standard_normal((64, 64)))[0][:, :width]

    def strip(rows):
        numbers, copies = np.arange(len(rows)), np.arange(len(rows)) % 3 + 1
        return Strip.read(numbers.tobytes(), (numbers >= 0).tobytes(), copies.tobytes(), rows.tobytes(), 64, lead)

    whole, x, y = strip(vectors), strip(vectors[:900]), strip(vectors[900:])
    for a, b in ((whole, whole), (x, y)):
        nodes, named, roots, n = compare_strips(a, b, math.sqrt(0.2), 0.9, 0.9 - 1e-5)
        near = linked_pairs(a.vectors, b.vectors, 0.9)
        if a is b:
            near &= ~np.eye(len(near), dtype=bool)
        wanted = [near @ b.copies] if a is b else [near @ b.copies, a.copies @ near]
        assert n.tolist() == [k for side in wanted for k in side.tolist() if k] and named.all()
        shift = 0 if a is b else len(a.nodes)
        places = np.concatenate([np.flatnonzero(side) + shift * i for i, side in enumerate(wanted)])
        found = components(range(shift + len(b.nodes)), [(i, j + shift) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)))])
        of = np.concatenate([a.nodes, b.nodes])
        assert nodes.tolist() == of[places].tolist() and roots.tolist() == [of[found[p]] for p in places.tolist()]


def test_links_are_reduced_to_the_smallest_places():
    rng = np.random.default_rng(1)
    edges = Edges(500)
    pairs = rng.integers(0, 500, (300, 2))
    for part in np.split(pairs, 30):
        edges.add(part[:, 0], part[:, 1])
        if rng.random() < 0.3:
            edges.roots()
    found = components(range(500), pairs.tolist())
    assert edges.roots().tolist() == [found[i] for i in range(500)]


def test_marks_and_cells_by_place():
    rng = np.random.default_rng(7)
    for n in (1, 7, 8, 9, 4096):
        marks = rng.random(n) < 0.05
        assert _places(marks).tolist() == np.flatnonzero(marks).tolist()
    vectors = rng.standard_normal((500, 64))
    lead = np.linalg.qr(rng.standard_normal((64, 64)))[0][:, :8]
    together = _cells(_unit(vectors), lead, 1e-3)
    assert (together == np.concatenate([_cells(_unit(v[None]), lead, 1e-3) for v in vectors])).all()


def test_candidate_links_connect_all_that_may_be_similar():
    rng = np.random.default_rng(6)
    task = np.sort(rng.integers(0, 6, 400))
    task[:30] = np.sort(rng.integers(-2, 0, 30))
    side = np.where(task == 2, rng.integers(1, 3, 400) * 2, np.where(task == 3, 5, -1))
    side[task == -1] = 2 * (np.arange((task == -1).sum()) % 2)
    sizes = rng.integers(20, 40, 400)
    cells = rng.integers(0, 2, (400, CELLS[0])).astype(np.uint8)
    cells[rng.integers(0, 400, 200)] = cells[0]
    drawn = SketchTable([c.tobytes() for c in cells], sizes)
    links = candidate_links(task, side, drawn, 60)
    assert (task[links[:, 0]] == task[links[:, 1]]).all()
    i, j = np.triu_indices(400, 1)
    near = drawn.near(i, j, 60) & (task[i] == task[j]) & ((side[i] != side[j]) | np.isin(side[i], (-1, 5)))
    assert components(range(400), links.tolist()) == components(range(400), list(zip(i[near], j[near])))


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_shared_signatures_are_cut_into_blocks(batch):
    rng = np.random.default_rng(batch)
    rows = sorted({(int(s), int(k)) for s, k in zip(rng.zipf(1.6, 300) % 40, rng.integers(0, 60, 300))})
    repeated = sorted(rows + rows[::3] + rows[::5])
    stream = (
        pa.RecordBatch.from_pylist([{"signature": s, "key_a": k} for s, k in repeated[i : i + batch]])
        for i in range(0, len(repeated), batch)
    )
    got = [(r["signature"], r["key_a"], r["block"]) for part in _shared_signatures(4)(stream) for r in part.to_pylist()]
    wanted = []
    for signature in sorted({s for s, _ in rows}):
        sets = [k for s, k in rows if s == signature]
        if len(sets) > 1:
            wanted += [(signature, k, n // 4 if len(sets) > 4 else -1) for n, k in enumerate(sets)]
    assert got == wanted and max(b for _, _, b in got) > 3


def test_sets_of_a_large_signature_meet_once(spark):
    shared = [(1, k, -1) for k in range(3)] + [(2, k, k // 4) for k in range(10, 21)]
    met = _met(spark.createDataFrame(shared, "signature long, key_a long, block long")).collect()
    tasks = {}
    for row in met:
        tasks.setdefault(row.task, []).append((row.side, row.key_a))
    pairs = []
    for rows in tasks.values():
        side, keys = np.array([s for s, _ in rows]), [k for _, k in rows]
        i, j = np.triu_indices(len(rows), 1)
        pairs += [tuple(sorted((keys[a], keys[b]))) for a, b in zip(i, j) if across(side, a, b)]
    groups = [range(3), range(10, 21)]
    assert sorted(pairs) == [(a, b) for group in groups for a in group for b in group if a < b]
    assert max(map(len, tasks.values())) == 8


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    members, bounds = [], [0]
    for size in (3, 100, 500, 600, 2000, 9000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for changed in (0, 1, size // 30, size // 12):
            other = base.copy()
            other[:changed] = rng.integers(0, 2**63, changed, dtype=np.uint64)
            members.append(np.unique(other))
            bounds.append(bounds[-1] + len(members[-1]))
    sets = Sets(np.concatenate(members), np.array(bounds))
    drawn = SketchTable(sketches(sets, np.ones(len(members), dtype=bool)), sets.sizes)
    i, j = np.triu_indices(len(members), 1)
    linked = np.array([similar(members[a], members[b], 80) for a, b in zip(i, j)])
    near = drawn.near(i, j, 80)
    assert linked.sum() >= 30 and near[linked].all() and not near[~linked].all()
