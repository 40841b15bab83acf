"""Repeats of words and bytes against brute force; suffix arrays against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anomaloom.llm import byte_repeats, hashing, word_repeats
from anomaloom.llm.byte_repeats import remove_byte_repeats
from anomaloom.llm.rows import with_splits
from anomaloom.llm.suffix_array import longest_repeats, suffix_array
from anomaloom.llm.word_repeats import remove_word_repeats
from odd import frame, odd_rows, unnamed_rows, words


def passages():
    """Passages that repeat in part, nested, overlapping, and at document ends."""
    rng = random.Random(8)
    pool = [words(rng.randrange(15, 90), 50 + i, 3000) for i in range(8)]
    rows = []
    for number in range(40):
        text = []
        for _ in range(rng.randrange(1, 4)):
            part = pool[rng.randrange(8)]
            cut = rng.randrange(len(part))
            text += part[cut:] if rng.random() < 0.5 else part[: cut + 1]
            text += words(rng.randrange(0, 30), number * 7 + len(text), 5000)
        rows.append((200 + number, " ".join(text)))
    return rows


def brute_words(rows, window):
    seen, gone = set(), {}
    texts = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(texts):
        lost = set()
        for p in range(len(texts[i]) - window + 1):
            key = tuple(texts[i][p : p + window])
            if key in seen:
                lost.update(range(p, p + window))
            seen.add(key)
        gone[i] = lost
    return {
        i: (
            len(w),
            len(gone[i]),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest(),
        )
        for i, w in texts.items()
    }


def brute_bytes(rows, window):
    counts = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for data in texts.values():
        for p in range(len(data) - window + 1):
            key = data[p : p + window]
            counts[key] = counts.get(key, 0) + 1
    out = {}
    for i, data in texts.items():
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if counts[data[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed_runs", [20_000, 2])
def test_word_repeats(spark, seed_runs):
    rows = odd_rows() + passages()
    got = remove_word_repeats(frame(spark, rows), window=20, seed_runs=seed_runs).collect()
    assert {r.row_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, 20)
    assert len(got) == len(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("seed_runs", [20_000, 2])
def test_byte_repeats(spark, seed_runs):
    rows = [row for row in odd_rows() if row[0] not in (10, 11, 12)] + passages() + [(90, "ab" * 300), (91, "z" * 401)]
    got = remove_byte_repeats(frame(spark, rows), window=100, seed_runs=seed_runs).collect()
    assert {r.row_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows, 100)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


class Chunked:
    """A table whose columns do not fit one chunk, as binary columns over 2 GiB."""

    def __init__(self, table):
        self.table = table

    def __getattr__(self, name):
        return getattr(self.table, name)

    def __getitem__(self, name):
        return self.table[name]

    def combine_chunks(self):
        return self


def test_pieces_of_all_chunks_are_matched(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(256) for _ in range(130))
    hashes = np.array([rng.randrange(1 << 60) for _ in range(25)], dtype=np.uint64).tobytes()
    for module, match, extra, window in (
        (byte_repeats, "_match_pieces", {"kind": 2, "check": 0, "n": 1, "twice": False, "piece": text}, 100),
        (word_repeats, "_match_windows", {"words": hashes}, 20),
    ):
        schema = module._PIECES_ARROW
        rows = [{"task": 7, "row_id": i, "row_hash": i, "start": 0, **extra} for i in range(3)]
        batches = [
            pa.RecordBatch.from_pylist([{name: row[name] for name in schema.names}], schema=schema) for row in rows
        ]
        whole = module.whole_groups
        monkeypatch.setattr(module, "whole_groups", lambda *args, whole=whole: map(Chunked, whole(*args)))
        found = pa.Table.from_batches(getattr(module, match)(window)(iter(batches))).to_pylist()
        assert {row["row_id"] for row in found} == ({0, 1, 2} if module is byte_repeats else {1, 2})


def test_split_seed_ships_hashes_and_equal_windows_once():
    """Windows of a frequent seed: no bytes go out, and copies of one window go out once a batch."""
    rng = random.Random(5)
    hot = bytes(rng.randrange(256) for _ in range(160))
    count = 200
    bodies = [bytes([i] * 3) + hot for i in range(count)]
    wish = {"seed": 5, "start": 0, "n": 64, "twice": False, "splits": 2}
    batch = pa.RecordBatch.from_pydict(
        {"row_id": list(range(count)), "row_hash": list(range(count)), "wishes": [[wish]] * count, "body": bodies}
    )
    sent = pa.Table.from_batches(byte_repeats._pieces(100)(iter([batch])))
    assert sum(len(piece or b"") for piece in sent["piece"].to_pylist()) == 0
    # 61 windows are in all texts, three in one each; a text's equal windows are one settled span.
    assert sent.num_rows == 61 + 3 * count + count
    assert sorted(r["n"] for r in sent.to_pylist())[-count:] == [61] * count


def test_window_stream_keeps_pairs_across_batches():
    keys = [3, 5, 5, 5, 8, 9, 9]
    marks = [False, False, True, False, False, True, False]
    for size in (1, 2, 3, 7):
        rows = [
            {"kind": 1, "task": k, "check": 0, "row_id": i, "row_hash": 0, "start": i, "n": 1, "twice": t, "piece": None}
            for i, (k, t) in enumerate(zip(keys, marks))
        ]
        batches = [
            pa.RecordBatch.from_pylist(rows[i : i + size], schema=byte_repeats._PIECES_ARROW)
            for i in range(0, len(rows), size)
        ]
        found = pa.Table.from_batches(byte_repeats._match_pieces(100)(iter(batches))).to_pylist()
        assert [row["start"] for row in found] == [1, 3, 6]


def test_rows_of_a_frequent_seed_stay_in_their_tasks(spark):
    asked = spark.range(0, 4000, 1, 8).selectExpr("if(id % 4 = 0, id, 7) AS seed", "id AS start")
    name = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as for tables that are too large to be sent to every task
    try:
        got = with_splits(asked, 1000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, limit)
    assert sorted(r.start for r in got) == list(range(4000))
    assert {r.splits for r in got if r.seed == 7} == {3} and {r.splits for r in got if r.seed != 7} == {1}
    assert max(Counter(r.task for r in got if r.seed == 7).values()) == 375


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of over 50 words and at least 400 bytes, in two documents each."""
    passages = [" ".join(words(90, 900 + i, 3000)) for i in range(5)]
    assert min(len(p) for p in passages) >= 400
    clean = [" ".join(words(150, 700 + i, 5000)) for i in range(20)]
    texts = [f"{clean[i]} {passages[i % 5]}" if i < 10 else clean[i] for i in range(20)]
    rows = list(enumerate(texts))
    got = {r.row_id: r for r in remove_byte_repeats(frame(spark, rows)).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_bytes(rows, 400)
    assert all(got[i].n_removed >= len(passages[i % 5]) for i in range(10))
    assert all(got[i].n_removed == 0 for i in range(10, 20))


@pytest.mark.parametrize("size", [399, 400])
def test_planted_passage_goes_from_400_bytes_on(spark, size):
    """A passage of over 50 words in two documents: whole at 399 bytes, and gone from both at 400."""
    passage = " ".join(words(110, 31, 3000))[:size]
    assert len(passage) == size and len(passage.split()) > 50
    clean = [" ".join(words(150, 720 + i, 5000)) for i in range(3)]
    # Other bytes stand before and after the passage, so it does not go on.
    rows = [(0, f"{clean[0]}A{passage}B{clean[2]}"), (1, f"{clean[1]}C{passage}D"), (2, clean[2][:380])]
    got = {r.row_id: r for r in remove_byte_repeats(frame(spark, rows)).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_bytes(rows, 400)
    assert [got[i].n_removed for i in range(3)] == ([400, 400, 0] if size == 400 else [0, 0, 0])


def test_long_and_constant_texts(spark):
    rows = [row for row in odd_rows() if row[0] in (10, 11, 12)]
    got = {r.row_id: r for r in remove_byte_repeats(frame(spark, rows), with_text=False).collect()}
    # The shorter long text is a prefix of the other; 50 000 equal bytes repeat themselves.
    shared = len(rows[1][1])
    assert got[10].n_removed == shared + (1 if rows[0][1][shared : shared + 1] else 0) - 1
    assert got[11].n_removed == shared
    assert (got[12].n_removed, got[12].n_spans) == (50_000, 1)


def test_rows_without_ids(spark):
    rows = unnamed_rows()
    got = remove_word_repeats(frame(spark, rows), window=20).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (4, 0), (80, 0), (80, 80), (80, 80), (80, 80)]
    got = remove_byte_repeats(frame(spark, rows), window=200).collect()
    assert sorted(r.n_removed > 0 for r in got) == [False, False, True, True, True, True]


@pytest.mark.parametrize("partitions", [1, 4])
def test_equal_rows_count_as_one(spark, partitions):
    """A row that occurs three times keeps its first windows, and other rows repeat it."""
    base, more = " ".join(words(60, 4)), " ".join(words(45, 5) + words(30, 4))
    rows = [(5, base)] * 3 + [(6, more)] * 2 + [(7, base + " tail")]
    got = remove_word_repeats(frame(spark, rows).repartition(partitions), window=20).collect()
    assert sorted((r.row_id, r.n_removed) for r in got) == [(5, 0)] * 3 + [(6, 30)] * 2 + [(7, 60)]


def test_empty_tables(spark):
    assert remove_word_repeats(frame(spark, [])).collect() == []
    assert remove_byte_repeats(frame(spark, [])).collect() == []


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(1500):
        n, kinds = rng.randint(0, 14), rng.randint(1, 4)
        text = np.array([rng.randint(0, kinds) for _ in range(n)], dtype=np.int64)
        order = suffix_array(text)
        assert order == sorted(range(n), key=lambda i: tuple(text[i:]))
        longest = longest_repeats(text, order)
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            assert longest[i] == best


def test_anchors_do_not_depend_on_the_place(monkeypatch):
    """Texts with more grams than can be numbered at a time: equal windows keep equal anchors."""
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    grams = np.concatenate([rng.integers(0, 1 << 63, 1500, dtype=np.uint64), passage, passage])
    grams[1600:1650] = grams[1600]
    last_start, text = np.array([len(grams) - 17]), np.zeros(len(grams), dtype=np.int64)
    for most in (1 << 10, 1 << 5):
        monkeypatch.setattr(hashing, "MOST_GRAMS", most)
        low = np.uint64(most - 1)
        least = [(int(g & ~low), i) for i, g in enumerate(grams)]
        want = [min(least[p : p + 17])[1] for p in range(len(grams) - 16)]
        anchor, first, last = hashing.anchor_runs(grams, 17, last_start, text)
        got = np.repeat(anchor, last - first + 1)
        assert got.tolist() == want
        assert (np.diff(anchor) != 0).all() and first[0] == 0 and (first[1:] == last[:-1] + 1).all()
