"""Token ids, packing, token files and vector search: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anomaloom.llm.hashing import texts_of
from anomaloom.llm.multi_index import Codes, MultiIndex, learn_codes, nearest, substring_flips
from anomaloom.llm.packing import cut_windows, last_windows, pack
from anomaloom.llm.queries import tokenizer_file
from anomaloom.llm.token_files import KeyIndex, look_up, read_token_files, write_token_files
from anomaloom.llm.tokens import TokenIds
from odd import frame, odd_rows, unnamed_rows, words

STRINGS = [
    "a  b\n\nc \t d  \n", "  lead", "trail  ", "", " ", "\n", "don't we'll 's x's", "hi  <|endoftext|> b  <|startoftext|>",
    "nb sp wide　x", "Ünï cödé 12 3a4 ΑΣ Σ", "a\x1cb \x1f c\x85d", "é café", "x" * 3000, "日本語 テキスト。",
    "12345 6.7", "İstanbul DŽ", "“quote” — dash…", "a\r\nb\x0b\x0cc", "don''t ''s .'s", "ß ſ K",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizer(name):
    coder = TokenIds(tokenizer_file(name))
    rng = random.Random(5)
    alphabet = "ab Z'.,\n\t 1é 日-<|>s"
    texts = STRINGS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for _ in range(2):
        for part in texts_of(pa.array([t.encode() for t in texts], pa.binary()), 200):
            ids, bounds = coder.encode(part)
            for i in range(len(part)):
                whole = coder.tokenizer.encode(texts[part.first + i], add_special_tokens=False).ids
                assert ids[bounds[i] : bounds[i + 1]].tolist() == whole, texts[part.first + i]


def encoded(name, text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name)).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def many_rows():
    return odd_rows() + [(300 + i, " ".join(words(50 + i * 7, i)) + ". Next one! " + " ".join(words(9, i))) for i in range(60)]


def test_packing_round_trip(spark):
    rows = many_rows()
    got = pack(frame(spark, rows), tokenizer_file("word_bpe_49k.json"), with_ids=True).collect()
    texts = dict(rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.row_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = encoded("word_bpe_49k.json", texts[i], 1)
        place = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(ids)
            part = ids[place : place + r.length]
            assert np.frombuffer(r.ids, "<u4").tolist() == part and r.ids_crc32 == crc(part)
            place += r.length
        assert place == len(ids)
    for pieces in by_sequence.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place and r.length > 0
            place += r.length
        assert place <= 2048


def test_packing_of_few_or_no_rows(spark):
    path = tokenizer_file("word_bpe_49k.json")
    assert pack(frame(spark, []), path).collect() == []
    got = pack(frame(spark, [(1, None), (None, "")]).coalesce(1), path).collect()
    assert sorted((r.length, r.offset) for r in got) == [(1, 0), (1, 1)]
    assert sum(r.length for r in pack(frame(spark, unnamed_rows()), path).collect()) > 6


def test_cuts_are_of_least_cost():
    rng = random.Random(2)
    for _ in range(200):
        ends = np.cumsum([rng.randrange(1, 8) for _ in range(rng.randrange(1, 14))])
        costs = np.array([rng.randrange(0, 9) for _ in ends])
        best = {0: 0}
        for i, end in enumerate(ends.tolist()):
            best[end] = min(c + 10 - (end - p) + costs[i] for p, c in best.items() if end - p <= 10)
        cuts = cut_windows(ends, costs, 10)
        total, place = 0, 0
        for cut in cuts:
            assert ends[cut] - place <= 10
            total += 10 - (ends[cut] - place) + costs[cut]
            place = ends[cut]
        assert total == best[ends[-1]] and place == ends[-1]


def test_last_windows():
    assert last_windows(2048, 2048) == [2048] and last_windows(1024, 2048) == [1024]
    assert last_windows(1025, 2048) == [1024, 1] and last_windows(2047, 2048) == [2047]
    assert all(sum(last_windows(n, 2048)) == n for n in range(1, 2049))


def test_token_files_round_trip(spark, tmp_path):
    rows = many_rows()
    folder, path = f"{tmp_path}/files", tokenizer_file("byte_bpe_50k.json")
    write_token_files(frame(spark, rows), folder, path, shard_ids=500)
    got = {r.row_id: r for r in read_token_files(spark, folder, with_ids=True).collect()}
    place = 0
    for i, text in sorted(rows):
        ids = encoded("byte_bpe_50k.json", text, 0)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (place, len(ids), crc(ids))
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        place += len(ids)
    asked = spark.createDataFrame([(1,), (300,), (341,), (299,), (-5,), (None,)], "key long")
    found = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in look_up(spark, folder, asked).collect()}
    assert set(found) == {1, 300, 341}
    assert found[341] == encoded("byte_bpe_50k.json", dict(rows)[341], 0)


def test_token_files_of_odd_keys(spark, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    write_token_files(frame(spark, unnamed_rows()), f"{tmp_path}/odd", path)
    got = read_token_files(spark, f"{tmp_path}/odd").collect()
    assert sorted((str(r.row_id) for r in got)) == ["1", "2", "2", "3", "None", "None"]
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == 6
    write_token_files(frame(spark, []), f"{tmp_path}/none", path)
    assert read_token_files(spark, f"{tmp_path}/none").collect() == []


def test_key_index():
    rng = np.random.default_rng(1)
    for count in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(-(2**62), 2**62, count))
        index = KeyIndex.build(keys, np.arange(len(keys)) * 3)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
        assert (index.find(keys) == np.arange(len(keys)) * 3).all()
        others = rng.integers(-(2**62), 2**62, 2000)
        assert (index.find(others) >= 0).mean() < 0.01


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(7)
    words_ = rng.integers(0, 2**63, (3000, 1), dtype=np.uint64)
    near = words_[:200].copy()
    for bit in range(6):
        near ^= np.uint64(1) << rng.integers(0, 64, near.shape).astype(np.uint64)
    index = MultiIndex(np.concatenate([words_, near]))
    for i in range(40):
        for radius in (0, 3, 7):
            far = np.bitwise_count(index.words ^ words_[i]).sum(axis=1)
            assert index.within(words_[i], radius).tolist() == np.flatnonzero(far <= radius).tolist()
    assert len(substring_flips(2)) == 1 + 16 + 120


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    data = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1200)]
    data += [(2000 + i, data[0][1]) for i in range(30)]
    odd = [(3000, None), (3100, [0.0] * 16), (3200, [None] + [1.0] * 15), (3300, [float("inf")] * 16), (None, data[0][1])]
    odd += [(3400, [1.0, 0.0]), (3401, [0.0, 3.0]), (3402, [1.0, 0.5])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS row_id", "1 AS vector")
    got = nearest(df, F.col("vec_id") % 100 == 0, neighbours=10).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.row_id, r.score))
    # Vectors of another size have neighbours of their own size.
    assert [(rank, row) for rank, row, _ in sorted(found.pop(3400))] == [(1, 3402), (2, 3401)]
    x = np.array([v for _, v in data], dtype=np.float64)
    ids = np.array([i for i, _ in data])
    hits = 0
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert sorted(found) == sorted(asked)
    for q in asked:
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        for _, row, score in rows:
            assert row != q and score == pytest.approx(far[ids == row][0], rel=1e-12, abs=1e-12)
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        hits += len({int(i) for i in ids[order]} & {r[1] for r in rows})
    assert hits / (10 * len(asked)) >= 0.9


def test_nearest_by_blocks_of_queries(spark):
    """Several blocks find what one finds."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, parts = (nearest(df, F.col("vec_id") % 3 == 0, query_block=size).collect() for size in (1000, 30))
    assert len(whole) == 1000 and sorted(whole) == sorted(parts)


def test_nearest_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    got = nearest(few, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.row_id) for r in got] == [(1, 2), (2, 1)]
    assert isinstance(learn_codes(np.zeros((0, 2)), 10), Codes)
