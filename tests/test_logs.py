import random

import pytest
from pyspark.sql import functions as F

from anomaloom.functions import labels, text
from anomaloom.operators import events, vocab
from anomaloom.sources import columns, csv_files, datasets, logs


def test_explicit_ids_and_templates(spark):
    lines = spark.createDataFrame(
        [
            (0, "12:00:01 worker start, event_id=E5"),
            (1, "x E26 and e11, not pre5 E7x or éE8"),
            (2, "namenode says allocate blk_9001 now"),
            (3, "node seven is receiving block nine"),
            (4, "found a corrupt replica of block nine"),
            (5, "nothing known"),
            (6, None),
        ],
        "id int, line string",
    )
    got = [(r.id, r.event) for r in events.extract_events(lines).orderBy("id", "event_pos").collect()]
    assert got == [(0, "e5"), (1, "e26"), (1, "e11"), (2, "e5"), (3, "e26"), (4, "e24")]
    assert tuple(events.extraction_stats(lines).first()) == (3, 3, 2)


@pytest.mark.parametrize("mark", ["", " é"])
def test_templates_in_any_case(spark, mark):
    """Both the substring search (ASCII) and the plain patterns; the first template wins."""
    samples = {
        "BLOCK* Allocate \t blk_1": "e5", "allocateblk_1": None, "RECEIVING  BLOCK": "e26", "PacketResponder 1 Success": "e11",
        "success PacketResponder": None, "completeFile": "e9", "addStoredBlock": "e21", "State Change to ACTIVE": "e23",
        "state change": None, "writeBlock": "e22", "Finalized Block": "e3", "Slow BlockReceiver": "e1", "Checksum Mismatch": "e17",
        "Failed to write packet": "e19", "Broken Pipe": "e19", "InvalidateBlocks": "e24", "Corrupt Replica": "e24",
        "missing 12 Replicas": "e29", "missing x replicas": None, "Replicate blk_3 now to node": "e13", "replicate blk_3to x": None,
        "writeBlock after completeFile": "e9",
    }
    df = spark.createDataFrame([(k + mark, k) for k in samples], "line string, k string")
    got = {r.k: r.event for r in events.extract_events(df).collect()}
    assert got == {k: e for k, e in samples.items() if e}


def test_extraction_stats_without_lines(spark):
    empty = spark.createDataFrame([], "line string")
    assert tuple(events.extraction_stats(empty).first()) == (0, 0, 0)


@pytest.mark.parametrize("value", ["a\nb\r\nc\rd", "a\n", "", "\n", "a\x0bb\x1cc d\x85e", "a\n\nb\n\n", "x"])
def test_split_lines_like_python(spark, value):
    got = spark.range(1).select(text.split_lines(F.lit(value))).first()[0]
    assert got == value.splitlines()


def test_lines_from_text(spark):
    df = spark.createDataFrame([(1, "a\nb\n", ["p", "q"])], "id int, t string, l array<string>")
    assert [(r.line_no, r.line) for r in logs.lines_from_text(df.select("id", "t"), "t").collect()] == [(0, "a"), (1, "b")]
    assert [(r.line_no, r.line) for r in logs.lines_from_text(df.select("id", "l"), "l").collect()] == [(0, "p"), (1, "q")]


def test_block_id_and_label_words(spark):
    words = [' "blk_1" ', "''x'", None, " y ", "\"'z'\""]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(text.normalize_block_id(F.col("w"))).collect()]
    assert got == ["blk_1", "x", "", "y", "z"]
    spelled = ["Normal", "0", "FALSE", "no", "Benign", "Anomaly", "anomalous", "1", "True", "yes", "'attack'", "2", "", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(spelled)], "i int, w string")
    got = [r[0] for r in df.orderBy("i").select(labels.parse_binary_label(F.col("w"))).collect()]
    assert got == [0] * 5 + [1] * 6 + [None] * 3


def test_tokenize(spark):
    got = spark.range(1).select(text.tokenize_sequence(F.lit("[E5,E26] blk_-1/a:B.c é"))).first()[0]
    assert got == ["e5", "e26", "blk_-1/a:b.c"]


def test_resolve_column():
    assert columns.resolve_column(["x", " blockid "], columns.BLOCK_COLUMNS) == " blockid "
    assert columns.resolve_column(["Features", "Events"], columns.SEQUENCE_COLUMNS) == "Events"
    assert columns.resolve_column(["LABEL", "label "], ("Label",)) == "label "
    assert columns.resolve_column(["x"], ("y",)) is None


def test_trace_and_label_files(spark, tmp_path):
    traces = tmp_path / "traces.csv"
    traces.write_text('BlockId,EventSequence\n"blk_1","[E5,E6]"\nblk_2,\n,E5\nblk_1,"E7 E8"\n blk_3 ,e1\n')
    got = {r.block_id: r.tokens for r in csv_files.read_event_traces(spark, str(traces)).collect()}
    assert got == {"blk_1": ["e7", "e8"], "blk_3": ["e1"]}
    marks = tmp_path / "labels.csv"
    marks.write_text("blk_id,class\nblk_1,Normal\nblk_3,maybe\nblk_1,Anomaly\nblk_9,0\n")
    got = {r.block_id: r.label for r in csv_files.read_block_labels(spark, str(marks)).collect()}
    assert got == {"blk_1": 1, "blk_9": 0}
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(KeyError):
        csv_files.read_event_traces(spark, str(bad))


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(5)
    rows = [(i, [f"t{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randrange(0, 30))]) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id int, tokens array<string>")


def expected_vocab(rows, size, least):
    counts, first = {}, {}
    for i, tokens in rows:
        for at, token in enumerate(tokens):
            counts[token] = counts.get(token, 0) + 1
            first.setdefault(token, (i, at))
    ranked = sorted((t for t in counts if counts[t] >= least), key=lambda t: (-counts[t], first[t]))
    return {"<PAD>": 0, "<UNK>": 1} | {t: i + 2 for i, t in enumerate(ranked[: size - 2])}


@pytest.mark.parametrize(("size", "least"), [(8192, 2), (10, 2), (8192, 30), (2, 1), (30, 1)])
def test_vocab(spark, sequences, size, least):
    rows, df = sequences
    built = vocab.build_vocab(df.repartition(7), ["id"], max_vocab=size, min_frequency=least)
    assert {r.token: r.token_id for r in built.collect()} == expected_vocab(rows, size, least)


@pytest.mark.parametrize("entries", [20_000, 0])
@pytest.mark.parametrize("unk", [1, 7])
def test_encode_and_unknown(spark, sequences, entries, unk):
    """The expression and the join: equal ids, null arrays stay null, equal rows stay apart."""
    rows, _ = sequences
    rows = rows[:60] + [(500, None), (501, []), (502, ["t1", "zz"]), (502, ["t1", "zz"]), (502, ["yy"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    known = expected_vocab([row for row in rows if row[1]], 12, 2) | {"<UNK>": unk}
    table = spark.createDataFrame(list(known.items()), "token string, token_id int")
    encoded = vocab.encode_tokens(df, table, 9, literal_entries=entries).collect()
    marked = vocab.unknown_tokens(df, table, literal_entries=entries).collect()
    wanted_ids, wanted_marks = [], []
    for i, tokens in rows:
        if tokens is None:
            wanted_ids.append((i, None))
            wanted_marks.append((i, None, None, None, None, None))
            continue
        ids = [known.get(t, unk) for t in tokens][-9:]
        wanted_ids.append((i, [0] * (9 - len(ids)) + ids))
        unknown = [t for t in tokens if t not in known]
        wanted_marks.append((i, len(tokens), len(tokens) - len(unknown), len(unknown), unknown[:20], tokens[-20:]))
    assert sorted(str((r.id, r.token_ids)) for r in encoded) == sorted(map(str, wanted_ids))
    got = [
        (r.id, r.event_token_count, r.known_event_count, r.unknown_event_count, r.unknown_event_tokens, r.event_tokens_tail)
        for r in marked
    ]
    assert sorted(map(str, got)) == sorted(map(str, wanted_marks))


def test_parse_vocab(spark):
    df = spark.createDataFrame([('{"<UNK>": 7, "e5": "2", "e6": "x", "e7": 1.5}',)], "v string")
    assert {r.token: r.token_id for r in datasets.parse_vocab(df, "v").collect()} == {"<PAD>": 0, "<UNK>": 7, "e5": 2}


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_assemble_hot_key(spark, partitions):
    """One key holds most rows; several buckets and chunks; any partitioning."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(20)}", rng.randrange(50), i, f"e{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t int, i int, event string").repartition(partitions)
    chunks = events.assemble_sequences(df, ["k"], [F.col("t"), F.col("i")], chunk=100, rows_per_bucket=60)
    got = {}
    for r in chunks.orderBy("k", "chunk_no").collect():
        assert len(r.tokens) <= 100
        got.setdefault(r.k, []).extend(r.tokens)
    expected = {}
    for k, _, _, e in sorted(rows, key=lambda r: r[:3]):
        expected.setdefault(k, []).append(e)
    assert got == expected
    tails = events.sequence_tails(df, ["k"], [F.col("t"), F.col("i")], 10, salt=4)
    assert {r.k: (r.tail, r.event_count) for r in tails.collect()} == {k: (v[-10:], len(v)) for k, v in expected.items()}


def test_first_places_need_no_sort(spark):
    rows = [(5, ["a", "b"]), (-7, ["c", "a", "a"]), (None, ["x", "b"]), (2**63 - 1, ["z", "z"]), (-(2**63), ["w", "z"])]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    wanted = spark.createDataFrame([(t,) for t in "abczw"], "token string")
    found = vocab.first_places(df, ["id"], wanted)
    assert [r.token for r in found.orderBy("first_at").collect()] == ["b", "w", "z", "c", "a"]
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["id", "name"])
@pytest.mark.parametrize("entries", [20_000, 0])
def test_first_places_ship_no_single_tokens(spark, key, entries):
    """However large Spark takes the wanted tokens to be, tokens meet only once combined in the tasks."""
    rows = [(5, "e", ["a", "b", None]), (-7, "A", ["c", "a", "a"]), (None, None, ["x", "b"]), (9, "z", ["z", "z"]), (10, "zz", None)]
    df = spark.createDataFrame(rows, "id bigint, name string, tokens array<string>")
    wanted = spark.createDataFrame([(t,) for t in "abcz"] + [("absent",)], "token string").repartition(3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vocab.first_places(df, [key], wanted, entries=entries)
        assert [r.token for r in found.orderBy("first_at").collect()] == ["b", "c", "a", "z"]
        steps = found._jdf.queryExecution().executedPlan().toString().split("Generate posexplode")[0].splitlines()
        exchange = max(i for i, line in enumerate(steps) if "Exchange hashpartitioning" in line)
        assert "partial_min" in "".join(steps[exchange + 1 :])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_joined_encoding_ships_no_tails(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, tokens array<string>")
    table = spark.createDataFrame([("<UNK>", 1), ("a", 2)], "token string, token_id int")
    encoded = vocab.encode_tokens(df, table, 3, literal_entries=0)
    assert sorted(map(tuple, encoded.select("id", "token_ids").collect())) == [(1, [0, 2, 1]), (2, None)]
    plan = encoded.select("id", "token_ids")._jdf.queryExecution().optimizedPlan().toString()
    assert "__tail" not in plan.split("Join LeftOuter")[0]
