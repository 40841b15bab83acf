"""End-to-end jobs on small files."""

import csv
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomaloom.operators import models
from anomaloom.operators.vocab import build_vocab
from anomaloom.plans.block_dataset import prepare_block_dataset
from anomaloom.plans.flow_dataset import prepare_flow_dataset
from anomaloom.plans.log_analysis import analyze_lines, analyze_sequences, rejected_keys
from anomaloom.sources import csv_files, datasets
from anomaloom.streaming.incidents import stream_incidents, write_alerts_stream

ATTACKS = ["Benign", "BENIGN", "DoS attacks-Hulk", "Bot", "Label", "Oddity"]


def write_flows(folder):
    """Three files: two headers, one of the files short."""
    rng = random.Random(4)
    first = ["Flow ID", "Tot Fwd Pkts", "Speed", "Tot Bwd Pkts", "Label"]
    second = ["Label", "Tot Bwd Pkts", "Tot Fwd Pkts", "Extra"]
    rows = {}
    for name, header, n in [("a.csv", first, 120), ("b.csv", second, 60), ("c.csv", first, 5)]:
        rows[name] = []
        with (folder / name).open("w", newline="") as handle:
            out = csv.writer(handle)
            out.writerow(header)
            for _ in range(n):
                fwd, bwd, speed, label = rng.randrange(50), rng.randrange(9), rng.choice(["1,5", "NaN", "2.5"]), rng.choice(ATTACKS)
                cell = {"Flow ID": "x", "Tot Fwd Pkts": fwd, "Speed": speed, "Tot Bwd Pkts": bwd, "Label": label, "Extra": 9}
                out.writerow([cell[h] for h in header])
                number = {"1,5": 15.0, "NaN": 0.0, "2.5": 2.5}[speed] if header is first else 0.0
                if label not in ("Label", "Oddity"):
                    kind = {"Bot": "Botnet", "DoS attacks-Hulk": "DoS-Hulk"}.get(label, "Benign")
                    rows[name].append(([float(fwd), number, float(bwd), float(fwd + bwd), 0.0, 0.0], kind))
    (folder / "d.csv").write_text("")
    (folder / "ignored.txt").write_text("x")
    return rows


def test_flow_files_with_two_headers(spark, tmp_path):
    write_flows(tmp_path)
    table = csv_files.read_flow_csvs(spark, str(tmp_path), target_count=6)
    assert table.feature_names == ["Tot Fwd Pkts", "Speed", "Tot Bwd Pkts", "Flow Pkts Total", "Flow Bytes Total", "Pad Feature 1"]
    assert table.rows.count() == 185
    assert csv_files.read_flow_csvs(spark, str(tmp_path), max_files=1, target_count=6).rows.count() == 120
    (tmp_path / "e.csv").write_text("a,b\n1,2\n")
    with pytest.raises(KeyError):
        csv_files.read_flow_csvs(spark, str(tmp_path))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        csv_files.read_flow_csvs(spark, str(empty))


def expected_windows(rows, length, stride):
    out = {}
    for name, body in rows.items():
        ends = [e for e in range(length, len(body) + 1) if (e - length) % stride == 0]
        for e in ends:
            out[name, (e - length) // stride] = ([x for x, _ in body[e - length : e]], body[e - 1][1])
        if body and not ends:
            out[name, 0] = ([[0.0] * 6] * (length - len(body)) + [x for x, _ in body], body[-1][1])
    return out


def test_flow_dataset(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    expected = expected_windows(write_flows(source), 8, 3)
    made = prepare_flow_dataset(spark, str(source), out, length=8, stride=3, feature_count=6, max_windows=None)
    names = {r.class_index: r.class_name for r in made.classes.collect()}
    rows = {(r.file.rsplit("/", 1)[1], r.w): r for r in made.rows.collect()}
    assert {k: names[r.y] for k, r in rows.items()} == {k: label for k, (_, label) in expected.items()}
    train = np.array([x for k, (x, _) in expected.items() if rows[k].split == "train"])
    mean, std = train.reshape(-1, 6).mean(axis=0), train.reshape(-1, 6).std(axis=0)
    std = np.where(std < 1e-6, 1.0, std)
    stats = made.stats.first()
    assert stats.mean == pytest.approx(mean, abs=1e-9) and stats.std == pytest.approx(std, abs=1e-9)
    for k, (x, _) in expected.items():
        assert np.allclose(np.array(rows[k].X), (np.array(x) - mean) / std, atol=1e-4)
    counted = made.summary.groupBy("split").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in counted) == len(expected)
    capped = prepare_flow_dataset(
        spark, str(source), str(tmp_path / "out2"), length=8, stride=3, feature_count=6, max_windows=12,
        max_rows_per_file=50, schema="binary",
    )
    assert capped.rows.count() == 12
    assert [r.class_name for r in capped.classes.orderBy("class_index").collect()] == ["Benign", "Anomaly"]


def test_block_dataset(spark, tmp_path):
    rng = random.Random(2)
    blocks = {f"blk_{i}": [f"E{rng.randrange(1, 12)}" for _ in range(rng.randrange(1, 20))] for i in range(80)}
    marks = {b: rng.choice(["Normal", "Anomaly"]) for b in list(blocks)[:70]}
    (tmp_path / "t.csv").write_text("BlockId,EventSequence\n" + "".join(f'{b},"[{",".join(t)}]"\n' for b, t in blocks.items()))
    (tmp_path / "l.csv").write_text("BlockId,Label\n" + "".join(f"{b},{m}\n" for b, m in marks.items()))
    made = prepare_block_dataset(spark, str(tmp_path / "t.csv"), str(tmp_path / "l.csv"), str(tmp_path / "out"), 12)
    ids = {r.token: r.token_id for r in made.vocab.collect()}
    rows = made.rows.collect()
    assert {r.block_id for r in rows} == set(marks)
    for r in rows:
        tokens = [ids.get(t.lower(), 1) for t in blocks[r.block_id]][-12:]
        assert r.X == [0] * (12 - len(tokens)) + tokens and r.y == (marks[r.block_id] == "Anomaly")
    part = datasets.load_split(spark.read.parquet(str(tmp_path / "out" / "data")), "val")
    assert part.count() == made.summary.where("split = 'val'").first().split_size
    assert "PartitionFilters: [isnotnull(split" in part._jdf.queryExecution().toString()
    with pytest.raises(KeyError):
        datasets.load_split(made.rows, "nope")


def test_reader_aliases(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], [3])], "features array<int>, labels array<int>")
    df.write.parquet(str(tmp_path / "d"))
    assert datasets.read_dataset(spark, str(tmp_path / "d")).first().asDict() == {"X": [1, 2], "y": 3}
    df.select("features").write.parquet(str(tmp_path / "e"))
    with pytest.raises(KeyError):
        datasets.read_dataset(spark, str(tmp_path / "e"))


def test_vocab_file_and_report(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{\n "vocab_size": 3,\n "vocab": {"<PAD>": 0, "<UNK>": 1, "e5": 2}\n}')
    assert datasets.read_vocab(spark, str(tmp_path / "cache.json")).count() == 3
    (tmp_path / "report.json").write_text('{\n "best_epoch": 3,\n "metrics": {"val": {"accuracy": 0.5}}\n}')
    row = datasets.read_metrics_report(spark, str(tmp_path / "report.json"), pretty=True).first()
    assert row.metrics.val.accuracy == 0.5


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, i % 2, (["e22", "e24"] if i % 2 else ["e1", "e2"]) * (1 + i % 3)) for i in range(40)]
    train = spark.createDataFrame(rows, "id int, y int, tokens array<string>")
    return build_vocab(train, ["id"]), models.fit_classifier(train, stages=models.sequence_features(buckets=64), maxIter=20)


def test_analysis_of_lines_and_sequences(spark, model):
    vocab, fitted = model
    lines = [("a", 1, "x E22"), ("a", 2, "E24 and E22"), ("a", 3, "odd"), ("b", 1, "E1 E2"), ("b", 2, "e77"), ("c", 1, "none")]
    df = spark.createDataFrame(lines, "source string, line_no int, line string")
    records = analyze_lines(df, ["source"], ["line_no"], vocab, fitted, ["Normal", "Anomaly"])
    got = {r.response.event_name: r.response for r in records.collect()}
    assert set(got) == {"a", "b"}
    assert [tuple(r) for r in rejected_keys(df, ["source"]).collect()] == [("c", 1)]
    assert got["a"].input.source_value == "3 line(s)" and got["a"].metadata.sequence_length == 128
    assert got["a"].anomaly_detected and got["a"].anomaly_type == "Node_Failure"
    assert got["a"].metadata.unmatched_log_lines == 1 and got["a"].metadata.event_tokens_from_event_id == 3
    assert not got["b"].anomaly_detected and got["b"].anomaly_type == "Normal"
    assert got["b"].metadata.unknown_event_tokens == ["e77"] and got["b"].input.event_tokens_tail == ["e1", "e2", "e77"]
    assert got["b"].reason.startswith("Current signal pattern")
    whole = spark.createDataFrame([("a", ["e22", "e24", "e22"])], "event_name string, tokens array<string>")
    one = analyze_sequences(whole, vocab, fitted, ["Normal", "Anomaly"]).first().response
    assert (one.anomaly_type, one.confidence) == ("Node_Failure", pytest.approx(got["a"].confidence))


def test_counts_cover_events_beyond_the_model(spark, model):
    """300 events, the first 100 unknown; the model reads 128."""
    vocab, fitted = model
    lines = [("k", i, f"E{900 + i}" if i < 100 else "E22") for i in range(300)]
    df = spark.createDataFrame(lines, "source string, line_no int, line string").repartition(5)
    got = analyze_lines(df, ["source"], ["line_no"], vocab, fitted, ["Normal", "Anomaly"]).first()
    meta = got.response.metadata
    assert got.response.input.event_token_count == 300 and len(got.incident.event_names) == 128
    assert (meta.known_event_count, meta.unknown_event_count) == (200, 100)
    assert meta.unknown_event_tokens == [f"e{900 + i}" for i in range(20)]
    assert got.response.input.event_tokens_tail == ["e22"] * 20


def test_stream_equals_batch(spark, tmp_path):
    """Events in several files, out of order within the watermark; a session and a fixed window."""
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(4)}", 1_700_000_000 + 30 * i + rng.randrange(60), f"E{rng.randrange(1, 29)}") for i in range(400)]
    rows.append(("end", 1_700_000_000 + 10**6, "E1"))
    schema = "key string, s bigint, event string"
    inbox = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartitionByRange(4, "s").write.parquet(inbox)

    def timed(df):
        return df.withColumn("ts", F.timestamp_seconds("s"))

    for name, window in (("fixed", F.window("ts", "10 minutes")), ("session", F.session_window("ts", "3 minutes"))):
        batch = stream_incidents(timed(spark.read.parquet(inbox)), ["key"], "ts", "1 hour", window)
        stream = stream_incidents(timed(spark.readStream.schema(schema).parquet(inbox)), ["key"], "ts", "1 hour", window)
        out = str(tmp_path / name)
        write_alerts_stream(stream, "key", out, str(tmp_path / f"{name}-progress")).awaitTermination()

        def seen(df):
            return sorted((r.block_id, r.anomaly_type, r.severity, r.confidence) for r in df.collect())

        closed = batch.where("key <> 'end'").withColumnRenamed("key", "block_id")
        assert seen(spark.read.json(out)) == seen(closed)


def test_rows_behind_the_watermark_do_not_reopen_a_session(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a", "E5", 0), ("a", "E5", 60)],
        [("b", "E16", 10_000), ("a", "E5", 10_030)],
        [("b", "E16", 10_050)],  # closes the first session; a row counts as late from the next batch on
        [("a", "E24", 30), ("b", "E16", 10_100), ("end", "E1", 20_000)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "key string, event string, s long").coalesce(1).write.mode("append").parquet(inbox)
        time.sleep(1.1)  # files arrive in the order of their times
    lines = spark.readStream.schema("key string, event string, s long").option("maxFilesPerTrigger", 1).parquet(inbox)
    events = lines.withColumn("ts", F.timestamp_seconds("s"))
    stream = stream_incidents(events, ["key"], "ts", "10 minutes", F.session_window("ts", "3 minutes"))
    write_alerts_stream(stream, "key", out, str(tmp_path / "progress")).awaitTermination()
    on_time = [row for rows in batches for row in rows if row[0] != "end" and row[1] != "E24"]
    timed = spark.createDataFrame(on_time, "key string, event string, s long").withColumn("ts", F.timestamp_seconds("s"))
    wanted = stream_incidents(timed, ["key"], "ts", "10 minutes", F.session_window("ts", "3 minutes"))

    def seen(df, key):
        start, end = (F.col(f"window_{side}").cast("timestamp").cast("long") for side in ("start", "end"))
        return sorted(tuple(r) for r in df.select(key, start, end, "anomaly_type", "severity").collect())

    got = seen(spark.read.json(out), "block_id")
    assert got == seen(wanted, "key") and [row[:3] for row in got] == [("a", 0, 240), ("a", 10_030, 10_210), ("b", 10_000, 10_280)]
