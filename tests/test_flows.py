import gzip
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomaloom.functions import labels, numeric
from anomaloom.operators import classes, flows, normalization, splits, windows
from anomaloom.sources import csv_files

CELLS = {
    "1": 1.0, "1,234": 1234.0, " 5 ": 5.0, "1d": 0.0, "2F": 0.0, "0x1p3": 0.0, "Infinity": 0.0, "-inf": 0.0, "nan": 0.0,
    "NA": 0.0, "none": 0.0, "1_000": 1000.0, "1__0": 0.0, "_1": 0.0, "1_0.5e1_0": 10.5e10, "abc": 0.0, "": 0.0, "1e5": 1e5,
    "\x015": 0.0, "1_0\x01": 0.0, "1.": 1.0, ".": 0.0, ".5": 0.5, "+3": 3.0, "1e400": 0.0, "-2.5E-3": -0.0025, " ,7 ,": 7.0, "1e39": 1e39, "--1": 0.0,
}


def test_numbers(spark):
    df = spark.createDataFrame([(c,) for c in CELLS] + [(None,)], "c string")
    single = {r.c: r.x for r in df.select("c", numeric.to_float(F.col("c")).alias("x")).collect()}
    assert single == {**CELLS, None: 0.0}
    wide = df.select("c", numeric.numbers_of_cells(numeric.joined_cells([F.lit("2"), F.col("c"), F.lit(None), F.lit("x")])).alias("x"))
    assert {r.c: r.x for r in wide.collect()} == {c: [2.0, v, 0.0, 0.0] for c, v in {**CELLS, None: 0.0}.items()}


@pytest.mark.parametrize(
    ("cells", "totals", "n", "vector"),
    [
        (["1", "2"], (), 4, [1.0, 2.0, 0.0, 0.0]),
        (["1", "2", "3"], (), 2, [1.0, 2.0]),
        (["1", "1e39"], (), 2, None),
        (["1", "1e39"], (), 1, [1.0]),
        (["1"], ["2", "3", "1,000", "x"], 4, [1.0, 5.0, 1000.0, 0.0]),
        (["1", "2"], ["2", "3", "4", "5"], 3, [1.0, 2.0, 5.0]),
    ],
)
def test_vectors(spark, cells, totals, n, vector):
    extra = [F.lit(x) for x in totals]
    got = flows.with_flow_features(spark.range(1), [F.lit(c) for c in cells], extra, n)
    assert got.first().features == vector


def test_feature_names():
    assert flows.select_feature_columns(["Flow ID", " Src IP", "a", "Label", "TIMESTAMP", "b"], "Label") == ["a", "b"]
    assert flows.feature_names(["a", "b"], 6) == ["a", "b", "Flow Pkts Total", "Flow Bytes Total", "Pad Feature 1", "Pad Feature 2"]
    assert flows.feature_names(["a", "b", "c"], 2, False) == ["a", "b"]


LABELS = [
    ("Benign", "Benign", "Benign"), ("normal", "Benign", "Benign"), ("DoS attacks-Hulk", "DoS-Hulk", "DoS"),
    ("DDOS attack-HOIC", "DDoS-HOIC", "DDoS"), ("DDoS attacks-LOIC-UDP", "DDoS-LOIC-UDP", "DDoS"),
    ("DDoS attacks-LOIC-HTTP", "DDoS-LOIC-HTTP", "DDoS"), ("FTP-BruteForce", "Brute Force-FTP", "BruteForce"),
    ("SSH-Patator", "Brute Force-SSH", "BruteForce"), ("Brute Force -XSS", "Web Attack-XSS", "WebAttack"),
    ("SQL Injection", "Web Attack-SQL Injection", "WebAttack"), ("Brute Force -Web", "Web Attack-Brute Force", "WebAttack"),
    ("DoS GoldenEye", "DoS-GoldenEye", "DoS"), ("DoS slowloris", "DoS-Slowloris", "DoS"),
    ("DoS attacks-SlowHTTPTest", "DoS-SlowHTTPTest", "DoS"), ("Infilteration", "Infiltration", "Infiltration"),
    (' "Bot" ', "Botnet", "Botnet"), ("Label", None, None), ("", None, None), (None, None, None),
    ("Zeta-Storm", None, "OtherAttack"), ("DDoS", None, "OtherAttack"), ("!!", None, "OtherAttack"),
]


def test_label_schemas(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(LABELS)], "i int, raw string")

    def named(schema, force=True):
        got = {r.i: r.label for r in flows.with_canonical_label(df, "raw", "label", schema, force).collect()}
        return [got.get(i) for i in range(len(LABELS))]

    assert named("fine") == [fine for _, fine, _ in LABELS]
    assert named("family") == [family for _, _, family in LABELS]
    assert named("binary") == [None if fam is None else "Benign" if fam == "Benign" else "Anomaly" for _, _, fam in LABELS]
    assert named("fine", False)[-3:] == ["Zeta-Storm", "DDoS", "!!"]
    with pytest.raises(ValueError):
        flows.with_canonical_label(df, "raw", "label", "other")


def python_windows(rows, length, stride):
    """Windows of one file by a plain loop: (w, rows of the window, label)."""
    out = []
    for end in range(length, len(rows) + 1):
        if (end - length) % stride == 0:
            out.append(((end - length) // stride, [r[1] for r in rows[end - length : end]], rows[end - 1][2]))
    if rows and not out:
        out.append((0, [[0.0, 0.0]] * (length - len(rows)) + [r[1] for r in rows], rows[-1][2]))
    return out


def flow_files(sizes):
    rng = random.Random(9)
    return {
        f"f{n}": [(i + 1, [float(rng.randrange(100)), float(i)], rng.choice(["Benign", "Botnet"])) for i in range(n)]
        for n in sizes
    }


def numbered(spark, files):
    rows = [(f, rn, x, label) for f, body in files.items() for rn, x, label in body]
    return spark.createDataFrame(rows, "file string, rn bigint, features array<float>, label string").repartition(5)


@pytest.mark.parametrize(("length", "stride", "block"), [(4, 3, 8), (8, 2, 8), (5, 5, 1), (3, 7, 10), (6, 4, 100), (1, 1, 1)])
def test_windows_like_a_loop(spark, length, stride, block):
    files = flow_files([1, 3, 4, 7, 10, 33, 64])
    df = numbered(spark, files)
    keys = {(r.file, r.w): (r.label, r.n_rows) for r in windows.window_keys(df, length, stride).collect()}
    laid = {(r.file, r.w): r.window for r in windows.lay_out_windows(df, length, stride, block_rows=block).collect()}
    expected = {(f, w): (x, label) for f, body in files.items() for w, x, label in python_windows(body, length, stride)}
    assert {k: label for k, (label, _) in keys.items()} == {k: label for k, (_, label) in expected.items()}
    assert laid == {k: x for k, (x, _) in expected.items()}
    chosen = windows.cap_windows(windows.window_keys(df, length, stride), 5, 1)
    part = windows.lay_out_windows(df, length, stride, block_rows=block, selected=chosen)
    got = {(r.file, r.w): r.window for r in part.collect()}
    assert len(got) == min(5, len(expected)) and all(laid[k] == x for k, x in got.items())


def test_cap_is_stable_and_complete(spark):
    df = numbered(spark, flow_files([200, 50]))
    keys = windows.window_keys(df, 4, 1)
    assert windows.cap_windows(keys, None, 1).count() == windows.cap_windows(keys, 10_000, 1).count() == 244
    first = {tuple(r) for r in windows.cap_windows(keys, 30, 1).collect()}
    assert first == {tuple(r) for r in windows.cap_windows(keys.repartition(13), 30, 1).collect()} and len(first) == 30


@pytest.mark.parametrize(("length", "stride"), [(4, 3), (8, 2), (6, 4), (3, 7)])
def test_normalization_like_numpy(spark, length, stride):
    files = flow_files([2, 5, 40, 90])
    df = numbered(spark, files)
    keys = windows.window_keys(df, length, stride).where("w % 3 <> 1")
    mean, std = normalization.fitted_stats(normalization.normalization_stats(df, keys, length, stride))
    stacked = np.array([r for f, body in files.items() for w, x, _ in python_windows(body, length, stride) if w % 3 != 1 for r in x])
    assert mean == pytest.approx(stacked.mean(axis=0), rel=1e-9)
    assert std == pytest.approx(stacked.std(axis=0), rel=1e-9)
    scaled = normalization.apply_normalization(df, mean, std)
    pad = normalization.normalized_padding(mean, std)
    laid = windows.lay_out_windows(scaled, length, stride, pad=pad, selected=keys)
    for r in laid.collect():
        raw = next(x for w, x, _ in python_windows(files[r.file], length, stride) if w == r.w)
        assert np.allclose(np.array(r.window), (np.array(raw) - mean) / std, atol=1e-5)


def test_constant_feature_keeps_its_scale(spark):
    df = spark.createDataFrame([("f", i, [7.0]) for i in range(1, 9)], "file string, rn bigint, features array<float>")
    keys = windows.window_keys(df.withColumn("label", F.lit("Benign")), 4, 2)
    assert normalization.fitted_stats(normalization.normalization_stats(df, keys, 4, 2)) == ([7.0], [1.0])
    with pytest.raises(ValueError):
        normalization.fitted_stats(normalization.normalization_stats(df, keys.limit(0), 4, 2))


def test_rare_classes(spark):
    rows = spark.createDataFrame([("Benign",), ("DoS-Hulk",), ("DoS-Hulk",), ("Infiltration",)], "label string")

    def merged(n, schema="fine"):
        return Counter(r.label for r in classes.merge_rare_classes(rows, n, schema=schema).collect())

    assert merged(2) == {"Benign": 1, "DoS-Hulk": 2, "OtherAttack": 1}
    assert merged(1) == merged(9, "binary") == {"Benign": 1, "DoS-Hulk": 2, "Infiltration": 1}


def test_class_order(spark):
    rows = spark.createDataFrame([("Zeta",), ("DoS-Hulk",), ("Benign",), ("Alpha",)], "label string")

    def order(schema, force):
        return [r.class_name for r in classes.ordered_classes(rows, schema=schema, force=force).orderBy("class_index").collect()]

    assert order("fine", True) == [*labels.FINE_CLASSES, "Alpha", "Zeta"]
    assert order("fine", False) == ["Benign", "DoS-Hulk", "Alpha", "Zeta"]
    assert order("binary", False) == ["Benign", "Anomaly"]
    assert order("family", True) == list(labels.FAMILY_CLASSES)
    family = spark.createDataFrame([("WebAttack",), ("DDoS",), ("Benign",), ("Rest",)], "label string")
    got = classes.ordered_classes(family, schema="family", force=False, bucket="Rest").orderBy("class_index")
    assert [r.class_name for r in got.collect()] == ["Benign", "DDoS", "WebAttack", "Rest"]


def test_class_weights(spark):
    table = classes.class_table(spark, ["a", "b", "c"])
    rows = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    weights = classes.inverse_frequency_weights(classes.class_counts(rows, table))
    assert {r.class_name: r.weight for r in weights.collect()} == pytest.approx({"a": 5 / 9, "b": 5 / 3, "c": 5 / 3})


@pytest.mark.parametrize(
    ("n", "quota"),
    [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 1, 2)), (100, (75, 10, 15))],
)
def test_split_counts(n, quota):
    assert splits.split_counts(n) == quota


def test_split_counts_are_whole():
    for ratios in [(0.75, 0.1, 0.15), (0.2, 0.7, 0.1), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)]:
        for n in range(60):
            quota = splits.split_counts(n, ratios)
            assert sum(quota) == n and min(quota) >= 0
    assert splits.split_counts(2, (0.2, 0.7, 0.1)) == (0, 1, 1)
    with pytest.raises(ValueError):
        splits.check_ratios((0.5, 0.4, 0.2))


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_stratified_split(spark, partitions):
    sizes = {"big": 970, "mid": 20, "two": 2, "one": 1}
    rows = [(i, name) for name, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id int, y string").repartition(partitions)
    got = splits.stratified_split(df, "y", ["id"]).collect()
    assert sorted((r.id, r.y) for r in got) == sorted(rows)
    counts = Counter((r.y, r.split) for r in got)
    for name, n in sizes.items():
        assert tuple(counts[name, s] for s in ("train", "val", "test")) == splits.split_counts(n)
    assert hash(frozenset((r.id, r.y, r.split) for r in got)) == hash(
        frozenset((r.id, r.y, r.split) for r in splits.stratified_split(df.coalesce(1), "y", ["id"]).collect())
    )


def test_balanced_resample(spark, monkeypatch):
    monkeypatch.setattr(splits, "DRAWS_PER_SALT", 50)
    rows = [(i, "big") for i in range(1900)] + [(i, "small") for i in range(100)] + [(0, "tiny")]
    df = spark.createDataFrame(rows, "id int, y string")
    weights = spark.createDataFrame([("big", 1 / 1900), ("small", 1 / 100), ("tiny", 1.0), ("none", 1.0)], "y string, weight double")
    drawn = splits.balanced_resample(df, "y", ["id"], weights)
    counts = {r.y: r["count"] for r in drawn.groupBy("y").count().collect()}
    assert sum(counts.values()) == len(rows) == drawn.select("draw").distinct().count()
    assert set(counts) == {"big", "small", "tiny"}
    assert all(math.isclose(n, len(rows) / 3, rel_tol=0.15) for n in counts.values())
    assert drawn.where("y = 'small'").select("id").distinct().count() > 95


def test_parameter_checks(spark):
    with pytest.raises(ValueError):
        windows.check_window_shape(0, 1)
    with pytest.raises(ValueError):
        windows.check_window_shape(1, 0)
    with pytest.raises(ValueError):
        classes.merge_rare_classes(spark.range(1), -1)


def test_many_files_three_headers_and_line_breaks(spark, tmp_path):
    """One job for all headers; a quoted line break as an option; a separator byte in a cell."""
    for i in range(60):
        header = ["a,b,Label", "b,a,Label", "a,c,Label"][i % 3]
        (tmp_path / f"f{i:02}.csv").write_text(f"{header}\n{i},{i + 100},Benign\n")
    table = csv_files.read_flow_csvs(spark, str(tmp_path), target_count=2, add_totals=False)
    got = sorted(tuple(r.features) for r in table.rows.collect())
    assert got == sorted((float(i), i + 100.0) if i % 3 == 0 else (i + 100.0, float(i)) if i % 3 == 1 else (float(i), 0.0) for i in range(60))
    assert [len(paths) for _, paths in csv_files.distinct_headers(spark, str(tmp_path))] == [20, 20, 20]
    assert csv_files.read_flow_csvs(spark, str(tmp_path), 2, 2, False).rows.count() == 2
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "x.csv").write_text('a,note,Label\n1,"two\nlines",Benign\n2\x013,5,Benign\n')
    rows = csv_files.read_flow_csvs(spark, str(odd), target_count=2, add_totals=False, multi_line=True).rows.collect()
    assert sorted(tuple(r.features) for r in rows) == [(0.0, 5.0), (1.0, 0.0)]


def test_heads_of_files(spark, tmp_path, monkeypatch):
    """Headers of empty, headless, compressed and long files, by first bytes and by a scan alike."""
    texts = {
        "a": "\ufeffa,b,Label\r\n1,2,Benign\r\n", "b": "", "c": "\n1,2,Benign\n", "d": "a,b,Label", "e": "x,b,Label\r1,2,Benign",
        "f": "n" * 100_000 + ",Label\n1,Benign\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(b"a,b,Label\n1,2,Benign\n"))
    expected = [
        (("a", "b", "Label"), ["a.csv", "d.csv", "g.csv.gz"]),
        (("x", "b", "Label"), ["e.csv"]),
        (("n" * 100_000, "Label"), ["f.csv"]),
    ]

    def found():
        headers = csv_files.distinct_headers(spark, str(tmp_path), pattern="*.csv*")
        return sorted((header, [path.rsplit("/", 1)[1] for path in paths]) for header, paths in headers)

    assert found() == sorted(expected)
    assert csv_files.first_line(str(tmp_path / "f.csv"), piece=7) == "n" * 100_000 + ",Label"
    monkeypatch.setattr(csv_files, "_opens", lambda path: False)
    assert found() == sorted(expected)


def test_cells_of_windows_are_counted_before_they_are_shipped(spark):
    keys = [(f"f{f}", w, 8) for f in range(3) for w in range(700) if (w * 7 + f) % 3]
    df = spark.createDataFrame(keys, "file string, w bigint, n_rows bigint")
    times, g = normalization.row_multiplicity(df, 8, 2)
    expected = {}
    for file, w, _ in keys:
        for cell in range(w, w + 4):
            expected[file, cell] = expected.get((file, cell), 0) + 1
    assert g == 2 and {(r.file, r["__cell"]): r["__times"] for r in times.collect()} == expected
    plan = times._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan.split("RepartitionByExpression")[0].split("REPARTITION_BY_COL")[0] and "REPARTITION_BY_COL" in plan


def test_row_cap_query_packs_the_files_of_suppliers(spark, tmp_path):
    from pathlib import Path

    from anomaloom.plans.catalog import QUERIES
    from anomaloom.session import shared_folder

    rows = [(o, o % 9, None if o % 50 == 0 else o % 40, o % 7) for o in range(6000)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")
    df = df.withColumn("l_shipdate", F.to_timestamp(F.lit("2024-01-01"))).withColumn("l_partkey", F.when(F.col("l_partkey") > 0, F.col("l_partkey")))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = QUERIES["row_cap_per_file"](spark, str(tmp_path)).collect()
    files = {}
    for order, part, supplier, line in sorted(rows):
        files.setdefault(supplier, []).append((supplier, order, line, part or None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        str((s, o, n, p)) for of in files.values() for s, o, n, p in of[:100]
    )
    written = [p for f in set(folder.iterdir()) - before for p in f.rglob("part-*")]
    assert 0 < len(written) < len(files)
