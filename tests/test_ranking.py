"""Ranks and prefix sums against plain Python, with heavy ties and forced small buckets."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from anomaloom.operators import evaluation, ranking
from anomaloom.operators.ranking import row_number_in_order


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(2000):
        group = "hot" if rng.random() < 0.7 else rng.choice("abc")
        # A third of all rows share one value of the first sort column.
        value = 0.5 if rng.random() < 0.4 else round(rng.random(), 2)
        out.append((group, value, i))
    return out


@pytest.mark.parametrize("partitions", [1, 16])
@pytest.mark.parametrize("size", [20, 150, 10_000])
def test_row_number(spark, rows, size, partitions):
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(partitions)
    ranked = ranking.row_number_in_order(df, ["g"], [F.col("v"), F.col("i")], "rn", rows_per_bucket=size)
    expected, counts = {}, {}
    for group, value, i in sorted(rows):
        counts[group] = counts.get(group, 0) + 1
        expected[i] = counts[group]
    assert {r.i: r.rn for r in ranked.collect()} == expected
    capped = ranking.row_number_in_order(df, ["g"], [F.col("v"), F.col("i")], "rn", at_most=37, rows_per_bucket=size)
    assert {r.i: r.rn for r in capped.collect()} == {i: n for i, n in expected.items() if n <= 37}


def test_hot_value_is_cut_by_the_next_column(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, i int")
    cut, buckets = ranking.ordered_buckets(df, [F.col("v"), F.col("i")], rows_per_bucket=50)
    assert len(buckets) == 2
    largest = cut.groupBy(*buckets).count().agg(F.max("count")).first()[0]
    assert largest < 200


@pytest.mark.parametrize("size", [40, 10_000])
def test_prefix_sums(spark, rows, size):
    df = spark.createDataFrame(rows, "g string, v double, i int").withColumn("one", F.lit(1))
    summed = ranking.prefix_sums(df, [F.col("v"), F.col("i")], {"one": "upto", "i": "total"}, rows_per_bucket=size)
    got = {r.i: (r.upto, r.total) for r in summed.collect()}
    total = 0
    for n, (_, i) in enumerate(sorted((v, i) for _, v, i in rows), 1):
        total += i
        assert got[i] == (n, total)


def pair_auc(labels, scores):
    positive = [s for y, s in zip(labels, scores) if y]
    negative = [s for y, s in zip(labels, scores) if not y]
    if not positive or not negative:
        return None
    won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return won / (len(positive) * len(negative))


def loop_precision(labels, scores):
    order = sorted(range(len(labels)), key=lambda i: (-scores[i], i))
    found, total = 0, 0.0
    for seen, i in enumerate(order, 1):
        if labels[i]:
            found += 1
            total += found / seen
    return total / found if found else None


def scored(spark, labels, scores):
    return spark.createDataFrame(
        [(i, y, s) for i, (y, s) in enumerate(zip(labels, scores))], "id int, anomaly int, anomaly_score double"
    )


@pytest.mark.parametrize(
    ("labels", "scores", "auc", "precision"),
    [
        ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75, (1 + 2 / 3) / 2),
        ([0, 1, 1], [0.5] * 3, 0.5, (1 / 2 + 2 / 3) / 2),
        ([1, 1], [0.1, 0.2], None, 1.0),
        ([0, 0], [0.1, 0.2], None, None),
    ],
)
def test_small_curves(spark, labels, scores, auc, precision):
    df = scored(spark, labels, scores)
    assert evaluation.roc_auc(df).first()[0] == (None if auc is None else pytest.approx(auc))
    got = evaluation.average_precision(df).first()[0]
    assert got == (None if precision is None else pytest.approx(precision))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.5, 0.5, 0.9])), min_size=1, max_size=60))
def test_random_curves(spark, pairs):
    labels, scores = zip(*pairs)
    df = scored(spark, labels, scores)
    auc, precision = pair_auc(labels, scores), loop_precision(labels, scores)
    got = evaluation.roc_auc(df, rows_per_bucket=7).first()[0]
    assert got == (None if auc is None else pytest.approx(auc))
    got = evaluation.average_precision(df, rows_per_bucket=7).first()[0]
    assert got == (None if precision is None else pytest.approx(precision))


@pytest.mark.parametrize("longest", [30, 60])
def test_text_order_is_cut_like_numbers(spark, longest):
    """Texts with long common starts, zero bytes, nulls and other scripts; several cuts."""
    rng = random.Random(12)
    texts = ["blk_" + "0" * rng.randrange(longest - 12) + str(rng.randrange(30)) for _ in range(600)]
    texts += ["a", "a\0", "é", "日本", "", "blk_"] * 20 + [None] * 40
    rows = [(i, t, rng.randrange(5)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, v int").repartition(6)
    got = row_number_in_order(df, [], [F.col("t"), F.col("v"), F.col("i")], "rn", rows_per_bucket=40).collect()
    key = lambda r: (r[1] is not None, (r[1] or "").encode(), r[2], r[0])
    wanted = {r[0]: at + 1 for at, r in enumerate(sorted(rows, key=key))}
    assert {r.i: r.rn for r in got} == wanted


def test_order_by_a_struct_is_refused(spark):
    with pytest.raises(ValueError):
        row_number_in_order(spark.range(3).select(F.struct("id").alias("s")), [], [F.col("s")], "rn")


def test_small_groups_of_a_large_table_are_not_cut(spark, rows, monkeypatch):
    """Buckets of many small groups would be nearly as many as rows."""
    df = spark.createDataFrame([(i % 200, v, i) for _, v, i in rows], "g int, v double, i int")
    monkeypatch.setattr(ranking, "ordered_buckets", None)
    got = row_number_in_order(df, ["g"], [F.col("v"), F.col("i")], "rn", rows_per_bucket=50).collect()
    assert {(r.g, r.i): r.rn for r in got} == {
        (g, i): n for g in range(200) for n, (v, i) in enumerate(sorted((v, i) for _, v, i in rows if i % 200 == g), 1)
    }


@pytest.mark.parametrize("at_most", [None, 30])
def test_a_large_group_without_a_key_keeps_its_rows(spark, at_most):
    data = [(None if i % 3 else i % 7, 600 - i) for i in range(600)]
    df = spark.createDataFrame(data, "g int, v int")
    got = row_number_in_order(df, ["g"], [F.col("v")], "rn", at_most=at_most, rows_per_bucket=50).collect()
    expected = {(g, v): 1 + sum(h == g and w < v for h, w in data) for g, v in data}
    assert {(r.g, r.v): r.rn for r in got} == {key: n for key, n in expected.items() if n <= (at_most or 600)}
