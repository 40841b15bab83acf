"""Features that read order and time, against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomaloom.operators import convolution, surprise
from anomaloom.operators.models import fit_classifier, window_features


def plain_responses(window, kernel):
    x = [row[kernel.feature] for row in window]
    return [
        sum(w * x[t + tap * kernel.dilation] for tap, w in enumerate(kernel.weights()))
        for t in range(len(x) - kernel.span() + 1)
    ]


def test_bank_is_seeded_and_fits():
    bank = convolution.kernel_bank((0, 3), 64, 10, seed=1)
    assert bank == convolution.kernel_bank((0, 3), 64, 10, seed=1) != convolution.kernel_bank((0, 3), 64, 10, seed=2)
    assert len(set(bank)) == 20 and {k.feature for k in bank} == {0, 3} and {k.dilation for k in bank} == {1, 2, 4}
    assert all(k.span() <= 64 and sum(k.weights()) == 0 for k in bank)
    assert {k.dilation for k in convolution.kernel_bank([0], 9, 84)} == {1}
    for length, many in ((8, 1), (9, 85)):
        with pytest.raises(ValueError):
            convolution.kernel_bank([0], length, many)


def test_values_against_plain_python(spark):
    rng = np.random.default_rng(3)
    windows = [rng.integers(0, 9, (20, 3)).astype(float).tolist() for _ in range(12)] + [[[1.0, 1.0, 1.0]] * 20]
    bank = convolution.kernel_bank((0, 2), 20, 7)
    df = spark.createDataFrame(list(enumerate(windows)), "id int, window array<array<float>>")
    limits = convolution.fit_thresholds(df, bank, 20)
    every = [[v for w in windows for v in plain_responses(w, k)] for k in bank]
    assert limits == pytest.approx([sum(v) / len(v) for v in every])
    got = df.select("id", convolution.convolution_values(F.col("window"), bank, 20, limits).alias("v")).collect()
    for row in got:
        expected = []
        for kernel, limit in zip(bank, limits):
            values = plain_responses(windows[row.id], kernel)
            expected += [max(values), sum(v > limit for v in values) / len(values)]
        assert row.v == pytest.approx(expected)
    assert len(got) == 13


def test_null_windows_and_empty_tables(spark):
    bank = convolution.kernel_bank((0, 1), 9, 2)
    rows = [(1, None), (2, [[1.0]] * 9), (3, [[float(i), None] for i in range(9)])]
    df = spark.createDataFrame(rows, "id int, window array<array<float>>")
    got = {r.id: r.v for r in df.select("id", convolution.convolution_values(F.col("window"), bank, 9).alias("v")).collect()}
    assert got[1] is None
    assert got[2][:4] == [0.0] * 4 and got[2][4:] == [None] * 4 and got[3][4:] == [None] * 4
    assert convolution.fit_thresholds(df.limit(0), bank, 9) == [0.0] * 4


def test_order_inside_a_window_is_learnt(spark):
    """Classes with the same values in another order: means and deviations fail, kernels do not."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        values = np.concatenate([[0.0], rng.permutation([1.0] * 8 + [0.0] * 14), [0.0]])
        if i % 2:
            at = rng.integers(1, 14)
            values = np.zeros(24)
            values[at : at + 8] = 1.0
        rows.append((i, i % 2, [[float(v)] for v in values]))
    df = spark.createDataFrame(rows, "id int, y int, window array<array<float>>")
    train, test = df.where("id < 160"), df.where("id >= 160")
    bank = convolution.kernel_bank([0], 24, 20)
    limits = convolution.fit_thresholds(train, bank, 24)

    def accuracy(features):
        model = fit_classifier(train.select("y", features.alias("features")), regParam=0.01, maxIter=50)
        scored = model.transform(test.select("y", features.alias("features")))
        return scored.select(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]

    window = F.col("window")
    assert accuracy(convolution.convolution_features(window, bank, 24, limits)) > 0.95
    assert accuracy(window_features(window)) < 0.7


TRAIN = [["a", "b", "c", "a", "b", "c"], ["a", "b", "d"], [], None, ["c", None, "a"]]


def plain_probability(train, a, b, event, weights):
    grams = Counter()
    for row in train:
        events = [t for t in row or [] if t is not None]
        for i, e in enumerate(events):
            grams[(events[i - 2] if i > 1 else None, events[i - 1] if i else None, e)] += 1
    n = lambda keep: sum(count for gram, count in grams.items() if keep(*gram))
    kinds = {gram[2] for gram in grams}
    ab, one = n(lambda x, y, _: (x, y) == (a, b)), n(lambda _, y, __: y == b)
    base = n(lambda _, __, z: z == event) / n(lambda *_: True)
    w3, w2, w1, w0 = weights
    if not ab:
        w3, w2 = 0.0, w3 + w2
    if not one:
        w2, w1 = 0.0, w3 + w2 + w1
    p = w0 / (len(kinds) + 1) + w1 * base
    p += w2 * n(lambda _, y, z: (y, z) == (b, event)) / one if one else 0.0
    return p + (w3 * n(lambda *g: g == (a, b, event)) / ab if ab else 0.0)


def traces(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, tokens array<string>").withColumn("n", F.lit("x"))


def test_probabilities_against_plain_python(spark):
    model = surprise.fit_next_events(traces(spark, TRAIN))
    contexts = [(None, None), (None, "a"), ("a", "b"), ("b", "c"), ("z", "b"), ("a", "z"), ("c", "a")]
    asked = [(a, b, e) for a, b in contexts for e in ["a", "b", "c", "d", "new"]]
    got = surprise.event_probabilities(model, spark.createDataFrame(asked, "a string, b string, event string")).collect()
    found = {(r.a, r.b, r.event): r.p for r in got}
    assert len(got) == len(asked)
    for gram in asked:
        assert found[gram] == pytest.approx(plain_probability(TRAIN, *gram, surprise.WEIGHTS))
    for a, b in contexts:
        assert sum(found[(a, b, e)] for e in ["a", "b", "c", "d", "new"]) == pytest.approx(1.0)


def test_surprise_of_sequences(spark):
    model = surprise.fit_next_events(traces(spark, TRAIN))
    rows = [["a", "b", "c"], ["c", "b", "a"], ["a", "b", "c"], [], None, ["q"] * 3]
    got = {r.id: r for r in surprise.sequence_surprise(traces(spark, rows), model, ["id"]).collect()}
    assert set(got) == {0, 1, 2, 5}
    for i in got:
        padded = [None, None, *rows[i]]
        costs = [-math.log(plain_probability(TRAIN, *padded[j : j + 3], surprise.WEIGHTS)) for j in range(len(rows[i]))]
        assert (got[i].n_events, got[i].surprise, got[i].peak) == (
            len(costs), pytest.approx(sum(costs) / len(costs)), pytest.approx(max(costs))
        )
    assert got[1].surprise > got[0].surprise


def test_surprise_without_training_rows(spark):
    model = surprise.fit_next_events(traces(spark, [[], None]))
    row = surprise.sequence_surprise(traces(spark, [["a"]]), model, ["id"]).first()
    assert (row.n_events, row.surprise, row.peak) == (1, 0.0, 0.0)
    assert surprise.sequence_surprise(traces(spark, []), model, ["id"]).collect() == []
    with pytest.raises(ValueError):
        surprise.event_probabilities(model, model.grams, (0.5, 0.5, 0.5, 0.0))


def test_odd_windows_beside_regular_ones(spark):
    bank = convolution.kernel_bank((0, 1), 9, 3)
    rng = np.random.default_rng(8)
    windows = [rng.integers(0, 9, (9, 2)).astype(float).tolist() for _ in range(5)]
    odd = [None, [[1.0, None]] * 9, [[float("inf"), 2.0]] * 9, [[3.0]] * 9]
    schema = "id int, window array<array<float>>"
    values = convolution.convolution_values(F.col("window"), bank, 9, [1.0] * 6).alias("v")
    alone = {i: spark.createDataFrame([(i, w)], schema).select(values).first().v for i, w in enumerate(windows + odd)}
    df = spark.createDataFrame(list(enumerate(windows + odd)), schema).coalesce(1).select("id", values)
    assert {r.id: str(r.v) for r in df.collect()} == {i: str(v) for i, v in alone.items()}
    for i, window in enumerate(windows):
        found = [plain_responses(window, k) for k in bank]
        assert alone[i] == pytest.approx([x for v in found for x in (max(v), sum(y > 1.0 for y in v) / len(v))])
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
