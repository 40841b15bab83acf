"""Temporal features of windows: a seeded bank of dilated convolution kernels, pooled over time.

A kernel reads one feature at nine times, ``dilation`` rows apart; three of its weights are 2, the others
-1, so it answers to a shape and not to a level (Dempster et al., 2021). A window gives two values per
kernel: the largest response and the share of responses above the kernel's threshold. Unlike means and
deviations they change when the rows of a window change places. Windows of a batch are computed side by
side in NumPy; odd ones (nulls, other shapes) by array expressions.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from anomaloom.functions.batches import array_column, regular_windows
from anomaloom.functions.numeric import let

TAPS, HIGH_TAPS = 9, 3
# Windows of a batch whose responses are held at a time.
STRIP = 1024


@dataclass(frozen=True, order=True)
class Kernel:
    """The feature it reads, the rows between two taps, and the taps of weight 2."""

    feature: int
    dilation: int
    high: tuple[int, int, int]

    def weights(self) -> list[int]:
        return [2 if tap in self.high else -1 for tap in range(TAPS)]

    def span(self) -> int:
        """Rows under the kernel."""
        return (TAPS - 1) * self.dilation + 1


def kernel_bank(features: Sequence[int], length: int, per_feature: int, seed: int = 42) -> list[Kernel]:
    """``per_feature`` distinct kernels for each feature, with dilations 1, 2, 4… that fit a window of
    ``length`` rows in turn, and seeded taps. The same arguments give the same bank."""
    if length < TAPS:
        raise ValueError(f"windows need at least {TAPS} rows")
    rng = random.Random(seed)
    dilations = [1 << i for i in range(length) if (TAPS - 1 << i) < length]
    shapes = len(dilations) * 84
    if per_feature > shapes:
        raise ValueError(f"there are {shapes} kernels for windows of {length} rows")
    bank: set[Kernel] = set()
    for feature in dict.fromkeys(features):
        chosen: set[Kernel] = set()
        while len(chosen) < per_feature:
            dilation = dilations[len(chosen) % len(dilations)]
            high = tuple(sorted(rng.sample(range(TAPS), HIGH_TAPS)))
            chosen.add(Kernel(feature, dilation, high))
        bank |= chosen
    return sorted(bank)


def responses(window: Column, bank: Sequence[Kernel], length: int) -> Column:
    """Array with the responses of every kernel of a sorted bank at all places where it fits.

    Kernels that read the same feature at the same distance share the sum of their taps; each adds three
    times its high ones.
    """
    parts = []
    for feature, by_feature in groupby(bank, key=lambda kernel: kernel.feature):
        # Lambdas are turned into expressions at once, while the loop's names stand.
        kernels = list(by_feature)
        series = F.transform(window, lambda row: F.get(row, F.lit(feature)).cast("double"))
        parts.append(let(series, lambda x: _of_series(x, kernels, length)))
    return F.concat(*parts)


def _of_series(x: Column, kernels: Sequence[Kernel], length: int) -> Column:
    found = []
    for dilation, group in groupby(kernels, key=lambda kernel: kernel.dilation):
        group = list(group)
        # The series cut to the places of the kernel, once per tap: element t is row t + tap * dilation.
        places = length - (TAPS - 1) * dilation
        shifted = F.array(*(F.slice(x, tap * dilation + 1, places) for tap in range(TAPS)))
        found.append(let(shifted, lambda s: _of_taps(s, group)))
    return F.concat(*found)


def _of_taps(shifted: Column, group: Sequence[Kernel]) -> Column:
    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda u, v: u + v)

    def one(total: Column, kernel: Kernel) -> Column:
        first, second, third = (shifted[tap] for tap in kernel.high)
        return F.zip_with(add(add(first, second), third), total, lambda high, every: 3.0 * high - every)

    total = shifted[0]
    for tap in range(1, TAPS):
        total = add(total, shifted[tap])
    return let(total, lambda every: F.array(*(one(every, kernel) for kernel in group)))


def _batch_responses(windows: pa.Array, bank: Sequence[Kernel], length: int) -> tuple[np.ndarray, Iterator[list[np.ndarray]]]:
    """Places of the regular, finite windows of a batch, and the responses of every kernel to some of
    them at a time, by place and window. Sums run in the order of :func:`responses`."""
    at, x = regular_windows(windows, length)
    if not len(at) or x.shape[2] <= max(kernel.feature for kernel in bank):
        return at[:0], iter(())
    finite = np.isfinite(x).all(axis=(1, 2))
    at, x = at[finite], x[finite]

    def parts() -> Iterator[list[np.ndarray]]:
        for begin in range(0, len(at), STRIP):
            rows = x[begin : begin + STRIP]
            found = []
            for (feature, dilation), group in groupby(bank, key=lambda kernel: (kernel.feature, kernel.dilation)):
                series = np.ascontiguousarray(rows[:, :, feature].T, dtype=np.float64)
                places = length - (TAPS - 1) * dilation
                taps = [series[tap * dilation : tap * dilation + places] for tap in range(TAPS)]
                every = reduce(np.add, taps)
                for kernel in group:
                    first, second, third = (taps[tap] for tap in kernel.high)
                    found.append(3.0 * (first + second + third) - every)
            yield found

    return at, parts()


def _pooled_batch(
    windows: pa.Array, bank: Sequence[Kernel], length: int, pool: Callable[[int, np.ndarray], list[np.ndarray]]
) -> pa.Array:
    """``pool`` of every kernel's responses as an array per window; null for windows left to expressions."""
    at, parts = _batch_responses(windows, bank, length)
    rows = [np.stack([v for i, r in enumerate(found) for v in pool(i, r)], axis=1) for found in parts]
    if not rows:
        return pa.nulls(len(windows), pa.list_(pa.float64()))
    return array_column(len(windows), at, np.concatenate(rows))


def fit_thresholds(windows: DataFrame, bank: Sequence[Kernel], length: int, window: str = "window") -> list[float]:
    """Mean response of every kernel over the given windows (the train split); zeros without windows.

    One aggregate of two numbers a kernel, whatever the number of windows.
    """
    bank = list(bank)

    @F.arrow_udf(ArrayType(DoubleType()))
    def batch_sums(column: pa.Array) -> pa.Array:
        # One place after the other, as the expression adds them.
        return _pooled_batch(column, bank, length, lambda _, r: [reduce(np.add, r)])

    def plain(found: Column) -> Column:
        one = lambda v: F.struct(
            F.aggregate(v, F.lit(0.0), lambda total, x: total + x).alias("total"), F.size(v).cast("bigint").alias("n")
        )
        return F.transform(found, one)

    def counted(sums: Column) -> Column:
        one = lambda total, n: F.struct(total.alias("total"), n.alias("n"))
        return F.zip_with(sums, F.lit(places).cast("array<bigint>"), one)

    places = [length - (TAPS - 1) * kernel.dilation for kernel in bank]
    summed = windows.select(window, batch_sums(F.col(window)).alias("__sums"))
    expressed = let(responses(F.col(window), bank, length), plain)
    found = summed.select(F.coalesce(counted(F.col("__sums")), expressed).alias("r"))
    # An inner generator would be given a filter that computes the responses a second time.
    sums = found.select(F.posexplode_outer("r").alias("kernel", "v")).groupBy("kernel").agg(
        F.sum("v.total").alias("total"), F.sum("v.n").alias("n")
    )
    means = {row.kernel: row.total / row.n for row in sums.where(F.col("kernel").isNotNull()).collect()}
    return [means.get(i, 0.0) for i in range(len(bank))]


def convolution_values(
    window: Column, bank: Sequence[Kernel], length: int, thresholds: Sequence[float] | None = None
) -> Column:
    """Array with, per kernel, the largest response and the share of responses above its threshold.

    ``window`` holds ``length`` rows of features; null gives null, and a feature that a row lacks or
    has as null makes that kernel's values null. Thresholds are zeros by default. Windows of a batch
    are computed side by side; those with nulls, without finite values or of another shape than the
    batch's first one are left to expressions, with the same results.
    """
    bank = list(bank)
    bounds = [float(x) for x in thresholds or [0.0] * len(bank)]
    limits = F.lit(bounds)

    @F.arrow_udf(ArrayType(DoubleType()))
    def batch_values(column: pa.Array) -> pa.Array:
        return _pooled_batch(
            column, bank, length, lambda i, r: [r.max(axis=0), np.count_nonzero(r > bounds[i], axis=0) / len(r)]
        )

    def pooled(values: Column, limit: Column) -> Column:
        above = F.size(F.filter(values, lambda v: v > limit)) / F.size(values)
        whole = F.forall(values, lambda v: v.isNotNull())
        return F.array(F.when(whole, F.array_max(values)), F.when(whole, above))

    expressed = F.when(window.isNotNull(), F.flatten(F.zip_with(responses(window, bank, length), limits, pooled)))
    return F.coalesce(batch_values(window), expressed)


def convolution_features(
    window: Column, bank: Sequence[Kernel], length: int, thresholds: Sequence[float] | None = None
) -> Column:
    """The values of :func:`convolution_values` as a vector for Spark ML."""
    return array_to_vector(convolution_values(window, bank, length, thresholds))
