"""Flow rows: feature selection, clean numbers, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from anomaloom.functions.labels import (
    HEADER_WORDS,
    check_label_schema,
    compact_label,
    family_label,
    fine_label,
)
from anomaloom.functions.numeric import joined_cells, numbers_of_cells
from anomaloom.functions.text import normalize_label
from anomaloom.operators.computed import computed
from anomaloom.sources.columns import fold, resolve_column

# --- fixed values ---------------------------------------------------------------------------
IGNORED_COLUMNS = ("flow id", "src ip", "dst ip", "timestamp", "simillarhttp", "fwd header length.1")
FORWARD_PACKETS = ("Tot Fwd Pkts", "Total Fwd Packets", "Total Forward Packets")
BACKWARD_PACKETS = ("Tot Bwd Pkts", "Total Bwd Packets", "Total Backward Packets")
FORWARD_BYTES = ("TotLen Fwd Pkts", "Total Length of Fwd Packets")
BACKWARD_BYTES = ("TotLen Bwd Pkts", "Total Length of Bwd Packets")
TOTAL_NAMES = ("Flow Pkts Total", "Flow Bytes Total")
PAD_NAME = "Pad Feature"
FEATURE_COUNT = 80
# --------------------------------------------------------------------------------------------

# Doubles from here on round to an infinite 32-bit float.
_FLOAT_LIMIT = 3.4028235677973366e38


def select_feature_columns(columns: Sequence[str], label: str) -> list[str]:
    """Header order without the label and the ignored columns."""
    skipped = {fold(label), *IGNORED_COLUMNS}
    return [name for name in columns if fold(name) not in skipped]


def feature_names(sources: Sequence[str], n: int = FEATURE_COUNT, add_totals: bool = True) -> list[str]:
    """Output names: sources, totals, then numbered padding up to ``n``."""
    names = [*sources, *(TOTAL_NAMES if add_totals else ())]
    padding = [f"{PAD_NAME} {i}" for i in range(1, n - len(names) + 1)]
    return [*names, *padding][:n]


def total_cells(cells: Mapping[str, Column]) -> list[Column]:
    """Cells behind the totals: packets then bytes, each forward and backward; 0 where the table has
    no such column."""
    groups = (FORWARD_PACKETS, BACKWARD_PACKETS, FORWARD_BYTES, BACKWARD_BYTES)
    found = (resolve_column(list(cells), names) for names in groups)
    return [cells[name] if name else F.lit("0") for name in found]


def _totals(numbers: str, after: int) -> list[Column]:
    """Packet and byte totals from the four numbers that follow the first ``after``."""
    n = [F.get(numbers, F.lit(after + i)) for i in range(4)]
    return [n[0] + n[1], n[2] + n[3]]


def engineered_totals(df: DataFrame) -> DataFrame:
    """Add the two totals to a wide flow table."""
    cells = total_cells({name: F.col(f"`{name}`") for name in df.columns})
    parsed = computed(computed(df, __cells=joined_cells(cells)), __numbers=numbers_of_cells(F.col("__cells")))
    totals = dict(zip(TOTAL_NAMES, _totals("__numbers", 0)))
    return parsed.withColumns(totals).drop("__cells", "__numbers")


def fit_feature_vector(values: Column, size: int, n: int) -> Column:
    """First ``n`` of ``size`` values, zeros after the end, as 32-bit floats."""
    if size > n:
        values = F.slice(values, 1, n)
    elif size < n:
        values = F.concat(values, F.lit([0.0] * (n - size)).cast("array<double>"))
    return values.cast("array<float>")


def with_flow_features(
    df: DataFrame,
    cells: Sequence[Column],
    totals: Sequence[Column] = (),
    n: int = FEATURE_COUNT,
    output: str = "features",
) -> DataFrame:
    """Add the 32-bit feature vector of ``n`` values, ``totals`` (see :func:`total_cells`) summed
    up after the cells; null where a value overflows 32 bits."""
    size = len(cells)
    values = computed(df, __cells=joined_cells([*cells, *totals]))
    values = computed(values, __numbers=numbers_of_cells(F.col("__cells"))).drop("__cells")
    numbers = F.col("__numbers")
    if totals:
        both = F.concat(F.slice("__numbers", 1, size), F.array(*_totals("__numbers", size)))
        values = computed(values, __all=both).drop("__numbers")
        numbers, size = F.col("__all"), size + 2
    # Only the values that stay in the vector can disqualify the row.
    kept = F.slice(numbers, 1, n) if size > n else numbers
    fits = (F.array_max(kept) < _FLOAT_LIMIT) & (F.array_min(kept) > -_FLOAT_LIMIT)
    vector = F.when(fits, fit_feature_vector(numbers, size, n))
    return computed(values, **{output: vector}).drop("__numbers", "__all")


def with_canonical_label(
    df: DataFrame, raw: str, output: str = "label", schema: str = "fine", force: bool = True
) -> DataFrame:
    """Add the class name under ``schema``; rows without one are dropped.

    Blank and header-like labels have none. An unknown label is Anomaly (binary), OtherAttack
    (family), and under ``fine`` none with ``force``, else kept as it is.
    """
    check_label_schema(schema)
    cleaned = computed(df, __label=normalize_label(F.col(raw)))
    compacted = computed(cleaned, __compact=compact_label(F.col("__label")))
    worded = compacted.where((F.col("__label") != "") & ~F.col("__compact").isin(*HEADER_WORDS))
    named = computed(worded, __fine=fine_label(F.col("__compact")))
    fine = F.col("__fine")
    if schema == "binary":
        name = F.when(fine == "Benign", F.lit("Benign")).otherwise(F.lit("Anomaly"))
    elif schema == "family":
        name = family_label(fine)
    else:
        name = fine if force else F.coalesce(fine, F.col("__label"))
    labelled = named.withColumn(output, name).drop("__label", "__compact", "__fine")
    return labelled.where(F.col(output).isNotNull())


def finite_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose features are all finite 32-bit floats."""
    return df.where(F.col(features).isNotNull())


def valid_flows(df: DataFrame, schema: str = "fine", force: bool = True) -> DataFrame:
    """Rows with a class under the label schema and finite features; ``label`` replaces
    ``raw_label``."""
    return with_canonical_label(finite_rows(df), "raw_label", "label", schema, force).drop("raw_label")
