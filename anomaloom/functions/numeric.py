"""Number and vector expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from anomaloom.functions.text import strip

_CELL_END = "\x01"
# Letters that only the SQL cast takes for a part of a number.
_ONLY_SQL = "dDfFxXpPnN"
_DIGITS = r"\d(?:_?\d)*"
_UNDERSCORED = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined_cells(cells: Sequence[Column]) -> Column:
    """Text cells in one string, nulls as blanks. The separator inside a cell becomes a mark that no
    number has."""
    texts = (F.coalesce(cell.cast("string"), F.lit("")) for cell in cells)
    return F.concat_ws(_CELL_END, *(F.replace(text, F.lit(_CELL_END), F.lit("#")) for text in texts))


def numbers_of_cells(joined: Column) -> Column:
    """Numbers in joined text cells, as an array of doubles; 0.0 for blank, text, NaN, infinite or
    out-of-range cells. Thousands commas are dropped.

    Rows of plain digits are split and cast as an array. Otherwise the letters that only the SQL
    cast would read as numbers (``1d``, hexadecimal, ``Infinity``) are voided first. A row with an
    underscore (it may group digits) takes the exact path per cell.
    """

    def parsed(text: Column) -> Column:
        return F.split(text, _CELL_END, -1).try_cast("array<double>")

    plain = ~joined.rlike("[^-+.eE0-9\\x01]")
    voided = F.translate(joined, f"{_ONLY_SQL},", "#" * len(_ONLY_SQL))
    return (
        F.when(plain, F.transform(parsed(joined), _finite))
        .when(~joined.contains("_"), F.transform(parsed(voided), _finite))
        .otherwise(F.transform(F.split(joined, _CELL_END, -1), _grouped_number))
    )


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(0.0))


def _grouped_number(cell: Column) -> Column:
    def parse(text: Column) -> Column:
        plain = F.length(F.translate(text, "0123456789.+-eE", "")) == 0
        grouped = text.contains("_") & text.rlike(_UNDERSCORED)
        digits = F.when(plain, text).when(grouped, F.replace(text, F.lit("_"), F.lit("")))
        return let(digits.try_cast("double"), _finite)

    return let(strip(F.replace(strip(cell), F.lit(","), F.lit(""))), parse)


def to_float(col: Column) -> Column:
    """Number in one text cell, by the rules of :func:`numbers_of_cells` but without an array around it."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    voided = F.translate(text, f"{_ONLY_SQL}{_CELL_END},", "#" * (len(_ONLY_SQL) + 1))
    return (
        F.when(~text.rlike("[^-+.eE0-9]"), _finite(text.try_cast("double")))
        .when(~text.contains("_"), _finite(voided.try_cast("double")))
        .otherwise(_grouped_number(F.replace(text, F.lit(_CELL_END), F.lit("#"))))
    )


def clamp_score(col: Column) -> Column:
    """Score bounded to 0…1; NaN counts as 1, null stays null."""
    value = col.cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def last_items(items: Column, n: int) -> Column:
    """The last ``n`` items of an array (all if it is shorter)."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def left_pad(items: Column, n: int, value: Column) -> Column:
    return F.concat(F.array_repeat(value, F.greatest(n - F.size(items), F.lit(0))), items)


def softmax(logits: Column) -> Column:
    """Max-shifted softmax; the sum is floored at 1e-12."""

    def shares(powers: Column) -> Column:
        total = F.greatest(F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x), F.lit(1e-12))
        return let(total, lambda t: F.transform(powers, lambda x: x / t))

    return let(
        logits.cast("array<double>"),
        lambda values: let(
            F.array_max(values), lambda top: let(F.transform(values, lambda x: F.exp(x - top)), shares)
        ),
    )


def argmax(values: Column) -> Column:
    """0-based index of the first maximum."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))
