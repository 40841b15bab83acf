"""Look-ups against a table with unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``df`` to a look-up table with unique keys.

    A plain join: at run time Spark broadcasts the table if its bytes allow it, else both sides are
    shuffled and a key that holds a large share of ``df`` is split over tasks (adaptive skew join).
    """
    return df.join(table, list(keys), how)
