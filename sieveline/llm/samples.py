"""Which rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """True for the third of all rows that no model learns from; a null id is never learned from either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def bounded(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones each time: those whose hashed id is smallest."""
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most)
