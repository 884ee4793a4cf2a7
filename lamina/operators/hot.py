"""Equi-joins against a keyed lookup side when one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; hence there are fewer hot keys than this.
HOT_PARTS = 256


def hot_keys(counts: DataFrame, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """Rows of ``counts`` (one per key, with column ``cnt``) above ``total / parts``: fewer than ``parts`` rows."""
    return counts.filter(F.col("cnt") > F.lit(max(1, total // parts)))


def lookup_join(rows: DataFrame, look: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``look`` (unique on ``key``, column ``cnt`` = rows per key).

    Rows of hot keys meet a broadcast of the fewer than ``HOT_PARTS`` hot lookup rows and
    never move; all others are joined by a shuffle on the key.
    """
    hot = hot_keys(look, total)
    near = rows.join(F.broadcast(hot.drop("cnt")), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    far = cold.join(look.filter(F.col("cnt") <= F.lit(max(1, total // HOT_PARTS))).drop("cnt"), key)
    return near.unionByName(far)
