"""Upserts as aggregations: one row per key survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(rows: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(pick(F.struct(order, *[c for c in rest if c != order])).alias("row"))
    return one.select(*keys, *[F.col(f"row.{c}") for c in rest])


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest `order` per key."""
    return _pick(rows, keys, order, F.max)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the smallest `order` per key."""
    return _pick(rows, keys, order, F.min)


def merge(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with the batch's last row of each key over it."""
    fresh = last_wins(batch, keys, order)
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
