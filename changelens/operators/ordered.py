"""Numbers and running totals in the order of a key's rows, where one key may hold most rows.

A window over the key would sort all its rows in one task. Here rows are dealt in ranges of
(key, order), so a long key lies in several blocks; windows run within a block, and what the
blocks before it add is a table of one row a key and block. Rows that tie in (key, order) are
in one block: an order without ties splits any key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.sources.tables_sink import stored

_AGGREGATES = {"max": F.max, "sum": F.sum}


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df with its rows in ranges, and the number of the range as _block."""
    return stored(df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))


def _with(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows joined with facts about their key and block; null keys are a key too."""
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    others = [c for c in facts.columns if c not in (*keys, "_block")]
    same = F.col("_block") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(facts.select(*named, F.col("_block").alias("_of"), *others), same).drop("_of", *(f"_key{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """blocks() with place (from 1, by order within the key) and total (rows of the key)."""
    by = W.partitionBy(*keys)
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(by.orderBy("_block")) - F.col("_n")).alias("_before")
    facts = sizes.select(*keys, "_block", before, F.sum("_n").over(by).alias("total"))
    place = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order)) + F.col("_before")
    return _with(rows, facts, keys).withColumn("place", place).drop("_before")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, how: str, out: str, own: bool = True) -> DataFrame:
    """blocks() with the running max or sum of a column as out. With own, a row counts itself
    and those that tie with it; without, only the rows before it."""
    agg = _AGGREGATES[how]
    sums = rows.groupBy(*keys, "_block").agg(agg(value).alias("_sum"))
    earlier = agg("_sum").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    within = W.partitionBy(*keys, "_block").orderBy(*order)
    mine = agg(value).over(within if own else within.rowsBetween(W.unboundedPreceding, -1))
    joined = _with(rows, sums.select(*keys, "_block", earlier.alias("_earlier")), keys)
    both = F.greatest(mine, "_earlier") if how == "max" else F.coalesce(mine, F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    return joined.withColumn(out, both).drop("_earlier")
