"""Joins of intervals on a key, by bins of the width of the intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = 4  # of one level's bins to the next


def _level(start: Column, end: Column, width: int) -> Column:
    """The lowest level whose bins are as wide as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log((end - start + 1) / F.lit(float(width))) / F.log(F.lit(float(_STEP)))).cast("int"))


def _bin(place: Column, level: Column, width: int) -> Column:
    return F.floor(place / (F.lit(float(width)) * F.pow(F.lit(float(_STEP)), level))).cast("long")


def _binned(rows: DataFrame, name: str, own: list[int], others: list[int], width: int) -> DataFrame:
    """rows at their own level, and at the higher levels of the other side: two bins each at
    most, as bins are as wide as the interval."""
    higher = F.array(*[F.lit(x) for x in others]) if others else F.array().cast("array<int>")
    levels = F.array_union(F.array(f"{name}_level"), F.filter(higher, lambda x: x > F.col(f"{name}_level")))
    leveled = rows.withColumn("level", F.explode(levels))
    return leveled.withColumn("bin", F.explode(F.sequence(_bin(F.col(f"{name}_start"), F.col("level"), width), _bin(F.col(f"{name}_end"), F.col("level"), width))))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int = 64) -> DataFrame:
    """All pairs of left (key, l_start, l_end, ...) and right (key, r_start, r_end, ...) of one
    key that overlap, ends included; intervals that end before they start overlap nothing.

    An interval lies in bins of its own width, and in those of the other side's wider
    intervals. A pair meets at the wider one's level, and counts in the bin where the later of
    the two begins; so each pair comes once, and a key with many intervals is many bins.
    """
    sides = []
    for rows, name in ((left, "l"), (right, "r")):
        fit = rows.where(F.col(f"{name}_start") <= F.col(f"{name}_end"))
        sides.append(fit.withColumn(f"{name}_level", _level(F.col(f"{name}_start"), F.col(f"{name}_end"), width)))
    # A level is the logarithm of a length: some thirty at most.
    used = [sorted(r[0] for r in s.select(f"{n}_level").distinct().collect()) for s, n in zip(sides, "lr", strict=True)]
    a = _binned(sides[0], "l", used[0], used[1], width)
    b = _binned(sides[1], "r", used[1], used[0], width)
    later = F.greatest("l_start", "r_start")
    met = a.join(b, [key, "level", "bin"]).where(
        (F.col("level") == F.greatest("l_level", "r_level"))
        & (F.col("l_start") <= F.col("r_end"))
        & (F.col("r_start") <= F.col("l_end"))
        & (F.col("bin") == _bin(later, F.col("level"), width))
    )
    return met.drop("level", "bin", "l_level", "r_level")
