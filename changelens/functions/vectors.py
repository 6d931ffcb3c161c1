"""Column functions over embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine similarity within 0..1, to four digits; 0 where it is undefined."""
    raw = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))), 4)


def clean(v: Column) -> Column:
    """Null, NaN and infinite components as 0."""
    return F.transform(_double(v), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def normalize(v: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))


def validated(v: Column, size: int) -> Column:
    """v, or an error if it has another length."""
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} dimensions, got "), F.size(v).cast("string"))))
