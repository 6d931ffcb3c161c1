"""The changed paths of commits whose lists mix names and objects, as VARIANT values.

An item is a string, the path itself, or an object with path, new_path and old_path. Items of
other kinds, empty paths of objects, null lists and texts that are no JSON have no paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def items(commits: DataFrame, column: str = "changed_files") -> DataFrame:
    """commits (sha, a JSON list) -> sha, pos, item: a row for each item, as a VARIANT."""
    lists = commits.select("sha", F.try_variant_get(F.try_parse_json(F.col(column).cast("string")), "$", "array<variant>").alias("list"))
    return lists.select("sha", F.posexplode("list").alias("pos", "item")).where("item IS NOT NULL AND NOT is_variant_null(item)")


def _kind(item: Column) -> Column:
    return F.substring_index(F.schema_of_variant(item), "<", 1)


def _text(item: Column) -> Column:
    return F.when(_kind(item) == "STRING", F.try_variant_get(item, "$", "string"))


def _field(item: Column, *names: str) -> Column:
    """The first of an object's fields that is not empty, as text."""
    found = [F.nullif(F.try_variant_get(item, f"$.{n}", "string"), F.lit("")) for n in names]
    return F.when(_kind(item) == "OBJECT", F.coalesce(*found))


def renamed_paths(commits: DataFrame) -> DataFrame:
    """sha, path, distinct, as co-change takes them: a string, or an object's path, else its new
    path, else its old one."""
    i = F.col("item")
    return items(commits).select("sha", F.coalesce(_text(i), _field(i, "path", "new_path", "old_path")).alias("path")).where("path IS NOT NULL").distinct()


def plain_paths(commits: DataFrame) -> DataFrame:
    """sha, path, distinct, as tests and the evaluation take them: a string or an object's path."""
    i = F.col("item")
    return items(commits).select("sha", F.coalesce(_text(i), _field(i, "path")).alias("path")).where("path IS NOT NULL").distinct()


def churn_counts(commits: DataFrame) -> DataFrame:
    """path, churn, as the risk score takes them: objects with a path only, each item counted."""
    named = items(commits).select(_field(F.col("item"), "path").alias("path")).where("path IS NOT NULL")
    return named.groupBy("path").agg(F.count("*").alias("churn"))
