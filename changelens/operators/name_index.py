"""Substring search over names by an inverted index of their trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.sources.tables_sink import stored

_FEW = 10_000  # ids that are looked up by value; more are joined


def postings(names: DataFrame) -> DataFrame:
    """names (id, name) -> gram, id: the distinct trigrams of each lower-cased name, stored in
    the order of the grams, so that a look-up reads the row groups of its own grams only."""
    low = F.lower("name")
    grams = F.regexp_extract_all(low, F.lit("(?s)(?=(.{3}))"), F.lit(1))  # overlapping, in one pass
    rows = names.where(F.length(low) >= 3).select(F.explode(F.array_distinct(grams)).alias("gram"), "id")
    return stored(rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"))


def pattern_grams(pattern: str) -> set[str]:
    """The trigrams that every name has that a LIKE pattern matches: those of its literal parts,
    in ASCII, where lower case is the same everywhere."""
    parts, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            parts[-1] += pattern[at]
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return {g for p in (p.lower() for p in parts) for g in (p[i : i + 3] for i in range(len(p) - 2)) if g.isascii()}


def search(names: DataFrame, index: DataFrame, pattern: str, most_grams: int = 3) -> DataFrame:
    """The names (id, name, ...) that match a LIKE pattern, without regard to case.

    The lists of its rarest trigrams are intersected and what is left is verified. A pattern
    without a trigram is matched against all names.
    """
    hit = F.ilike("name", F.lit(pattern))
    grams = sorted(pattern_grams(pattern))
    if not grams:
        return names.where(hit)
    sizes = {r["gram"]: r["n"] for r in index.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # one row a gram of the pattern
    if len(sizes) < len(grams):
        return names.where("false")
    chosen = sorted(grams, key=lambda g: (sizes[g], g))[:most_grams]
    found = index.where(F.col("gram").isin(chosen)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("id")
    if sizes[chosen[0]] <= _FEW:
        return names.where(F.col("id").isin([r["id"] for r in found.collect()])).where(hit)
    return names.join(found, "id", "left_semi").where(hit)
