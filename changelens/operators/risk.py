"""Architectural risk of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.operators import cochange, graph

# Weights (they sum to 1.10; the score is capped), and reasons in order.
WEIGHTS = {
    "fan_in": "0.25", "fan_out": "0.10", "centrality": "0.10", "churn": "0.20",
    "complexity": "0.15", "file_size": "0.10", "bugfix_frequency": "0.15", "test_coverage_proxy": "0.05",
}
REASONS = {
    "fan_in": "High fan-in", "fan_out": "High fan-out", "centrality": "High graph centrality", "churn": "Frequently changed",
    "complexity": "High complexity", "file_size": "Large file", "bugfix_frequency": "Often touched by bugfix commits", "test_coverage_proxy": "Weak test proximity signal",
}


def scale(value: Column, saturation: int) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(value / F.lit(float(saturation)), F.lit(1.0))), 4)


def components(files: DataFrame, edges: DataFrame, items: DataFrame, commits: DataFrame, complexity: DataFrame | None = None) -> DataFrame:
    """files (file_id, path, language, loc, is_test) and the eight components, 0 to 1."""
    joined = (
        files.join(graph.fan_counts(edges), "file_id", "left")
        .join(cochange.churn(items), "file_id", "left")
        .join(cochange.bugfix_churn(items, commits), "file_id", "left")
    )
    if complexity is not None:
        joined = joined.join(complexity.select("file_id", F.col("complexity").alias("raw_complexity")), "file_id", "left")
    else:
        joined = joined.withColumn("raw_complexity", F.lit(0.0))
    joined = joined.fillna(0, ["fan_in", "fan_out", "churn", "bugfix", "loc"]).fillna(0.0, ["raw_complexity"])
    return joined.select(
        *files.columns,
        scale(F.col("fan_in"), 10).alias("fan_in"),
        scale(F.col("fan_out"), 10).alias("fan_out"),
        scale(F.col("fan_in") + F.col("fan_out"), 20).alias("centrality"),
        scale(F.col("churn"), 20).alias("churn"),
        scale(F.col("raw_complexity"), 1).alias("complexity"),
        scale(F.col("loc"), 500).alias("file_size"),
        scale(F.col("bugfix"), 8).alias("bugfix_frequency"),
        F.when(F.col("is_test"), 0.0).otherwise(0.2).alias("test_coverage_proxy"),
    )


def score() -> Column:
    """The weighted sum, in decimals so that ties round the same everywhere."""
    total = None
    for name, weight in WEIGHTS.items():
        term = F.col(name).cast("decimal(6,4)") * F.lit(weight).cast("decimal(3,2)")
        total = term if total is None else total + term
    return F.least(F.lit(1.0), F.round(total, 4).cast("double"))


def reasons() -> Column:
    return F.filter(F.array(*[F.when(F.col(name) >= 0.5, label) for name, label in REASONS.items()]), lambda x: x.isNotNull())


def scored(parts: DataFrame) -> DataFrame:
    return parts.withColumn("score", score()).withColumn("reasons", reasons())


def mean(risks: DataFrame, include_tests: bool = False, language: str | None = None) -> DataFrame:
    """The mean risk of the files that the filters (not the search) leave; 0 without any."""
    kept = risks if include_tests else risks.where("NOT is_test")
    kept = kept.where(F.col("language") == language) if language else kept
    return kept.agg(F.coalesce(F.round(F.avg(F.col("score").cast("decimal(6,4)")).cast("double"), 4), F.lit(0.0)).alias("mean_risk"), F.count("*").alias("n"))


def ranking(risks: DataFrame, top_k: int = 20, include_tests: bool = False, language: str | None = None, search: str | None = None) -> DataFrame:
    kept = risks if include_tests else risks.where("NOT is_test")
    kept = kept.where(F.col("language") == language) if language else kept
    kept = kept.where(F.contains(F.lower("path"), F.lit(search.lower()))) if search else kept
    return kept.orderBy(F.desc("score"), "path").limit(top_k)


def severity(value: Column) -> Column:
    return F.when(value >= 0.75, "critical").when(value >= 0.5, "high").when(value >= 0.25, "medium").otherwise("low")
