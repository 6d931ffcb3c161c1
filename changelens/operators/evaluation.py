"""Historical evaluation: how well rankings find the rest of a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.operators import cochange

METHODS = ("dependency_only", "cochange_only", "semantic_only", "hybrid")


def recent_commits(commits: DataFrame, limit: int) -> DataFrame:
    return commits.orderBy(F.desc_nulls_last("author_date"), "sha").limit(limit)


def judged(recent: DataFrame, touched: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """sha, paths (sorted, indexed ones), skipped: why a commit is no scenario, or null."""
    paths = touched.join(recent.select("sha"), "sha").join(files.select("file_id", "path"), "file_id").groupBy("sha").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    n = F.coalesce(F.size("paths"), F.lit(0))
    why = F.when(n <= 0, "no_indexed_code_files").when(n < 2, "fewer_than_two_code_files").when(n > most, "too_many_files")
    return recent.select("sha").join(paths, "sha", "left").withColumn("skipped", why)


def scenarios(judged_commits: DataFrame) -> DataFrame:
    """sha, known (the last path), truth (the other paths)."""
    kept = judged_commits.where("skipped IS NULL")
    return kept.select("sha", F.element_at("paths", -1).alias("known"), F.slice("paths", F.lit(1), F.size("paths") - 1).alias("truth"))


def _numbered(ranked: DataFrame, *order) -> DataFrame:
    """A window over the predictions of one known file, which no repository-wide key shares."""
    return ranked.withColumn("rn", F.row_number().over(W.partitionBy("known").orderBy(*order))).select("known", "rn", "path")


def by_dependency(known: DataFrame, edge_paths: DataFrame) -> DataFrame:
    """Direct dependents by path."""
    found = known.join(edge_paths.select(F.col("dst_path").alias("known"), F.col("src_path").alias("path")).distinct(), "known")
    return _numbered(found, "path")


def by_cochange(known: DataFrame, touched_paths: DataFrame) -> DataFrame:
    """Co-change cosine over the same commits (sha, path). The evaluated commit is among them."""
    rows = touched_paths.select("sha", F.col("path").alias("file_id")).distinct()
    n = cochange.path_counts(rows)
    pairs = cochange.pair_counts(rows, known.select(F.col("known").alias("file_id")))
    both = pairs.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    score = F.round(F.least(F.lit(1.0), F.col("joint") / F.sqrt(F.col("n_a") * F.col("n_b").cast("double"))), 6)
    return _numbered(both.select(F.col("a").alias("known"), F.col("b").alias("path"), score.alias("score")), F.desc("score"), "path")


def by_semantic(hits: DataFrame) -> DataFrame:
    """hits (known, rank, path), the known file left out; a path can repeat."""
    return _numbered(hits.where("path <> known"), "rank")


def hybrid(lists: list[DataFrame]) -> DataFrame:
    """The sum of 1/rank over the lists."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    summed = out.groupBy("known", "path").agg(F.round(F.sum(1 / F.col("rn")), 6).alias("score"))
    return _numbered(summed, F.desc("score"), "path")


def metrics(scenario_rows: DataFrame, predictions: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """scenario_rows (sha, known, truth), predictions (method, known, rn, path) -> sha,
    method, k and the six metrics."""
    spark = scenario_rows.sparkSession
    methods = spark.createDataFrame([(m,) for m in METHODS], "method string")
    base = scenario_rows.crossJoin(F.broadcast(methods))
    hits = base.join(predictions, ["known", "method"], "left").withColumn("hit", F.coalesce(F.array_contains("truth", F.col("path")), F.lit(False)).cast("int"))
    so_far = F.sum("hit").over(W.partitionBy("sha", "method").orderBy("rn"))
    hits = hits.withColumn("so_far", so_far).withColumn("t", F.size("truth"))
    hits = hits.select("sha", "method", "t", "rn", "hit", "so_far", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    inside = F.col("rn") <= F.col("k")
    agg = hits.groupBy("sha", "method", "k", "t").agg(
        F.count(F.when(inside, 1)).alias("n"),
        F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias("h"),
        F.min(F.when(F.col("hit") == 1, F.col("rn"))).alias("first"),
        F.sum(F.when(inside & (F.col("hit") == 1), F.col("so_far") / F.col("rn")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(inside & (F.col("hit") == 1), 1 / F.log2(F.col("rn") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("t", "k")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = F.lit(0.0)
    precision = F.coalesce(F.round(F.col("h") / F.nullif("n", F.lit(0)), 4), zero)
    recall = F.coalesce(F.round(F.col("h") / F.nullif("t", F.lit(0)), 4), zero)
    out = agg.withColumn("precision", precision).withColumn("recall", recall)
    return out.select(
        "sha",
        "method",
        "k",
        "precision",
        "recall",
        F.coalesce(F.round(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), 4), zero).alias("f1"),
        F.coalesce(F.round(1 / F.col("first"), 4), zero).alias("mrr"),
        F.round(F.col("ap") / F.least("t", "k"), 4).alias("map"),
        F.round(F.col("dcg") / ideal, 4).alias("ndcg"),
    )


NAMES = ("precision", "recall", "f1", "mrr", "map", "ndcg")


def summary(rows: DataFrame) -> DataFrame:
    """The mean of each metric by method and k."""
    return rows.groupBy("method", "k").agg(*[F.round(F.avg(F.col(m).cast("decimal(10,4)")).cast("double"), 4).alias(m) for m in NAMES], F.count("*").alias("n"))


def report(summaries: DataFrame) -> DataFrame:
    """One Markdown section per method, a line per metric and k in order."""
    lines = F.array(*[F.concat(F.lit(f"- {m}@"), F.col("k").cast("string"), F.lit(": "), F.format_number(m, 4)) for m in NAMES])
    each = summaries.select("method", F.explode(lines).alias("line"))
    return each.groupBy("method").agg(F.concat(F.lit("## "), F.first("method"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("section"))
