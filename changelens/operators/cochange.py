"""Co-change: how often files change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_TASK_ROWS = 150_000


def dealt(items: DataFrame) -> DataFrame:
    """items dealt out by commit, so many rows a task however large the table is: its distinct
    rows and joins by commit then have a bound in each task. A few tasks' worth stays as it is."""
    tasks = -(-items.count() // _TASK_ROWS)
    # with fewer than the session's partitions, a join would deal again
    return items if tasks <= 8 else items.repartition(max(tasks, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "sha")


def path_counts(touched: DataFrame) -> DataFrame:
    """touched (sha, file_id), distinct -> file_id, n commits."""
    return touched.groupBy("file_id").agg(F.count("*").alias("n"))


def pair_counts(touched: DataFrame, changed: DataFrame | None = None, most_files: int | None = None) -> DataFrame:
    """a, b, joint: in how many commits a and b both changed. With changed (file_id), a is
    one of them, and only commits that touch one of them enter the self join.

    Without changed, a commit of n files makes n (n - 1) pairs. most_files leaves out commits
    of more files, which tell little about any pair; without it all count."""
    if most_files is not None:
        large = touched.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") > most_files)
        touched = touched.join(large, "sha", "left_anti")
    left = touched if changed is None else touched.join(changed.select("file_id").distinct(), "file_id", "left_semi")
    right = touched if changed is None else touched.join(left.select("sha").distinct(), "sha", "left_semi")
    pairs = left.withColumnRenamed("file_id", "a").join(right.withColumnRenamed("file_id", "b"), "sha").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("joint"))


def _with_counts(touched: DataFrame, changed: DataFrame) -> DataFrame:
    n = path_counts(touched)
    return (
        pair_counts(touched, changed)
        .join(n.select(F.col("file_id").alias("a"), F.col("n").alias("n_a")), "a")
        .join(n.select(F.col("file_id").alias("b"), F.col("n").alias("n_b")), "b")
    )


def cosine(touched: DataFrame, changed: DataFrame, digits: int = 6) -> DataFrame:
    """file_id, score: joint / sqrt(n_a n_b), 1 at most, the largest over the changed files."""
    score = F.least(F.lit(1.0), F.col("joint") / F.sqrt(F.col("n_a") * F.col("n_b").cast("double")))
    return _with_counts(touched, changed).groupBy(F.col("b").alias("file_id")).agg(F.round(F.max(score), digits).alias("score"))


def jaccard(touched: DataFrame, changed: DataFrame, digits: int = 6) -> DataFrame:
    """file_id, score: intersection over union of the commits, the largest over the changed
    files; files that never changed with one have 0."""
    best = _with_counts(touched, changed).groupBy(F.col("b").alias("file_id")).agg(F.max(F.col("joint") / (F.col("n_a") + F.col("n_b") - F.col("joint"))).alias("s"))
    one = changed.select("file_id").distinct()
    others = touched.select("file_id").distinct()
    # a changed file is compared with the other changed ones, so it stays if there is another
    several = one.agg((F.count("*") > 1).alias("several"))
    others = others.join(one.withColumn("changed", F.lit(True)), "file_id", "left").crossJoin(F.broadcast(several)).where("changed IS NULL OR several")
    return others.join(best, "file_id", "left").select("file_id", F.round(F.coalesce("s", F.lit(0.0)), digits).alias("score"))


def churn(items: DataFrame) -> DataFrame:
    """items (sha, file_id), repeats included -> file_id, churn."""
    return items.groupBy("file_id").agg(F.count("*").alias("churn"))


# Words of a message that tell a bug fix.
BUGFIX_WORDS = ("fix", "bug", "regression", "hotfix", "patch", "broken")


def bugfix_churn(items: DataFrame, commits: DataFrame) -> DataFrame:
    """file_id, bugfix: the commits that touch it and whose message has a bug-fix word."""
    fixes = commits.where(F.lower(F.coalesce("message", F.lit(""))).rlike("|".join(BUGFIX_WORDS))).select("sha")
    both = dealt(items.select("sha", "file_id")).join(fixes, "sha").distinct()
    return both.groupBy("file_id").agg(F.count("*").alias("bugfix"))
