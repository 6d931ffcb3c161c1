"""Impact prediction: which files a change is likely to affect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.operators import cochange, graph, risk, tests_rec

# The weights of the components.
WEIGHTS = {"dependency": "0.35", "semantic": "0.25", "cochange": "0.20", "test": "0.10", "risk": "0.10"}


def dependency_score(distance: Column, paths: Column | None = None) -> Column:
    """1, 0.65, 0.4, then 0.2 by distance; 0.08 for each further path, 0.2 at most."""
    base = F.when(distance == 1, 1.0).when(distance == 2, 0.65).when(distance == 3, 0.40).otherwise(0.20)
    if paths is None:
        return base
    return F.least(F.lit(1.0), base + F.least(F.lit(0.20), 0.08 * F.greatest(paths - 1, F.lit(0))))


def by_dependency(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """file_id, score, n_reasons: the best over the changed files, a reason for each."""
    reach = graph.reverse_dependents(edges, changed, depth)
    return reach.groupBy("file_id").agg(F.max(dependency_score(F.col("distance"))).alias("score"), F.count("*").alias("n_reasons"))


def test_component(files: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, score: how well a test covers any source of the repository.

    Sources count through their distinct stems and folders, so a test meets a folder once,
    however many files it has.
    """
    sources = files.where("NOT is_test")
    folders = sources.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).groupBy("folder").agg(F.min(F.struct("path", "file_id")).alias("m")).select("m.file_id", "m.path")
    stems = sources.withColumn("stem", tests_rec.stem_of(F.col("path"))).groupBy("stem").agg(F.min(F.struct("path", "file_id")).alias("m")).select("m.file_id", "m.path")
    found = tests_rec.naming(files, stems).union(tests_rec.proximity(files, folders)).union(tests_rec.by_import(files, sources, edges))
    return found.groupBy(F.col("test_id").alias("file_id")).agg(F.round(F.max("score"), 4).alias("score"))


def final_score() -> Column:
    """The weighted sum of the components, in decimals so that ties round the same everywhere."""
    total = None
    for name, weight in WEIGHTS.items():
        term = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name))).cast("decimal(10,6)") * F.lit(weight).cast("decimal(3,2)")
        total = term if total is None else total + term
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 4).cast("double")))


def candidates(files: DataFrame, edges: DataFrame, items: DataFrame, commits: DataFrame, changed: DataFrame, semantic: DataFrame, depth: int = 3, include_changed: bool = False, complexity: DataFrame | None = None) -> DataFrame:
    """file_id, path, the five components and the score of every file with a reason. files and
    edges are read by several components: hand in stored ones."""
    universe = files if include_changed else files.join(changed.select("file_id"), "file_id", "left_anti")
    parts = {
        "dependency": by_dependency(edges, changed, depth).select("file_id", F.col("score").alias("dependency")),
        "semantic": semantic.select("file_id", F.col("score").alias("semantic")),
        "cochange": cochange.cosine(cochange.dealt(items).distinct(), changed).select("file_id", F.col("score").alias("cochange")),
        "test": test_component(files, edges).select("file_id", F.col("score").alias("test")),
        "risk": risk.scored(risk.components(files, edges, items, commits, complexity)).select("file_id", F.col("score").alias("risk")),
    }
    joined = universe.select("file_id", "path")
    for frame in parts.values():
        joined = joined.join(frame, "file_id", "left")
    joined = joined.fillna(0.0, list(parts))
    return joined.where("dependency > 0 OR semantic > 0 OR cochange > 0 OR test > 0 OR risk >= 0.5").withColumn("score", final_score())


def ranked(found: DataFrame, top_k: int = 20) -> DataFrame:
    """The top_k by score, then path, with their rank. Cut before the ranking window."""
    top = found.orderBy(F.desc("score"), "path").limit(top_k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "path")))


def explanation(changed: DataFrame, top: DataFrame, tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """One sentence about changed (path), top (rank, path), tests (score, path) and symbols
    (symbol, place): three files, three tests and five symbols are named. Every part is a few
    rows."""

    def names(rows: DataFrame, name: str, *order: Column, most: int | None = None) -> DataFrame:
        few = rows if most is None else rows.orderBy(*order).limit(most)
        listed = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(name).alias("it"))))
        return few.agg(F.array_join(F.transform(listed, lambda x: x["it"]), ", ").alias("names"))

    parts = [
        names(changed, "path", F.col("path")),
        names(top, "path", F.col("rank"), most=3),
        names(symbols, "symbol", F.col("place"), F.col("symbol"), most=5),
        names(tests, "path", -F.col("score"), F.col("path"), most=3),
    ]
    one = parts[0].toDF("changed")
    for part, name in zip(parts[1:], ("files", "symbols", "tests"), strict=True):
        one = one.crossJoin(part.toDF(name))
    note = F.when(F.col("symbols") == "", "").otherwise(F.concat(F.lit(" Changed symbols: "), "symbols", F.lit(".")))
    known = lambda name: F.when(F.col(name) == "", f"no {name}").otherwise(F.col(name))
    return one.select(
        F.concat(F.lit("Changes in "), known("changed"), F.lit(" are likely to affect "), known("files"), F.lit("."), note, F.lit(" Suggested tests: "), known("tests"), F.lit(".")).alias("explanation")
    )


_RUNS = "run_id string, status string, error string, n_predictions long"


def persist_run(ranked_files: Callable[[], DataFrame], run_id: str, folder: str, spark: SparkSession) -> None:
    """Write what ranked_files gives as the predictions of a run, then the run as completed.
    If that breaks off the run is written as failed, with the error, which is raised again."""
    try:
        found = ranked_files()
        found.write.mode("overwrite").parquet(f"{folder}/predictions/run_id={run_id}")
        row = (run_id, "completed", None, spark.read.parquet(f"{folder}/predictions/run_id={run_id}").count())
    except Exception as e:
        spark.createDataFrame([(run_id, "failed", f"{type(e).__name__}: {e}", None)], _RUNS).write.mode("overwrite").parquet(f"{folder}/runs/{run_id}")
        raise
    spark.createDataFrame([row], _RUNS).write.mode("overwrite").parquet(f"{folder}/runs/{run_id}")


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, status, error and n_predictions of every run on record."""
    return spark.read.schema(_RUNS).parquet(f"{folder}/runs/*")


def read_run(spark: SparkSession, run_id: str, folder: str) -> DataFrame:
    """The predictions of a run in order of rank, with the run's status."""
    rows = spark.read.option("basePath", f"{folder}/predictions").parquet(f"{folder}/predictions/run_id={run_id}")
    state = run_states(spark, folder).select("run_id", "status")
    return rows.join(F.broadcast(state), "run_id").orderBy("rank")
