"""Stored tables with upserts, and facts by generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.plans.registry import query
from changelens.sources.store import StoredTable, active_rows, write_generations
from changelens.sources.tables import load

_COMMITS = "SELECT o_custkey % 5 AS repository, o_orderkey AS sha, o_orderpriority AS message, o_totalprice AS size FROM orders"
_AGAIN = "SELECT o_custkey % 5 AS repository, o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 100000000 ELSE 0 END AS sha, 'again ' || o_orderpriority AS message, o_totalprice * 2 AS size FROM orders WHERE o_orderstatus <> 'O'"


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("repository"), F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("message"), F.col("o_totalprice").alias("size"))


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch: finished orders once more, open ones under a new number."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    sha = F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 100_000_000).otherwise(0)
    return o.select((F.col("o_custkey") % 5).alias("repository"), sha.alias("sha"), F.concat(F.lit("again "), "o_orderpriority").alias("message"), (F.col("o_totalprice") * 2).alias("size"))


def _table(spark: SparkSession, sf_dir: str) -> StoredTable:
    table = StoredTable(spark, ["repository", "sha"])
    table.upsert(_commits(spark, sf_dir), "size")
    return table


@query("stored_last_wins", f"WITH a AS ({_COMMITS}), b AS ({_AGAIN}) SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (repository, sha)")
def stored_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits upserted into a stored table: the later batch counts."""
    table = _table(spark, sf_dir)
    table.upsert(_again(spark, sf_dir), "size")
    return table.read()


@query("stored_first_wins", f"WITH a AS ({_COMMITS}), b AS ({_AGAIN}) SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (repository, sha)")
def stored_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but what is stored stays."""
    table = _table(spark, sf_dir)
    table.upsert(_again(spark, sf_dir), "size", replace=False)
    return table.read()


@query(
    "stored_embeddings",
    """WITH e AS (SELECT vec_id % 150 AS chunk, label % 2 AS model, vec_id AS seq, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings),
    one AS (SELECT chunk, model, min(seq) AS seq, arg_min(first, seq) AS first FROM e GROUP BY ALL), two AS (SELECT chunk, model, min(seq) AS seq, arg_min(first, seq) AS first FROM e WHERE seq % 3 = 0 GROUP BY ALL)
    SELECT * FROM two UNION ALL SELECT * FROM one ANTI JOIN two USING (chunk, model)""",
)
def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by chunk and model: the first row in a batch counts, and replaces what is
    stored."""
    e = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 150).alias("chunk"), (F.col("label") % 2).alias("model"), F.col("vec_id").alias("seq"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))
    table = StoredTable(spark, ["chunk", "model"], buckets=8)
    table.upsert(e, "seq", pick="first")
    table.upsert(e.where("seq % 3 = 0"), "seq", pick="first")
    return table.read()


@query("stored_refresh", f"WITH a AS ({_COMMITS}) SELECT * FROM a WHERE repository <> 3")
def stored_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a repository deleted, as before it is indexed anew."""
    table = _table(spark, sf_dir)
    table.delete(spark.range(3, 4).select(F.col("id").alias("repository")))
    return table.read()


_FACTS = "facts AS (SELECT l_suppkey % 7 AS repository, (l_suppkey % 7) * 100 + year(l_shipdate) - 1990 AS generation, l_partkey AS file_id FROM lineitem), pointers AS (SELECT repository, max(generation) - 1 AS generation FROM facts GROUP BY repository)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as index rows: a generation for each repository and year of shipping."""
    repository = F.col("l_suppkey") % 7
    return load(spark, sf_dir, "lineitem").select(repository.alias("repository"), (repository * 100 + F.year("l_shipdate") - 1990).alias("generation"), F.col("l_partkey").alias("file_id"))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active generation of each repository: the last but one."""
    return facts(spark, sf_dir).groupBy("repository").agg((F.max("generation") - 1).alias("generation"))


@query("generation_scan", f"WITH {_FACTS} SELECT file_id, count(*) AS n FROM facts WHERE generation = (SELECT generation FROM pointers WHERE repository = 3) GROUP BY file_id")
def generation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a repository's active generation, from storage that holds all of them."""
    path = write_generations(facts(spark, sf_dir).drop("repository"))
    return active_rows(spark.read.parquet(path), pointers(spark, sf_dir), 3).groupBy("file_id").agg(F.count("*").alias("n"))


@query("generation_rows", f"WITH {_FACTS} SELECT p.repository, p.generation, count(*) AS n, count(DISTINCT file_id) AS files FROM facts f JOIN pointers p ON f.generation = p.generation GROUP BY ALL")
def generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each repository's active generation holds."""
    f = facts(spark, sf_dir)
    return f.select("generation", "file_id").join(F.broadcast(pointers(spark, sf_dir)), "generation").groupBy("repository", "generation").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))
