"""The engine's tables (files, edges, commits, ...) seen in the driver's star schema.

Each adapter has a twin in SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as files: file_id, path, language, loc, is_test."""
    part = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    is_test = F.col("p_size") % 5 == 0
    language = F.when(k % 5 <= 1, "python").when(k % 5 == 3, "javascript").otherwise("typescript")
    ext = F.when(k % 5 <= 1, ".py").when(k % 5 == 2, ".ts").when(k % 5 == 3, ".js").otherwise(".tsx")
    name = (
        F.when(is_test & (language == "python"), F.concat(F.lit("test_p"), k + 1, ext))
        .when(is_test, F.concat(F.lit("p"), k + 1, F.lit(".test"), ext))
        .otherwise(F.concat(F.lit("p"), k, ext))
    )
    folder = F.concat_ws("/", F.when(is_test, "tests").otherwise("src"), F.lower(F.regexp_replace("p_brand", "#", "")))
    return part.select(
        k.alias("file_id"),
        F.concat_ws("/", folder, name).alias("path"),
        language.alias("language"),
        (F.col("p_size") * 10).cast("bigint").alias("loc"),
        is_test.alias("is_test"),
    )


FILES_SQL = """files AS (
  SELECT p_partkey AS file_id, concat_ws('/', CASE WHEN p_size % 5 = 0 THEN 'tests' ELSE 'src' END, lower(replace(p_brand, '#', '')),
    CASE WHEN p_size % 5 = 0 AND p_partkey % 5 <= 1 THEN 'test_p' || (p_partkey + 1) || ext
         WHEN p_size % 5 = 0 THEN 'p' || (p_partkey + 1) || '.test' || ext ELSE 'p' || p_partkey || ext END) AS path,
    CASE WHEN p_partkey % 5 <= 1 THEN 'python' WHEN p_partkey % 5 = 3 THEN 'javascript' ELSE 'typescript' END AS language,
    (p_size * 10)::BIGINT AS loc, p_size % 5 = 0 AS is_test
  FROM (SELECT *, CASE WHEN p_partkey % 5 <= 1 THEN '.py' WHEN p_partkey % 5 = 2 THEN '.ts' WHEN p_partkey % 5 = 3 THEN '.js' ELSE '.tsx' END AS ext FROM part)
)"""


def edges(spark: SparkSession, sf_dir: str, dst: DataFrame | None = None) -> DataFrame:
    """src depends on dst: neighbouring lines of an order. With dst (dst), only edges to those."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    if dst is not None:
        after = after.join(dst, "dst", "left_semi")
    return line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").where("src <> dst").distinct()


EDGES_SQL = """edges AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey
)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commits: sha, author_date, message."""
    word = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Fix").otherwise("Change")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("author_date"), F.concat_ws(" ", word, "o_orderpriority").alias("message")
    )


COMMITS_SQL = """commits AS (
  SELECT o_orderkey AS sha, o_orderdate AS author_date,
    concat_ws(' ', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Fix' ELSE 'Change' END, o_orderpriority) AS message FROM orders
)"""


def commit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the changed-file lists of commits: sha, file_id; a file can repeat."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file_id"))


ITEMS_SQL = "items AS (SELECT l_orderkey AS sha, l_partkey AS file_id FROM lineitem)"
TOUCHED_SQL = "touched AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS file_id FROM lineitem)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as embedded chunks: chunk_id, file_id (vec_id mod 150 + 1), label, embedding."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 150 + 1).alias("file_id"), F.col("label"), F.col("embedding"))


CHUNKS_SQL = "chunks AS (SELECT vec_id AS chunk_id, vec_id % 150 + 1 AS file_id, label, embedding FROM embeddings)"


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the texts of chunks, one for each file: chunk_id, file_id, text."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), "p_name", "p_type")
    text = F.concat_ws("\n", "path", "language", F.concat(F.lit("run_"), "file_id"), "p_name", "p_type")
    # parts grow with the repository: neither side is broadcast
    return files(spark, sf_dir).join(part.hint("merge"), "file_id").select(F.col("file_id").alias("chunk_id"), "file_id", text.alias("text"))


TEXTS_SQL = "texts AS (SELECT file_id AS chunk_id, file_id, concat_ws(chr(10), path, language, 'run_' || file_id, p_name, p_type) AS text FROM files JOIN part ON p_partkey = file_id)"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as file contents under made-up paths: file_id, path, content."""
    k = F.col("doc_id")
    folder = F.when(k % 11 == 0, "build/").when(k % 7 == 0, "tests/").when(k % 5 == 0, "src/generated/").otherwise("src/")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("test_f"), k, F.lit(".py")))
        .when(k % 6 == 1, F.concat(F.lit("f"), k, F.lit(".JSX")))
        .when(k % 6 == 2, F.concat(F.lit("f"), k, F.lit(".spec.ts")))
        .when(k % 6 == 3, F.concat(F.lit("f"), k, F.lit(".min.js")))
        .when(k % 6 == 4, F.concat(F.lit("f"), k, F.lit(".py")))
        .otherwise(F.lit("package-lock.json"))
    )
    return load(spark, sf_dir, "documents").select(k.alias("file_id"), F.concat(folder, name).alias("path"), F.col("text").alias("content"))


SOURCE_FILES_SQL = """source_files AS (
  SELECT doc_id AS file_id, CASE WHEN doc_id % 11 = 0 THEN 'build/' WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 5 = 0 THEN 'src/generated/' ELSE 'src/' END ||
    CASE doc_id % 6 WHEN 0 THEN 'test_f' || doc_id || '.py' WHEN 1 THEN 'f' || doc_id || '.JSX' WHEN 2 THEN 'f' || doc_id || '.spec.ts'
      WHEN 3 THEN 'f' || doc_id || '.min.js' WHEN 4 THEN 'f' || doc_id || '.py' ELSE 'package-lock.json' END AS path, text AS content
  FROM documents
)"""


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a progress log: generation, seq, at, kind, amount, batch."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("generation"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("batch"),
    )


LOG_SQL = """log AS (
  SELECT user_id AS generation, event_id AS seq, ts AS at_time, event_type AS kind, value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS batch FROM events
)"""
