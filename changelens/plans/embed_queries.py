"""Texts embedded, and searched by the vectors of query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import embed
from changelens.operators.evaluation import recent_commits
from changelens.plans.registry import query
from changelens.sources.tables import COMMITS_SQL, FILES_SQL, TEXTS_SQL, TOUCHED_SQL, chunk_texts, commit_items, commits, files
from changelens.sources.tables_sink import stored

_TOKENS = "regexp_extract_all(lower(substr(text, 1, 2048)), '[a-z]+|[0-9]+')"
#: After texts (chunk_id, file_id, text): the fitted weights and the chunks' vectors.
VECTORS_SQL = f"""toks AS (SELECT chunk_id, unnest({_TOKENS}) AS token FROM texts),
idf AS (SELECT token, count(DISTINCT chunk_id) AS texts_with, round(256 * ln(((SELECT count(*) FROM texts) + 1e0) / (count(DISTINCT chunk_id) + 1e0)))::BIGINT + 256 AS weight FROM toks GROUP BY token),
comp AS (SELECT token, b % 64 AS dim, sum(weight * (1 - 2 * (b // 64 % 2))) AS v FROM (SELECT token, weight, ('0x' || substr(md5(token), 2 * i + 1, 2))::BIGINT AS b FROM idf, range(4) r(i)) GROUP BY ALL),
vec AS (SELECT chunk_id, dim, sum(v)::DOUBLE AS v FROM toks JOIN comp USING (token) GROUP BY ALL),
norms AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM vec GROUP BY chunk_id)"""
#: After asked (id, text): all chunks by their score for each query.
NEAR_SQL = f"""qt AS (SELECT id, unnest({_TOKENS}) AS token FROM asked),
qv AS (SELECT id, dim, sum(v)::DOUBLE AS v FROM qt JOIN comp USING (token) GROUP BY ALL),
qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id),
dots AS (SELECT id, chunk_id, sum(q.v * c.v) AS d FROM qv q JOIN vec c USING (dim) GROUP BY ALL),
near AS (SELECT id, chunk_id, file_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.id, t.chunk_id, t.file_id, coalesce(round(greatest(0e0, least(1e0, d / nullif(norms.n * qn.n, 0))), 4), 0e0) AS score
  FROM asked a CROSS JOIN texts t LEFT JOIN norms USING (chunk_id) LEFT JOIN qn ON qn.id = a.id LEFT JOIN dots ON dots.id = a.id AND dots.chunk_id = t.chunk_id))"""
_WITH = f"WITH {FILES_SQL}, {TEXTS_SQL}, {VECTORS_SQL}"


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of all chunks (chunk_id, file_id, embedding) and the weights, stored."""
    texts = stored(chunk_texts(spark, sf_dir))
    weights = stored(embed.fit(texts))
    vectors = embed.embed(texts.withColumnRenamed("chunk_id", "id"), weights)
    return stored(vectors.select(F.col("id").alias("chunk_id"), F.col("id").alias("file_id"), "embedding")), weights


def hits(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of each query text (id, text): query_id, rank, chunk_id, file_id,
    score."""
    vectors, weights = index(spark, sf_dir)
    return embed.nearest_chunks(asked, vectors, weights, k).withColumn("file_id", F.col("chunk_id"))


@query("embed_weights", f"{_WITH} SELECT token, texts_with, weight FROM idf")
def embed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted table: in how many chunks a feature occurs, and its weight."""
    return embed.fit(chunk_texts(spark, sf_dir))


_DIGEST = "SELECT chunk_id, string_agg(v::BIGINT, ',' ORDER BY dim) AS components FROM vec WHERE v <> 0 GROUP BY chunk_id"


@query("embed_texts", f"{_WITH} {_DIGEST}")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every chunk, its components other than 0 as text."""
    some = F.filter("embedding", lambda x: x != 0)
    return index(spark, sf_dir)[0].select("chunk_id", F.array_join(F.transform(some, lambda x: x.cast("long").cast("string")), ",").alias("components"))


@query(
    "embed_upsert",
    f"""{_WITH}, old AS (SELECT file_id AS chunk_id, path FROM files WHERE is_test)
    SELECT chunk_id, (old.chunk_id IS NOT NULL) AS kept, CASE WHEN old.chunk_id IS NULL THEN (SELECT sum(abs(v))::BIGINT FROM vec WHERE vec.chunk_id = texts.chunk_id) ELSE 64 END AS total FROM texts LEFT JOIN old USING (chunk_id)""",
)
def embed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files have a stored vector (of ones), which stays; the others are embedded."""
    texts = chunk_texts(spark, sf_dir)
    ones = F.transform(F.sequence(F.lit(1), F.lit(embed.SIZE)), lambda i: F.lit(1.0))
    old = files(spark, sf_dir).where("is_test").select(F.col("file_id").alias("chunk_id"), ones.alias("embedding"))
    both = embed.embed_missing(texts, old, embed.fit(texts))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)).cast("long")
    return both.join(old.select("chunk_id", F.lit(True).alias("kept")), "chunk_id", "left").select("chunk_id", F.coalesce("kept", F.lit(False)).alias("kept"), total.alias("total"))


@query(
    "semantic_by_commit",
    f"""{_WITH}, {TOUCHED_SQL}, {COMMITS_SQL}, recent AS (SELECT * FROM commits ORDER BY author_date DESC NULLS LAST, sha LIMIT 50),
    asked AS (SELECT sha AS id, 'Changed files:' || chr(10) || string_agg(path, chr(10) ORDER BY path) || chr(10) || 'Changed symbols:' || chr(10) || string_agg('run_' || file_id, chr(10)) AS text FROM touched JOIN recent USING (sha) JOIN files USING (file_id) GROUP BY sha), {NEAR_SQL}
    SELECT id AS sha, rank::INTEGER AS rank, chunk_id, score FROM near WHERE rank <= 10""",
)
def semantic_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks nearest to each of the fifty newest commits, asked by the paths and
    symbols that the commit changed."""
    recent = recent_commits(commits(spark, sf_dir), 50).select("sha")
    rows = commit_items(spark, sf_dir).join(recent, "sha").distinct().join(files(spark, sf_dir).select("file_id", "path"), "file_id").withColumnRenamed("sha", "change_id")
    asked = embed.change_texts(rows.select("change_id", "path"), rows.select("change_id", F.concat(F.lit("run_"), "file_id").alias("name")))
    return hits(spark, sf_dir, asked, 10).select(F.col("query_id").alias("sha"), "rank", "chunk_id", "score")
