"""Semantic search, embeddings, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.functions import vectors as V
from changelens.operators import search
from changelens.plans.registry import query
from changelens.sources.tables import CHUNKS_SQL, FILES_SQL, TOUCHED_SQL, chunks, files, load
from changelens.sources.upsert import first_wins, last_wins

_SIM = "round(greatest(0e0, least(1e0, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)))), 4)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    first = c.where("chunk_id = 0").select(F.col("embedding").alias("query_vec")).limit(1)
    return c.crossJoin(F.broadcast(first))


@query("cosine_score", f"WITH {CHUNKS_SQL} SELECT chunk_id, {_SIM} AS score FROM chunks")
def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("chunk_id", V.cosine_score(F.col("embedding"), F.col("query_vec")).alias("score"))


@query("semantic_topk", f"WITH {CHUNKS_SQL}, {FILES_SQL} SELECT chunk_id, path, label, {_SIM} AS score FROM chunks JOIN files USING (file_id) ORDER BY score DESC, chunk_id LIMIT 10")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks, with their files."""
    return search.topk(_scored(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "path"), "file_id"), F.col("query_vec"), 10).select("chunk_id", "path", "label", "score")


@query(
    "semantic_batch",
    f"""WITH {CHUNKS_SQL}, q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
    s AS (SELECT query_id, chunk_id, round(greatest(0e0, least(1e0, list_cosine_similarity(embedding::DOUBLE[], v))), 4) AS score FROM chunks, q)
    SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""",
)
def semantic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of a query for each label."""
    c = chunks(spark, sf_dir)
    q = c.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "chunk_id").alias("query_vec"))
    return search.batch_topk(c, q, 5)


@query("semantic_ann")
def semantic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks, by the cell index, of every chunk whose id 100 divides. SQL can't
    express the index; a test measures its recall against the exact search."""
    c = chunks(spark, sf_dir)
    return search.ann_topk(c, c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec")), 10)


@query("embed_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS length FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def embed_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(V.normalize(F.col("embedding"))), 6).alias("length"))


@query("embed_clean", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0.2 THEN 0e0 ELSE x END)), 6) AS total FROM embeddings")
def embed_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken components (here NaN for those above 0.2) count as 0."""
    broken = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(V.clean(broken), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("embed_validate", "SELECT vec_id, len(embedding)::BIGINT AS dims FROM embeddings")
def embed_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size(V.validated(F.col("embedding"), 64)).cast("bigint").alias("dims"))


@query("needs_embedding", "SELECT d.doc_id FROM documents d ANTI JOIN embeddings e ON e.vec_id = d.doc_id AND e.label < 5")
def needs_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no stored vector of the wanted model (label below 5) covers."""
    stored = load(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id").join(stored, "doc_id", "left_anti")


@query("concat_text", f"WITH {CHUNKS_SQL} SELECT file_id, string_agg('chunk ' || chunk_id || ' of ' || label, chr(10) ORDER BY chunk_id) AS text FROM chunks GROUP BY file_id")
def concat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a file's chunks in order."""
    text = F.concat(F.lit("chunk "), "chunk_id", F.lit(" of "), "label")
    both = chunks(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", text.alias("text")))).alias("t"))
    return both.select("file_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


@query("upsert_last_wins", "SELECT user_id, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(load(spark, sf_dir, "events").select("user_id", "ts", "value", "event_type"), ["user_id"], "ts").select("user_id", "value", "event_type")


@query("upsert_first_wins", "SELECT user_id, event_type, arg_min(value, ts) AS value FROM events GROUP BY ALL")
def upsert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(load(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "value")


@query("snapshot_scan", f"WITH {FILES_SQL} SELECT file_id, path FROM files WHERE language = 'typescript'")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the active generation; a language stands for it."""
    active = spark.range(1).select(F.lit("typescript").alias("language"))
    return files(spark, sf_dir).join(F.broadcast(active), "language", "left_semi").select("file_id", "path")


@query("index_status", f"WITH {FILES_SQL}, {CHUNKS_SQL}, {TOUCHED_SQL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT label) FROM chunks) AS symbols, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT sha) FROM touched) AS commits")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).agg(F.countDistinct("label").alias("symbols"), F.count("*").alias("chunks"))
    f = files(spark, sf_dir).agg(F.count("*").alias("files"))
    n = load(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("commits"))
    return f.crossJoin(c).crossJoin(n)


@query("branch_list", "SELECT name, left(sha256(name), 7) AS sha, row_number() OVER (ORDER BY name <> 'BUILDING', name)::INTEGER AS place FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)")
def branch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct branches (market segments), the default one first, with a short sha."""
    names = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    place = F.row_number().over(W.orderBy(F.col("name") != "BUILDING", "name"))
    return names.select("name", F.left(F.sha2(F.col("name").cast("binary"), 256), F.lit(7)).alias("sha"), place.alias("place"))


@query(
    "ref_search",
    """WITH refs AS (SELECT 0 AS kind, 'branch-' || n_name AS name, n_nationkey % 10 AS sha FROM nation UNION ALL SELECT 1, 'tag-' || r_name, r_regionkey FROM region UNION ALL SELECT 2, 'commit-' || s_name, s_suppkey % 20 FROM supplier),
    hit AS (SELECT * FROM refs WHERE contains(lower(name), 'a')), one AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY kind, name) AS n FROM hit)
    SELECT kind, name, sha::BIGINT AS sha FROM one WHERE n = 1 ORDER BY kind, name LIMIT 15""",
)
def ref_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, then tags, then commits that match; a commit that a branch or tag names is not repeated."""
    branch = load(spark, sf_dir, "nation").select(F.lit(0).alias("kind"), F.concat(F.lit("branch-"), "n_name").alias("name"), (F.col("n_nationkey") % 10).cast("bigint").alias("sha"))
    tag = load(spark, sf_dir, "region").select(F.lit(1).alias("kind"), F.concat(F.lit("tag-"), "r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("sha"))
    commit = load(spark, sf_dir, "supplier").select(F.lit(2).alias("kind"), F.concat(F.lit("commit-"), "s_name").alias("name"), (F.col("s_suppkey") % 20).cast("bigint").alias("sha"))
    hits = branch.unionByName(tag).unionByName(commit).where(F.contains(F.lower("name"), F.lit("a")))
    first = hits.groupBy("sha").agg(F.min(F.struct("kind", "name")).alias("m"))
    return first.select("m.kind", "m.name", "sha").orderBy("kind", "name").limit(15)


@query("sink_roundtrip", f"WITH {FILES_SQL} SELECT language, count(*) AS n, sum(loc)::BIGINT AS loc FROM files GROUP BY language")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as partitioned Parquet and read back."""
    from changelens.sources.tables_sink import write_generation

    path = write_generation(files(spark, sf_dir), "language")
    return spark.read.parquet(path).groupBy("language").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))
