"""Historical evaluation over the newest commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import evaluation as ev
from changelens.plans.embed_queries import NEAR_SQL, VECTORS_SQL, hits
from changelens.plans.graph_queries import edge_paths
from changelens.plans.registry import query
from changelens.sources.tables import COMMITS_SQL, EDGES_SQL, FILES_SQL, TEXTS_SQL, TOUCHED_SQL, commit_items, commits, files
from changelens.sources.tables_sink import stored

LIMIT, MOST, KS, NEAR = 200, 20, (5, 10), 20

_EVAL = f"""WITH {FILES_SQL}, {EDGES_SQL}, {TOUCHED_SQL}, {COMMITS_SQL},
recent AS (SELECT * FROM commits ORDER BY author_date DESC NULLS LAST, sha LIMIT {LIMIT}),
tp AS (SELECT DISTINCT sha, path FROM touched JOIN recent USING (sha) JOIN files USING (file_id)),
judged AS (SELECT r.sha, coalesce(list_sort(list(path) FILTER (WHERE path IS NOT NULL)), []) AS paths FROM recent r LEFT JOIN tp USING (sha) GROUP BY r.sha),
j AS (SELECT *, CASE WHEN len(paths) = 0 THEN 'no_indexed_code_files' WHEN len(paths) < 2 THEN 'fewer_than_two_code_files' WHEN len(paths) > {MOST} THEN 'too_many_files' END AS skipped FROM judged),
scenarios AS (SELECT sha, paths[-1] AS known, paths[1:len(paths) - 1] AS truth FROM j WHERE skipped IS NULL),
known AS (SELECT DISTINCT known FROM scenarios),
dep AS (SELECT known, row_number() OVER (PARTITION BY known ORDER BY path)::INTEGER AS rn, path FROM (SELECT DISTINCT known, a.path FROM known JOIN files b ON b.path = known JOIN edges ON dst = b.file_id JOIN files a ON a.file_id = src)),
cn AS (SELECT path, count(*) AS n FROM tp GROUP BY path),
cp AS (SELECT a.path AS known, b.path, round(least(1e0, count(*) / sqrt(any_value(x.n) * any_value(y.n)::DOUBLE)), 6) AS score FROM tp a JOIN known ON known.known = a.path JOIN tp b ON a.sha = b.sha AND a.path <> b.path JOIN cn x ON x.path = a.path JOIN cn y ON y.path = b.path GROUP BY ALL),
co AS (SELECT known, row_number() OVER (PARTITION BY known ORDER BY score DESC, path)::INTEGER AS rn, path FROM cp),
{TEXTS_SQL}, {VECTORS_SQL}, asked AS (SELECT known AS id, known AS text FROM known), {NEAR_SQL},
sem AS (SELECT id AS known, row_number() OVER (PARTITION BY id ORDER BY rank)::INTEGER AS rn, path FROM near JOIN files USING (file_id) WHERE rank <= {NEAR} AND path <> id),
hy AS (SELECT known, row_number() OVER (PARTITION BY known ORDER BY score DESC, path)::INTEGER AS rn, path FROM (SELECT known, path, round(sum(1e0 / rn), 6) AS score FROM (FROM dep UNION ALL FROM co UNION ALL FROM sem) GROUP BY ALL)),
preds AS (SELECT 'dependency_only' AS method, * FROM dep UNION ALL SELECT 'cochange_only', * FROM co UNION ALL SELECT 'semantic_only', * FROM sem UNION ALL SELECT 'hybrid', * FROM hy),
base AS (SELECT sha, s.known, truth, len(truth) AS t, m.method FROM scenarios s, (VALUES ('dependency_only'), ('cochange_only'), ('semantic_only'), ('hybrid')) m(method)),
hits AS (SELECT sha, b.method, t, rn, coalesce(list_contains(truth, path), false)::INTEGER AS hit FROM base b LEFT JOIN preds p ON p.known = b.known AND p.method = b.method),
h2 AS (SELECT *, sum(hit) OVER (PARTITION BY sha, method ORDER BY rn) AS so_far FROM hits),
agg AS (SELECT sha, method, k, t, count(*) FILTER (WHERE rn <= k) AS n, coalesce(sum(hit) FILTER (WHERE rn <= k), 0) AS h, min(rn) FILTER (WHERE hit = 1) AS first, coalesce(sum(so_far / rn::DOUBLE) FILTER (WHERE rn <= k AND hit = 1), 0) AS ap,
  coalesce(sum(1 / log2(rn + 1)) FILTER (WHERE rn <= k AND hit = 1), 0) AS dcg FROM h2, (VALUES (5), (10)) ks(k) GROUP BY ALL),
pr AS (SELECT *, coalesce(round(h / nullif(n, 0)::DOUBLE, 4), 0e0) AS precision, coalesce(round(h / nullif(t, 0)::DOUBLE, 4), 0e0) AS recall FROM agg),
metrics AS (SELECT sha, method, k, precision, recall, coalesce(round(2 * precision * recall / nullif(precision + recall, 0), 4), 0e0) AS f1, coalesce(round(1e0 / first, 4), 0e0) AS mrr, round(ap / least(t, k), 4) AS map,
  round(dcg / list_sum(list_transform(range(1, least(t, k) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg FROM pr),
summary AS (SELECT method, k, {", ".join(f"round(avg({m}::DECIMAL(10,4)), 4) AS {m}" for m in ev.NAMES)}, count(*) AS n FROM metrics GROUP BY method, k)"""


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recent_commits(commits(spark, sf_dir), LIMIT)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.judged(_recent(spark, sf_dir), commit_items(spark, sf_dir), files(spark, sf_dir), MOST)


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.scenarios(_judged(spark, sf_dir))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenarios(spark, sf_dir).select("known").distinct()


def _dependency(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    known = known or stored(_known(spark, sf_dir))
    return ev.by_dependency(known, edge_paths(spark, sf_dir, known.withColumnRenamed("known", "path")))


def _cochange(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    rows = commit_items(spark, sf_dir).join(_recent(spark, sf_dir).select("sha"), "sha").join(files(spark, sf_dir).select("file_id", "path"), "file_id")
    return ev.by_cochange(known or _known(spark, sf_dir), rows)


def _semantic(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """A known file is asked for by its path."""
    asked = (known or _known(spark, sf_dir)).select(F.col("known").alias("id"), F.col("known").alias("text"))
    found = hits(spark, sf_dir, asked, NEAR).join(files(spark, sf_dir).select("file_id", "path"), "file_id")
    return ev.by_semantic(found.select(F.col("query_id").alias("known"), "rank", "path"))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = stored(_known(spark, sf_dir))
    return ev.hybrid([f(spark, sf_dir, known) for f in (_dependency, _cochange, _semantic)])


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios and the three lists are computed once; the fourth comes from them."""
    scenarios = stored(_scenarios(spark, sf_dir))
    known = stored(scenarios.select("known").distinct())
    lists = None
    for name, f in (("dependency_only", _dependency), ("cochange_only", _cochange), ("semantic_only", _semantic)):
        rows = f(spark, sf_dir, known).withColumn("method", F.lit(name))
        lists = rows if lists is None else lists.unionByName(rows)
    lists = stored(lists)
    return ev.metrics(scenarios, lists.unionByName(ev.hybrid([lists.drop("method")]).withColumn("method", F.lit("hybrid"))), KS)


@query("recent_commits", f"{_EVAL} SELECT sha, author_date FROM recent")
def recent_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir).select("sha", "author_date")


@query("eval_scenarios", f"{_EVAL} SELECT sha, known, array_to_string(truth, ',') AS truth FROM scenarios")
def eval_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenarios(spark, sf_dir).withColumn("truth", F.array_join("truth", ","))


@query("eval_skips", f"{_EVAL} SELECT skipped AS reason, count(*) AS n FROM j WHERE skipped IS NOT NULL GROUP BY skipped")
def eval_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("skipped IS NOT NULL").groupBy(F.col("skipped").alias("reason")).agg(F.count("*").alias("n"))


for _name, _frame, _table in (("eval_dependency", _dependency, "dep"), ("eval_cochange", _cochange, "co"), ("eval_semantic", _semantic, "sem"), ("eval_hybrid", _hybrid, "hy")):
    query(_name, f"{_EVAL} SELECT known, rn, path FROM {_table}")(_frame)


@query("hybrid_rr", f"{_EVAL} SELECT known, rn, round(1e0 / rn, 6) AS reciprocal FROM hy")
def hybrid_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("known", "rn", F.round(1 / F.col("rn"), 6).alias("reciprocal"))


def _metric(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _metrics(spark, sf_dir).select("sha", "method", "k", name)

    return run


for _name, _column in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("f1_at_k", "f1"), ("mrr", "mrr"), ("map_at_k", "map"), ("ndcg_at_k", "ndcg")):
    query(_name, f"{_EVAL} SELECT sha, method, k, {_column} FROM metrics")(_metric(_column))


@query("eval_all_metrics", f"{_EVAL} SELECT * FROM metrics")
def eval_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query("eval_summary", f"{_EVAL} SELECT * FROM summary")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summary(_metrics(spark, sf_dir))


@query(
    "eval_report",
    f"""{_EVAL}, l AS (SELECT method, unnest([{", ".join(f"'- {m}@' || k || ': ' || printf('%.4f', {m})" for m in ev.NAMES)}]) AS line FROM summary)
    SELECT method, '## ' || method || chr(10) || string_agg(line, chr(10) ORDER BY line) AS section FROM l GROUP BY method""",
)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.report(ev.summary(_metrics(spark, sf_dir)))
