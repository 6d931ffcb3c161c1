"""Risk, test recommendation and impact prediction."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.operators import cochange, embed, impact, risk, search, tests_rec
from changelens.plans.embed_queries import NEAR_SQL, VECTORS_SQL, hits
from changelens.plans.graph_queries import BFS_SQL, CHANGED_SQL, COCHANGE_SQL, changed, touched
from changelens.plans.registry import query
from changelens.plans.text_queries import complexity_score
from changelens.sources.tables import (
    COMMITS_SQL, EDGES_SQL, FILES_SQL, ITEMS_SQL, SOURCE_FILES_SQL, TEXTS_SQL, TOUCHED_SQL,
    commit_items, commits, edges, files, load,
)
from changelens.sources.tables_sink import shared_folder, stored

_COMPLEXITY_SQL = rf"""{SOURCE_FILES_SQL}, complex AS (SELECT file_id, least(1.0, round((len(regexp_extract_all(content, '{T.JS_BRANCHES}')) * 0.08::DECIMAL(3,2) + len(regexp_extract_all(content, '\band\b')) * 0.12::DECIMAL(3,2)
  + len(regexp_extract_all(content, '\bfunction\b|=>|\bof\b')) * 0.03::DECIMAL(3,2))::DECIMAL(18,4), 4)::DOUBLE)::DOUBLE AS complexity FROM source_files)"""
RISK_SQL = _COMPLEXITY_SQL + """, fan AS (SELECT file_id, sum(i) AS fi, sum(o) AS fo FROM (SELECT dst AS file_id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY file_id),
ch AS (SELECT file_id, count(*) AS ch FROM items GROUP BY file_id),
bf AS (SELECT file_id, count(DISTINCT sha) AS bf FROM items JOIN commits USING (sha) WHERE regexp_matches(lower(message), 'fix|bug|regression|hotfix|patch|broken') GROUP BY file_id),
raw AS (SELECT f.*, coalesce(fi, 0) AS fi, coalesce(fo, 0) AS fo, coalesce(ch, 0) AS ch, coalesce(bf, 0) AS bf, coalesce(complexity, 0) AS cx FROM files f LEFT JOIN complex USING (file_id) LEFT JOIN fan USING (file_id) LEFT JOIN ch USING (file_id) LEFT JOIN bf USING (file_id)),
parts AS (SELECT file_id, path, language, loc, is_test, round(least(fi / 10e0, 1e0), 4) AS fan_in, round(least(fo / 10e0, 1e0), 4) AS fan_out, round(least((fi + fo) / 20e0, 1e0), 4) AS centrality,
  round(least(ch / 20e0, 1e0), 4) AS churn, round(least(cx, 1e0), 4) AS complexity, round(least(loc / 500e0, 1e0), 4) AS file_size, round(least(bf / 8e0, 1e0), 4) AS bugfix_frequency, CASE WHEN is_test THEN 0e0 ELSE 0.2e0 END AS test_coverage_proxy FROM raw),
risks AS (SELECT *, least(1e0, round(fan_in::DECIMAL(6,4) * 0.25::DECIMAL(3,2) + fan_out::DECIMAL(6,4) * 0.10::DECIMAL(3,2) + centrality::DECIMAL(6,4) * 0.10::DECIMAL(3,2) + churn::DECIMAL(6,4) * 0.20::DECIMAL(3,2)
  + complexity::DECIMAL(6,4) * 0.15::DECIMAL(3,2) + file_size::DECIMAL(6,4) * 0.10::DECIMAL(3,2) + bugfix_frequency::DECIMAL(6,4) * 0.15::DECIMAL(3,2) + test_coverage_proxy::DECIMAL(6,4) * 0.05::DECIMAL(3,2), 4)::DOUBLE) AS score FROM parts)"""
_RISK = f"WITH {FILES_SQL}, {EDGES_SQL}, {ITEMS_SQL}, {COMMITS_SQL}, {RISK_SQL}"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.components(files(spark, sf_dir), edges(spark, sf_dir), commit_items(spark, sf_dir), commits(spark, sf_dir), complexity_score(spark, sf_dir))


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.scored(_parts(spark, sf_dir))


@query("risk_components", f"{_RISK} SELECT file_id, fan_in, fan_out, centrality, churn, complexity, file_size, bugfix_frequency, test_coverage_proxy FROM parts")
def risk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("file_id", *risk.WEIGHTS)


@query("risk_score", f"{_RISK} SELECT file_id, score FROM risks")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).select("file_id", "score")


def _reason_sql() -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {k} >= 0.5 THEN '{v}' END" for k, v in risk.REASONS.items()) + ")"


@query("risk_reasons", f"{_RISK} SELECT file_id, {_reason_sql()} AS reasons FROM risks")
def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).select("file_id", F.array_join("reasons", "; ").alias("reasons"))


@query("risk_ranking", f"{_RISK} SELECT file_id, path, score FROM risks WHERE NOT is_test AND language = 'python' AND contains(lower(path), 'brand1') ORDER BY score DESC, path LIMIT 20")
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.ranking(_risks(spark, sf_dir), language="python", search="BRAND1").select("file_id", "path", "score")


@query("mean_risk", f"{_RISK} SELECT round(avg(score::DECIMAL(6,4)), 4) AS mean_risk, count(*) AS n FROM risks WHERE NOT is_test")
def mean_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.mean(_risks(spark, sf_dir))


@query("risk_histogram", f"{_RISK} SELECT bucket::BIGINT AS bucket, count(file_id) AS n FROM range(4) b(bucket) LEFT JOIN risks ON least(3, floor(4 * greatest(0, least(1, score)))) = bucket GROUP BY bucket")
def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files lie in each quarter of the scale, empty ones too."""
    bucket = F.least(F.lit(3), F.floor(4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))).cast("bigint")
    n = _risks(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(4).toDF("bucket").join(n, "bucket", "left").fillna(0, ["n"])


@query(
    "component_means",
    f"{_RISK}, m AS (UNPIVOT (SELECT fan_in, fan_out, centrality, churn, complexity, file_size, bugfix_frequency, test_coverage_proxy FROM parts) ON COLUMNS(*) INTO NAME component VALUE v) SELECT component, round(avg(v), 4) AS mean FROM m GROUP BY component ORDER BY mean DESC, component LIMIT 4",
)
def component_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four components with the largest mean."""
    wide = _parts(spark, sf_dir).agg(*[F.round(F.avg(c), 4).alias(c) for c in risk.WEIGHTS])
    return wide.unpivot([], list(risk.WEIGHTS), "component", "mean").orderBy(F.desc("mean"), "component").limit(4)


@query(
    "risk_matrix",
    f"{_RISK}, d AS (SELECT file_id, loc, fi + fo AS degree FROM raw) SELECT count(*) AS high_impact FROM d, (SELECT max(loc) AS ml, max(degree) AS md FROM d) WHERE loc >= 0.4 * greatest(10, ml) AND degree >= 0.4 * greatest(1, md)",
)
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files are both large and well connected."""
    from changelens.operators.graph import fan_counts

    d = files(spark, sf_dir).select("file_id", "loc").join(fan_counts(edges(spark, sf_dir)), "file_id", "left").fillna(0)
    d = d.withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    most = d.agg(F.max("loc").alias("ml"), F.max("degree").alias("md"))
    kept = d.crossJoin(F.broadcast(most)).where((F.col("loc") >= 0.4 * F.greatest(F.lit(10), "ml")) & (F.col("degree") >= 0.4 * F.greatest(F.lit(1), "md")))
    return kept.agg(F.count("*").alias("high_impact"))


@query(
    "risk_severity",
    f"""{_RISK}, m AS (SELECT round(avg(score::DECIMAL(6,4)), 4) AS mean FROM risks) SELECT file_id, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN round(score - mean, 4) > 0.05 THEN 'above' WHEN round(score - mean, 4) < -0.05 THEN 'below' ELSE 'near' END AS against_mean FROM risks, m""",
)
def risk_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _risks(spark, sf_dir)
    gap = F.round(F.col("score") - F.col("mean_risk"), 4)
    both = r.crossJoin(F.broadcast(risk.mean(r, include_tests=True).select("mean_risk")))
    return both.select("file_id", risk.severity(F.col("score")).alias("severity"), F.when(gap > 0.05, "above").when(gap < -0.05, "below").otherwise("near").alias("against_mean"))


@query("risk_breakdown", f"{_RISK} SELECT file_id, round(file_size * 500)::BIGINT AS loc_signal, round(fan_in * 10)::BIGINT AS fan_in_signal, round(churn * 20)::BIGINT AS churn_signal, round(bugfix_frequency * 8)::BIGINT AS bugfix_signal FROM parts")
def risk_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw signals back from the scaled components."""
    raw = [("file_size", 500, "loc_signal"), ("fan_in", 10, "fan_in_signal"), ("churn", 20, "churn_signal"), ("bugfix_frequency", 8, "bugfix_signal")]
    return _parts(spark, sf_dir).select("file_id", *[F.round(F.col(c) * s).cast("bigint").alias(n) for c, s, n in raw])


# --- test recommendation -----------------------------------------------------------------

_PATHS = r"""t AS (SELECT file_id AS test_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, string_split(path, '/') AS parts,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM files WHERE is_test),
s AS (SELECT file_id AS source_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS parent_name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM {sources})"""
_NAMING = r"""naming AS (SELECT test_id, source_id, max(CASE WHEN name IN ('test_' || s.stem || '.py', s.stem || '_test.py', s.stem || '.test.ts', s.stem || '.test.js', s.stem || '.spec.ts', s.stem || '.spec.js') THEN 0.85e0 ELSE 0.65e0 END) AS score
  FROM t JOIN s ON name IN ('test_' || s.stem || '.py', s.stem || '_test.py', s.stem || '.test.ts', s.stem || '.test.js', s.stem || '.spec.ts', s.stem || '.spec.js') OR (list_contains(parts, 'tests') AND contains(t.stem, s.stem)) GROUP BY ALL)"""
_PROXIMITY = "proximity AS (SELECT test_id, source_id, CASE WHEN t.parent = s.parent THEN 0.55e0 WHEN list_contains(parts, 'tests') THEN 0.5e0 ELSE 0.45e0 END AS score FROM t JOIN s ON t.parent = s.parent OR (parent_name <> '' AND list_contains(parts, parent_name)))"
_CO = """co AS (SELECT b AS test_id, a AS source_id, least(0.75e0, round(joint / sqrt(x.n * y.n::DOUBLE), 6)) AS score FROM pairs JOIN counts x ON x.file_id = a JOIN counts y ON y.file_id = b JOIN files f ON f.file_id = b AND f.is_test)"""
_IMPORT = "imp AS (SELECT DISTINCT src AS test_id, dst AS source_id, 0.95e0 AS score FROM edges JOIN files f ON f.file_id = src AND f.is_test WHERE dst IN (SELECT source_id FROM s))"
HITS_SQL = f"""{TEXTS_SQL}, {VECTORS_SQL}, asked AS (SELECT 0 AS id, 'Changed files:' || chr(10) || string_agg(path, chr(10)) || chr(10) || 'Changed symbols:' || chr(10) || string_agg('run_' || file_id, chr(10)) AS text FROM changed), {NEAR_SQL},
hits AS (SELECT chunk_id, file_id, score FROM near WHERE rank <= 50), sem AS (SELECT file_id, max(score) AS score FROM hits WHERE score > 0 GROUP BY file_id)"""
_PATH_HITS = HITS_SQL.replace("'Changed files:' || chr(10) || string_agg(path, chr(10)) || chr(10) || 'Changed symbols:' || chr(10) || string_agg('run_' || file_id, chr(10))", "string_agg(path, chr(10))")
_TESTS = f"WITH {FILES_SQL}, {CHANGED_SQL}, {TOUCHED_SQL}, {EDGES_SQL}, {COCHANGE_SQL}, {_PATH_HITS}, {_PATHS.format(sources='changed')}, {_NAMING}, {_PROXIMITY}, {_CO}, {_IMPORT}"
_SIGNALS = """signals AS (SELECT *, 0 AS signal FROM naming UNION ALL SELECT *, 1 FROM proximity UNION ALL SELECT *, 2 FROM co UNION ALL SELECT *, 3 FROM imp
  UNION ALL SELECT sem.file_id, NULL, least(sem.score, 0.8e0), 4 FROM sem JOIN files f ON f.file_id = sem.file_id AND f.is_test),
recommended AS (SELECT test_id, round(least(1e0, max(score)), 4) AS score, list_sort(list_distinct(list(signal))) AS sig, list_sort(list_distinct(list(source_id))) AS linked FROM signals WHERE score > 0 GROUP BY test_id),
recommended_tests AS (SELECT test_id, path, score, array_to_string(list_transform(sig, lambda i: ['naming', 'proximity', 'co-change', 'import', 'semantic'][i + 1]), '; ') AS reasons, coalesce(array_to_string(linked, ','), '') AS linked FROM recommended JOIN files ON file_id = test_id)"""


def semantic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 chunks nearest to the text of the change: its paths and its symbols."""
    rows = changed(spark, sf_dir).withColumn("change_id", F.lit(0))
    asked = embed.change_texts(rows, rows.select("change_id", F.concat(F.lit("run_"), "file_id").alias("name")))
    return hits(spark, sf_dir, asked, 50)


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best_by_file(semantic_hits(spark, sf_dir).where("score > 0"))


def semantic_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the changed paths alone, as tests are sought."""
    asked = embed.path_texts(changed(spark, sf_dir).withColumn("change_id", F.lit(0)))
    return search.best_by_file(hits(spark, sf_dir, asked, 50).where("score > 0"))


@query("tests_naming", f"{_TESTS} SELECT * FROM naming")
def tests_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests_rec.naming(files(spark, sf_dir), changed(spark, sf_dir))


@query("tests_proximity", f"{_TESTS} SELECT * FROM proximity")
def tests_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests_rec.proximity(files(spark, sf_dir), changed(spark, sf_dir))


@query("tests_cochange", f"{_TESTS} SELECT * FROM co")
def tests_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests_rec.by_cochange(files(spark, sf_dir), changed(spark, sf_dir), touched(spark, sf_dir))


@query("tests_imports", f"{_TESTS} SELECT * FROM imp")
def tests_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tests_rec.by_import(files(spark, sf_dir), changed(spark, sf_dir), edges(spark, sf_dir))


@query("tests_semantic", f"{_TESTS} SELECT sem.file_id AS test_id, least(sem.score, 0.8e0) AS score FROM sem JOIN files f ON f.file_id = sem.file_id AND f.is_test")
def tests_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic_of_paths(spark, sf_dir).join(files(spark, sf_dir).where("is_test").select("file_id"), "file_id", "left_semi")
    return found.select(F.col("file_id").alias("test_id"), F.least("score", F.lit(0.8)).alias("score"))


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    found = tests_rec.signals(f, changed(spark, sf_dir), edges(spark, sf_dir), touched(spark, sf_dir), semantic_of_paths(spark, sf_dir))
    return tests_rec.recommend(found, f, None)


@query("tests_ranked", f"{_TESTS}, {_SIGNALS} SELECT test_id, path, score FROM recommended_tests ORDER BY score DESC, path LIMIT 10")
def tests_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir).orderBy(F.desc("score"), "path").limit(10).select("test_id", "path", "score")


@query("tests_reasons", f"{_TESTS}, {_SIGNALS} SELECT test_id, reasons FROM recommended_tests")
def tests_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir).select("test_id", "reasons")


@query("tests_linked", f"{_TESTS}, {_SIGNALS} SELECT test_id, linked FROM recommended_tests")
def tests_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recommended(spark, sf_dir).select("test_id", F.array_join(F.col("linked").cast("array<string>"), ",").alias("linked"))


# --- impact ------------------------------------------------------------------------------

_ALL = f"""WITH {FILES_SQL}, {CHANGED_SQL}, {TOUCHED_SQL}, {EDGES_SQL}, {ITEMS_SQL}, {COMMITS_SQL}, {COCHANGE_SQL}, {HITS_SQL}, {BFS_SQL}, {RISK_SQL},
dep AS (SELECT file_id, max(CASE distance WHEN 1 THEN 1e0 WHEN 2 THEN 0.65e0 WHEN 3 THEN 0.4e0 ELSE 0.2e0 END) AS score, count(*) AS n_reasons FROM bfs GROUP BY file_id),
{_PATHS.format(sources="(SELECT * FROM files WHERE NOT is_test)")}, {_NAMING}, {_PROXIMITY}, {_IMPORT},
tst AS (SELECT test_id AS file_id, round(max(score), 4) AS score FROM (FROM naming UNION ALL FROM proximity UNION ALL FROM imp) GROUP BY test_id),
joined AS (SELECT f.file_id, f.path, coalesce(dep.score, 0e0) AS dependency, coalesce(sem.score, 0e0) AS semantic, coalesce(cochange.score, 0e0) AS cochange, coalesce(tst.score, 0e0) AS test, coalesce(risks.score, 0e0) AS risk
  FROM files f LEFT JOIN dep USING (file_id) LEFT JOIN sem USING (file_id) LEFT JOIN cochange USING (file_id) LEFT JOIN tst USING (file_id) LEFT JOIN risks USING (file_id) WHERE f.file_id NOT IN (SELECT file_id FROM changed)),
impact AS (SELECT *, least(1e0, round(dependency::DECIMAL(10,6) * 0.35::DECIMAL(3,2) + semantic::DECIMAL(10,6) * 0.25::DECIMAL(3,2) + cochange::DECIMAL(10,6) * 0.20::DECIMAL(3,2) + test::DECIMAL(10,6) * 0.10::DECIMAL(3,2) + risk::DECIMAL(10,6) * 0.10::DECIMAL(3,2), 4)::DOUBLE) AS score
  FROM joined WHERE dependency > 0 OR semantic > 0 OR cochange > 0 OR test > 0 OR risk >= 0.5),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank FROM impact ORDER BY score DESC, path LIMIT 20)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.candidates(
        files(spark, sf_dir), stored(edges(spark, sf_dir)), commit_items(spark, sf_dir), commits(spark, sf_dir), stored(changed(spark, sf_dir)), semantic(spark, sf_dir),
        complexity=complexity_score(spark, sf_dir),
    )


@query("impact_candidates", f"{_ALL} SELECT * FROM impact")
def impact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


@query("impact_final", f"{_ALL} SELECT file_id, score FROM impact")
def impact_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("file_id", "score")


@query("impact_rank", f"{_ALL} SELECT rank, file_id, path, score, dependency, semantic, cochange, test, risk FROM top")
def impact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the twenty files a change of three files affects most."""
    return impact.ranked(_candidates(spark, sf_dir)).select("rank", "file_id", "path", "score", *impact.WEIGHTS)


@query("impact_dependency", f"{_ALL} SELECT file_id, score, n_reasons FROM dep")
def impact_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.by_dependency(edges(spark, sf_dir), changed(spark, sf_dir))


@query("dependency_score", "SELECT user_id, event_id, least(1e0, CASE d WHEN 1 THEN 1e0 WHEN 2 THEN 0.65e0 WHEN 3 THEN 0.4e0 ELSE 0.2e0 END + least(0.2e0, 0.08e0 * greatest(n - 1, 0))) AS score FROM (SELECT user_id, event_id, user_id % 5 + 1 AS d, event_id % 6 AS n FROM events)")
def dependency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and path counts from the event log."""
    e = load(spark, sf_dir, "events")
    return e.select("user_id", "event_id", impact.dependency_score(F.col("user_id") % 5 + 1, F.col("event_id") % 6).alias("score"))


@query("impact_semantic", f"{_ALL} SELECT file_id, score, (SELECT count(*) FROM hits h WHERE h.file_id = sem.file_id) AS n_reasons FROM sem")
def impact_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_hits(spark, sf_dir).groupBy("file_id").agg(F.max("score").alias("score"), F.count("*").alias("n_reasons")).where("score > 0")


@query("impact_cochange", f"{_ALL} SELECT file_id, score FROM cochange WHERE file_id NOT IN (SELECT file_id FROM changed)")
def impact_cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = changed(spark, sf_dir)
    return cochange.cosine(touched(spark, sf_dir), c).join(c.select("file_id"), "file_id", "left_anti")


@query("impact_test", f"{_ALL} SELECT file_id, score FROM tst")
def impact_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.test_component(files(spark, sf_dir), edges(spark, sf_dir))


@query("impact_risk", f"{_ALL} SELECT file_id, risk AS score, dependency > 0 OR semantic > 0 OR cochange > 0 OR test > 0 OR risk >= 0.5 AS has_reason FROM joined")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk component, and whether it is given as a reason."""
    r = _risks(spark, sf_dir).join(changed(spark, sf_dir).select("file_id"), "file_id", "left_anti").select("file_id", "score")
    given = _candidates(spark, sf_dir).select("file_id", F.lit(True).alias("given"))
    return r.join(given, "file_id", "left").select("file_id", "score", F.coalesce("given", F.lit(False)).alias("has_reason"))


@query("component_max", f"{_ALL} SELECT component, round(max(v), 6) AS most FROM (UNPIVOT (SELECT dependency, semantic, cochange, test, risk FROM impact) ON COLUMNS(*) INTO NAME component VALUE v) GROUP BY component")
def component_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _candidates(spark, sf_dir).agg(*[F.round(F.max(c), 6).alias(c) for c in impact.WEIGHTS])
    return wide.unpivot([], list(impact.WEIGHTS), "component", "most")


@query("risk_summary", f"{_ALL} SELECT file_id, risk FROM (SELECT * FROM impact ORDER BY risk DESC, path LIMIT 5) WHERE risk > 0")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five riskiest candidates; those without risk go after the cut."""
    return _candidates(spark, sf_dir).orderBy(F.desc("risk"), "path").limit(5).where("risk > 0").select("file_id", "risk")


_FINAL_TESTS = f"""{_ALL},
chosen AS (SELECT file_id, path FROM changed UNION SELECT file_id, path FROM top)"""


def _for_chosen(spark: SparkSession, sf_dir: str, top: DataFrame) -> DataFrame:
    chosen = changed(spark, sf_dir).union(top.select("file_id", "path")).distinct()
    return tests_rec.signals(files(spark, sf_dir), chosen, edges(spark, sf_dir)).where("source_id <> test_id")


def _for_impacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_chosen(spark, sf_dir, impact.ranked(_candidates(spark, sf_dir)))


_CHOSEN = r""", s2 AS (SELECT file_id AS source_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS parent_name, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM chosen),
n2 AS (SELECT test_id, source_id, max(CASE WHEN name IN ('test_' || s2.stem || '.py', s2.stem || '_test.py', s2.stem || '.test.ts', s2.stem || '.test.js', s2.stem || '.spec.ts', s2.stem || '.spec.js') THEN 0.85e0 ELSE 0.65e0 END) AS score
  FROM t JOIN s2 ON name IN ('test_' || s2.stem || '.py', s2.stem || '_test.py', s2.stem || '.test.ts', s2.stem || '.test.js', s2.stem || '.spec.ts', s2.stem || '.spec.js') OR (list_contains(parts, 'tests') AND contains(t.stem, s2.stem)) GROUP BY ALL),
p2 AS (SELECT test_id, source_id, CASE WHEN t.parent = s2.parent THEN 0.55e0 WHEN list_contains(parts, 'tests') THEN 0.5e0 ELSE 0.45e0 END AS score FROM t JOIN s2 ON t.parent = s2.parent OR (parent_name <> '' AND list_contains(parts, parent_name))),
i2 AS (SELECT DISTINCT src AS test_id, dst AS source_id, 0.95e0 AS score FROM edges JOIN files f ON f.file_id = src AND f.is_test WHERE dst IN (SELECT source_id FROM s2)),
sig2 AS (SELECT * FROM (FROM n2 UNION ALL FROM p2 UNION ALL FROM i2) WHERE source_id <> test_id)"""


@query("impact_recommended_tests", f"{_FINAL_TESTS}{_CHOSEN} SELECT test_id, files.path, score FROM (SELECT test_id, round(max(score), 4) AS score FROM sig2 GROUP BY test_id) JOIN files ON file_id = test_id ORDER BY score DESC, files.path LIMIT 20")
def impact_recommended_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests for the changed and the twenty most affected files."""
    return tests_rec.recommend(_for_impacted(spark, sf_dir), files(spark, sf_dir), 20).select("test_id", "path", "score")


@query(
    "impact_tests_topn",
    f"{_FINAL_TESTS}{_CHOSEN} SELECT source_id, test_id, n FROM (SELECT source_id, test_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, test_id)::INTEGER AS n FROM (SELECT source_id, test_id, max(score) AS score FROM sig2 GROUP BY ALL)) WHERE n <= 5",
)
def impact_tests_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best tests of each of those files."""
    best = _for_impacted(spark, sf_dir).groupBy("source_id", "test_id").agg(F.max("score").alias("score"))
    n = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), "test_id"))
    return best.withColumn("n", n).where("n <= 5").select("source_id", "test_id", "n")


@query(
    "explain_text",
    f"""{_FINAL_TESTS}{_CHOSEN}, best AS (SELECT f.path, score FROM (SELECT test_id, round(max(score), 4) AS score FROM sig2 GROUP BY test_id) JOIN files f ON f.file_id = test_id ORDER BY score DESC, f.path LIMIT 3)
    SELECT 'Changes in ' || (SELECT string_agg(path, ', ' ORDER BY path) FROM changed) || ' are likely to affect ' || (SELECT string_agg(path, ', ' ORDER BY rank) FROM top WHERE rank <= 3) || '. Changed symbols: '
      || (SELECT string_agg('run_' || file_id, ', ' ORDER BY file_id) FROM changed) || '. Suggested tests: ' || (SELECT string_agg(path, ', ' ORDER BY score DESC, path) FROM best) || '.' AS explanation""",
)
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence that names the changed files and symbols, the most affected files and the
    best tests. Each changed file stands for one symbol."""
    c = changed(spark, sf_dir)
    symbols = c.select(F.concat(F.lit("run_"), "file_id").alias("symbol"), F.col("file_id").alias("place"))
    top = stored(impact.ranked(_candidates(spark, sf_dir)).select("rank", "file_id", "path"))
    best = tests_rec.recommend(_for_chosen(spark, sf_dir, top), files(spark, sf_dir), 3)
    return impact.explanation(c, top, best, symbols)


@query("evidence_json", f"{_RISK} SELECT file_id, to_json({{'path': path, 'is_test': is_test, 'loc': loc}})::VARCHAR AS evidence FROM risks")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", F.to_json(F.struct("path", "is_test", "loc")).alias("evidence"))


@query(
    "input_mode",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'raw_diff' WHEN event_id % 2 = 0 THEN 'changed_files' WHEN event_id % 5 = 0 THEN 'git_diff' ELSE 'error' END AS recorded, CASE WHEN event_id % 2 = 0 THEN 'changed_files' WHEN event_id % 3 = 0 THEN 'raw_diff' WHEN event_id % 5 = 0 THEN 'git_diff' ELSE 'error' END AS used FROM events",
)
def input_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which input of a run is recorded and which is used; they differ if several are given."""
    k = F.col("event_id")
    diff, given, refs = k % 3 == 0, k % 2 == 0, k % 5 == 0
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.when(diff, "raw_diff").when(given, "changed_files").when(refs, "git_diff").otherwise("error").alias("recorded"),
        F.when(given, "changed_files").when(diff, "raw_diff").when(refs, "git_diff").otherwise("error").alias("used"),
    )


@query("impact_run", f"{_ALL} SELECT rank, path, score, dependency, semantic, cochange, test, risk, 'completed' AS status FROM top")
def impact_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written with its predictions, and read back by rank."""
    folder = shared_folder(spark)
    impact.persist_run(lambda: impact.ranked(_candidates(spark, sf_dir)), "run-1", folder, spark)
    return impact.read_run(spark, "run-1", folder).select("rank", "path", "score", *impact.WEIGHTS, "status")


@query("impact_run_failed", "SELECT 'run-1' AS run_id, 'failed' AS status, 'ValueError' AS error, 0 AS n_predictions")
def impact_run_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that breaks off is on record as failed, without predictions."""
    folder = shared_folder(spark)

    def broken() -> DataFrame:
        raise ValueError("no changed file is indexed")

    try:
        impact.persist_run(broken, "run-1", folder, spark)
    except ValueError:
        pass
    return impact.run_states(spark, folder).select("run_id", "status", F.element_at(F.split("error", ":"), 1).alias("error"), F.coalesce("n_predictions", F.lit(0)).cast("int").alias("n_predictions"))
