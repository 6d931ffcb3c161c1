"""Co-change, dependency graph, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import cochange, graph, imports, ordered, partners
from changelens.operators import commit_items as mixed
from changelens.plans.registry import query
from changelens.sources.tables import (
    CHUNKS_SQL, COMMITS_SQL, EDGES_SQL, FILES_SQL, ITEMS_SQL, TOUCHED_SQL,
    chunks, commit_items, commits, edges, files, load,
)


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_items(spark, sf_dir).distinct()


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed files of the example: the three largest sources by loc, then id."""
    return files(spark, sf_dir).where("NOT is_test").orderBy(F.desc("loc"), "file_id").limit(3).select("file_id", "path")


CHANGED_SQL = "changed AS (SELECT file_id, path FROM files WHERE NOT is_test ORDER BY loc DESC, file_id LIMIT 3)"
COCHANGE_SQL = """counts AS (SELECT file_id, count(*) AS n FROM touched GROUP BY file_id),
pairs AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS joint FROM touched a JOIN touched b ON a.sha = b.sha AND a.file_id <> b.file_id
  WHERE a.file_id IN (SELECT file_id FROM changed) GROUP BY ALL),
cochange AS (SELECT b AS file_id, round(max(least(1.0, joint / sqrt(x.n * y.n::DOUBLE))), 6) AS score FROM pairs JOIN counts x ON x.file_id = a JOIN counts y ON y.file_id = b GROUP BY b)"""
_BASE = f"WITH RECURSIVE {FILES_SQL}, {CHANGED_SQL}, {TOUCHED_SQL}"


@query("commit_files", f"WITH {TOUCHED_SQL} SELECT sha, count(*) AS n_files, min(file_id) AS first_file, max(file_id) AS last_file FROM touched GROUP BY sha")
def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file lists of commits, exploded from an array and counted."""
    lists = commit_items(spark, sf_dir).groupBy("sha").agg(F.collect_set("file_id").alias("changed_files"))
    each = lists.select("sha", F.explode("changed_files").alias("file_id"))
    return each.groupBy("sha").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


@query("path_counts", f"WITH {TOUCHED_SQL} SELECT file_id, count(*) AS n FROM touched GROUP BY file_id")
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.path_counts(touched(spark, sf_dir))


@query("cochange_pairs", f"WITH {TOUCHED_SQL} SELECT a.file_id AS a, b.file_id AS b, count(*) AS joint FROM touched a JOIN touched b ON a.sha = b.sha AND a.file_id <> b.file_id GROUP BY ALL")
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.pair_counts(touched(spark, sf_dir))


@query(
    "cochange_partners",
    f"""WITH {TOUCHED_SQL}, counts AS (SELECT file_id, count(*) AS n FROM touched GROUP BY file_id),
    pairs AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS joint FROM touched a JOIN touched b ON a.sha = b.sha AND a.file_id <> b.file_id GROUP BY ALL),
    ranked AS (SELECT a, b, joint, x.n AS n_a, y.n AS n_b, row_number() OVER (PARTITION BY a ORDER BY joint::DOUBLE * joint / y.n DESC, b) AS rank
      FROM pairs JOIN counts x ON x.file_id = a JOIN counts y ON y.file_id = b)
    SELECT a AS file_id, rank::INTEGER AS rank, b AS partner, joint, round(joint / sqrt(n_a * n_b::DOUBLE), 6) AS score FROM ranked WHERE rank <= 3""",
)
def cochange_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest partners of every file; commits of more than five files by bounds,
    unless all pairs are at most twenty a row."""
    return partners.top_partners(commit_items(spark, sf_dir), 3, most_files=5, row_pairs=20)


@query("cochange_cosine", f"{_BASE}, {COCHANGE_SQL} SELECT * FROM cochange")
def cochange_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.cosine(touched(spark, sf_dir), changed(spark, sf_dir))


@query(
    "cochange_jaccard",
    f"""{_BASE}, {COCHANGE_SQL.split("cochange AS")[0].rstrip().rstrip(",")},
    best AS (SELECT b AS file_id, max(joint / (x.n + y.n - joint)) AS s FROM pairs JOIN counts x ON x.file_id = a JOIN counts y ON y.file_id = b GROUP BY b)
    SELECT file_id, round(coalesce(s, 0), 6) AS score FROM counts LEFT JOIN best USING (file_id)""",
)
def cochange_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.jaccard(touched(spark, sf_dir), changed(spark, sf_dir))


@query("churn", f"WITH {ITEMS_SQL} SELECT file_id, count(*) AS churn FROM items GROUP BY file_id")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.churn(commit_items(spark, sf_dir))


@query("bugfix_churn", f"WITH {ITEMS_SQL}, {COMMITS_SQL} SELECT file_id, count(DISTINCT sha) AS bugfix FROM items JOIN commits USING (sha) WHERE regexp_matches(lower(message), 'fix|bug|regression|hotfix|patch|broken') GROUP BY file_id")
def bugfix_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cochange.bugfix_churn(commit_items(spark, sf_dir), commits(spark, sf_dir))


@query("fan_in_out", f"WITH {EDGES_SQL} SELECT file_id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS file_id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY file_id")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_counts(edges(spark, sf_dir))


BFS_SQL = """back AS (SELECT DISTINCT dst AS at_id, src AS to_id FROM edges),
l1 AS (SELECT DISTINCT c.file_id AS start, to_id AS file_id FROM changed c JOIN back ON at_id = c.file_id),
l2 AS (SELECT DISTINCT start, to_id AS file_id FROM l1 JOIN back ON at_id = l1.file_id),
l3 AS (SELECT DISTINCT start, to_id AS file_id FROM l2 JOIN back ON at_id = l2.file_id),
bfs AS (SELECT start, file_id, min(d)::INTEGER AS distance FROM (SELECT *, 1 AS d FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) GROUP BY ALL)"""


@query("reverse_bfs", f"WITH {FILES_SQL}, {CHANGED_SQL}, {EDGES_SQL}, {BFS_SQL} SELECT * FROM bfs")
def reverse_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_dependents(edges(spark, sf_dir), changed(spark, sf_dir))


@query("reverse_deps", f"WITH {FILES_SQL}, {CHANGED_SQL}, {EDGES_SQL}, {BFS_SQL} SELECT * FROM bfs WHERE start <> file_id")
def reverse_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the files themselves."""
    return reverse_bfs(spark, sf_dir).where("start <> file_id")


@query(
    "dependency_paths",
    f"""WITH {FILES_SQL}, {CHANGED_SQL}, {EDGES_SQL}, {BFS_SQL}, n0 AS (SELECT file_id AS start, file_id AS at_id, 1::HUGEINT AS paths FROM changed),
    n1 AS (SELECT n0.start, to_id AS at_id, sum(paths) AS paths FROM n0 JOIN back USING (at_id) GROUP BY ALL),
    n2 AS (SELECT n.start, to_id AS at_id, sum(paths) AS paths FROM n1 n JOIN back USING (at_id) JOIN bfs ON bfs.start = n.start AND bfs.file_id = to_id AND distance = 2 GROUP BY ALL),
    n3 AS (SELECT n.start, to_id AS at_id, sum(paths) AS paths FROM n2 n JOIN back USING (at_id) JOIN bfs ON bfs.start = n.start AND bfs.file_id = to_id AND distance = 3 GROUP BY ALL)
    SELECT start, file_id, distance, paths::DECIMAL(38,0) AS paths, least(1e0, CASE distance WHEN 1 THEN 1e0 WHEN 2 THEN 0.65e0 WHEN 3 THEN 0.4e0 ELSE 0.2e0 END + least(0.2e0, 0.08e0 * (paths - 1)::DOUBLE)) AS score
    FROM (SELECT start, at_id AS file_id, 1 AS distance, paths FROM n1 UNION ALL SELECT start, at_id, 2, paths FROM n2 UNION ALL SELECT start, at_id, 3, paths FROM n3)""",
)
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who depends on the changed files, by how many shortest paths, and the score with them."""
    from changelens.operators.impact import dependency_score

    found = graph.shortest_paths(edges(spark, sf_dir), changed(spark, sf_dir))
    return found.withColumn("score", dependency_score(F.col("distance"), F.col("paths").cast("double")))


_ITEMS = """lists AS (SELECT o_orderkey AS sha, CASE WHEN o_orderstatus <> 'P' THEN list END AS list FROM orders LEFT JOIN (SELECT l_orderkey, '[' || string_agg(CASE l_linenumber
  WHEN 1 THEN '"f' || l_partkey || '"' WHEN 2 THEN '{"path":"f' || l_partkey || '"}' WHEN 3 THEN '{"new_path":"f' || l_partkey || '","old_path":"g"}' WHEN 4 THEN '{"path":"","old_path":"f' || l_partkey || '"}'
  WHEN 5 THEN '{"path":null}' WHEN 6 THEN '"f' || l_partkey || '"' ELSE '7' END, ',' ORDER BY l_linenumber, l_partkey) || ']' AS list FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
items AS (SELECT sha, unnest(CAST(list AS JSON[])) AS item FROM lists WHERE list IS NOT NULL),
parts AS (SELECT sha, json_type(item) AS kind, json_extract_string(item, '$') AS s, nullif(json_extract_string(item, '$.path'), '') AS p, nullif(json_extract_string(item, '$.new_path'), '') AS np, nullif(json_extract_string(item, '$.old_path'), '') AS op FROM items)"""


def _mixed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits whose lists mix strings and objects by line number; open orders have none."""
    line = load(spark, sf_dir, "lineitem")
    name, n = F.concat(F.lit("f"), "l_partkey"), F.col("l_linenumber")
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    item = (
        F.when(n.isin(1, 6), quoted)
        .when(n == 2, F.concat(F.lit('{"path":'), quoted, F.lit("}")))
        .when(n == 3, F.concat(F.lit('{"new_path":'), quoted, F.lit(',"old_path":"g"}')))
        .when(n == 4, F.concat(F.lit('{"path":"","old_path":'), quoted, F.lit("}")))
        .when(n == 5, F.lit('{"path":null}'))
        .otherwise(F.lit("7"))
    )
    lists = line.groupBy(F.col("l_orderkey").alias("sha")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("list"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), "o_orderstatus")
    return orders.join(lists, "sha", "left").select("sha", F.when(F.col("o_orderstatus") != "P", F.col("list")).alias("changed_files"))


@query("commit_paths_renamed", f"WITH {_ITEMS} SELECT DISTINCT sha, path FROM (SELECT sha, CASE kind WHEN 'VARCHAR' THEN s WHEN 'OBJECT' THEN coalesce(p, np, op) END AS path FROM parts) WHERE path IS NOT NULL")
def commit_paths_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed.renamed_paths(_mixed_commits(spark, sf_dir))


@query("commit_paths_plain", f"WITH {_ITEMS} SELECT DISTINCT sha, path FROM (SELECT sha, CASE kind WHEN 'VARCHAR' THEN s WHEN 'OBJECT' THEN p END AS path FROM parts) WHERE path IS NOT NULL")
def commit_paths_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed.plain_paths(_mixed_commits(spark, sf_dir))


@query("commit_paths_churn", f"WITH {_ITEMS} SELECT p AS path, count(*) AS churn FROM parts WHERE kind = 'OBJECT' AND p IS NOT NULL GROUP BY p")
def commit_paths_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed.churn_counts(_mixed_commits(spark, sf_dir))


@query("neighbors", f"WITH {EDGES_SQL}, center AS (SELECT dst AS c FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) SELECT src, dst FROM edges, center WHERE src = c OR dst = c")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges around the file with the most dependents."""
    e = edges(spark, sf_dir)
    center = e.groupBy(F.col("dst").alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(1).select("c")
    return e.join(F.broadcast(center), (F.col("src") == F.col("c")) | (F.col("dst") == F.col("c"))).select("src", "dst")


_SUB_SQL = f"WITH {FILES_SQL}, {EDGES_SQL}, nodes AS (SELECT * FROM files WHERE NOT is_test ORDER BY path LIMIT 500), inside AS (SELECT src, dst FROM edges WHERE src IN (SELECT file_id FROM nodes) AND dst IN (SELECT file_id FROM nodes))"


@query("subgraph", f"{_SUB_SQL} SELECT * FROM inside")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(files(spark, sf_dir), edges(spark, sf_dir), include_tests=False)[1]


@query(
    "subgraph_degree",
    f"""{_SUB_SQL}, d AS (SELECT file_id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS file_id, 1 AS i, 0 AS o FROM inside UNION ALL SELECT src, 0, 1 FROM inside) GROUP BY file_id)
    SELECT file_id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in + fan_out, 0) AS degree FROM nodes LEFT JOIN d USING (file_id)""",
)
def subgraph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, inner = graph.subgraph(files(spark, sf_dir), edges(spark, sf_dir), include_tests=False)
    out = nodes.select("file_id").join(graph.fan_counts(inner), "file_id", "left").fillna(0, ["fan_in", "fan_out"])
    return out.withColumn("degree", F.col("fan_in") + F.col("fan_out"))


@query(
    "graph_filter",
    f"WITH {FILES_SQL}, {EDGES_SQL}, kept AS (SELECT file_id FROM files WHERE contains(lower(path), 'brand2') OR contains(lower(language), 'brand2')) SELECT src, dst FROM edges WHERE src IN (FROM kept) AND dst IN (FROM kept)",
)
def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges whose two ends both match a search."""
    kept = files(spark, sf_dir).where(F.contains(F.lower("path"), F.lit("brand2")) | F.contains(F.lower("language"), F.lit("brand2"))).select("file_id")
    e = edges(spark, sf_dir)
    return e.join(kept.toDF("src"), "src", "left_semi").join(kept.toDF("dst"), "dst", "left_semi").select("src", "dst")


@query(
    "path_tree",
    f"""WITH {FILES_SQL}, p AS (SELECT string_split(path, '/') AS parts FROM files), e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
    SELECT array_to_string(parts[1:depth], '/') AS path, parts[depth] AS name, depth::INTEGER AS depth, bool_or(depth < len(parts)) AS is_folder FROM e GROUP BY ALL""",
)
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_tree(files(spark, sf_dir))


def _layer_sql() -> str:
    cases = " ".join(f"WHEN {' OR '.join(f"contains(low, '{m}')" for m in marks)} THEN '{name}'" for name, marks in graph.LAYERS.items())
    return f"CASE WHEN is_test OR contains(low, 'test') THEN 'test' {cases} ELSE 'other' END"


@query(
    "layer_buckets",
    f"""WITH {FILES_SQL}, f AS (SELECT is_test, lower(replace(replace(replace(path, 'brand1', 'api'), 'brand2', 'services'), 'brand3', 'models')) AS low FROM files)
    SELECT {_layer_sql()} AS layer, count(*) AS n FROM f GROUP BY ALL""",
)
def layer_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files a layer has; three folders are renamed so that all layers occur."""
    path = F.replace(F.replace(F.replace("path", F.lit("brand1"), F.lit("api")), F.lit("brand2"), F.lit("services")), F.lit("brand3"), F.lit("models"))
    return files(spark, sf_dir).groupBy(graph.layer(path, F.col("is_test")).alias("layer")).agg(F.count("*").alias("n"))


@query("grid_layout", f"WITH {FILES_SQL} SELECT file_id, (row_number() OVER (PARTITION BY language ORDER BY is_test, path) - 1)::INTEGER AS slot, ceil(sqrt(count(*) OVER (PARTITION BY language)))::BIGINT AS columns FROM files")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place on a grid for every file of a language, sources before tests."""
    order = ["is_test", "path"]
    rows = ordered.numbered(ordered.blocks(files(spark, sf_dir).select("file_id", "language", *order), ["language"], order), ["language"], order)
    return rows.select("file_id", (F.col("place") - 1).cast("int").alias("slot"), F.ceil(F.sqrt("total")).cast("bigint").alias("columns"))


@query("edge_paths", f"WITH {FILES_SQL}, {EDGES_SQL} SELECT a.path AS src_path, b.path AS dst_path FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst")
def edge_paths(spark: SparkSession, sf_dir: str, to: DataFrame | None = None) -> DataFrame:
    """The paths of edges; with to (path), only edges to those."""
    f = files(spark, sf_dir).select("file_id", "path")
    dst = None if to is None else f.join(to, "path", "left_semi").select(F.col("file_id").alias("dst"))
    return edges(spark, sf_dir, dst).join(f.toDF("src", "src_path"), "src").join(f.toDF("dst", "dst_path"), "dst").select("src_path", "dst_path")


@query(
    "join_inner_left",
    f"WITH {FILES_SQL}, {CHUNKS_SQL}, symbols AS (SELECT DISTINCT label, 'symbol_' || label AS symbol FROM embeddings WHERE label < 6) SELECT chunk_id, path, symbol FROM chunks JOIN files USING (file_id) LEFT JOIN symbols USING (label)",
)
def join_inner_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their file, and their symbol where there is one."""
    symbols = load(spark, sf_dir, "embeddings").where("label < 6").select("label", F.concat(F.lit("symbol_"), "label").alias("symbol")).distinct()
    return chunks(spark, sf_dir).join(files(spark, sf_dir), "file_id").join(symbols, "label", "left").select("chunk_id", "path", "symbol")


@query("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(wanted, "o_orderkey", "left_semi")


@query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(wanted, "o_orderkey", "left_anti")


_SETS = f"WITH {TOUCHED_SQL}, {EDGES_SQL}, left_set AS (SELECT DISTINCT src AS file_id FROM edges), right_set AS (SELECT DISTINCT dst AS file_id FROM edges)"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, sf_dir)
    return e.select(F.col("src").alias("file_id")), e.select(F.col("dst").alias("file_id"))


@query("set_union", f"{_SETS} FROM left_set UNION FROM right_set")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.union(b).distinct()


@query("set_intersect", f"{_SETS} FROM left_set INTERSECT FROM right_set")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query("set_except", f"{_SETS} FROM left_set EXCEPT FROM right_set")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.distinct().join(b, "file_id", "left_anti")


# Imports: each edge of the graph written the way a source file would.
_IMPORTS_SQL = f"""WITH {FILES_SQL}, {EDGES_SQL}, w AS (
  SELECT row_number() OVER (ORDER BY src, dst) AS pos, src, a.path AS src_path, b.path AS dst_path FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst)"""


def _imports(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    p = edge_paths(spark, sf_dir).where(F.col("dst_path").rlike(pattern))
    return p.withColumn("import_id", F.concat_ws(">", "src_path", "dst_path"))


@query(
    "resolve_py",
    f"""{_IMPORTS_SQL}, m AS (SELECT *, (length(src_path) + length(dst_path)) % 5 AS form, regexp_extract(src_path, '^(.*)/[^/]*/[^/]*$', 1) AS top, regexp_extract(src_path, '^(.*)/[^/]*$', 1) AS own,
      regexp_extract(dst_path, '([^/]*)/[^/]*$', 1) AS folder, regexp_extract(dst_path, '([^/]*)$', 1) AS name FROM w WHERE dst_path LIKE '%.py')
    SELECT DISTINCT src_path || '>' || dst_path AS import_id, f.path AS target FROM m JOIN files f ON f.path = CASE form WHEN 1 THEN own || '/' || name WHEN 2 THEN top || '/' || folder || '/' || name ELSE dst_path END""",
)
def resolve_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python imports in five forms: from a.b import c; from . import c; from ..b import c;
    from ...a.b import c; import a.b.c, which a name beside it must not mislead."""
    rows = _imports(spark, sf_dir, r"\.py$").withColumn("form", (F.length("src_path") + F.length("dst_path")) % 5)
    dotted = lambda path: F.regexp_replace(path, "/", ".")
    folder, name = F.regexp_extract("dst_path", r"^(.*)/[^/]*$", 1), F.regexp_extract("dst_path", r"([^/]*)\.py$", 1)
    form = F.col("form")
    module = (
        F.when(form == 1, "")
        .when(form == 2, F.regexp_extract("dst_path", r"([^/]*)/[^/]*$", 1))
        .when(form == 4, dotted(F.regexp_replace("dst_path", r"\.py$", "")))
        .otherwise(dotted(folder))
    )
    level = F.when(form == 4, 0).otherwise(form)
    made = rows.select("import_id", imports.python_candidates(F.col("src_path"), module, F.array(name), level).alias("candidates"))
    return imports.resolve(made, files(spark, sf_dir))


@query(
    "resolve_js",
    f"""{_IMPORTS_SQL}, m AS (SELECT src_path || '>' || dst_path AS import_id, regexp_replace(dst_path, '\\.(js|tsx|ts)$', '') AS stem FROM w WHERE NOT dst_path LIKE '%.py')
    SELECT import_id, coalesce(t.path, x.path, j.path) AS target FROM m LEFT JOIN files t ON t.path = stem || '.ts' LEFT JOIN files x ON x.path = stem || '.tsx' LEFT JOIN files j ON j.path = stem || '.js'""",
)
def resolve_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative script imports without a suffix lead to the first file that exists."""
    rows = _imports(spark, sf_dir, r"\.(ts|tsx|js)$")
    module = F.concat(F.lit("../../"), F.regexp_replace("dst_path", r"\.(ts|tsx|js)$", ""))
    # a suffix like .test is no script suffix, so the module is tried with each suffix
    made = rows.select("import_id", imports.js_candidates(F.col("src_path"), module).alias("candidates"))
    return imports.resolve(made, files(spark, sf_dir))


@query("resolve_imports", f"{_IMPORTS_SQL} SELECT src_path || '>' || dst_path AS import_id, dst_path AS target FROM w")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first existing path of a list with misses before it."""
    rows = _imports(spark, sf_dir, ".")
    made = rows.select("import_id", F.array(F.concat("dst_path", F.lit(".missing")), F.concat(F.lit("./"), "dst_path"), F.col("src_path")).alias("candidates"))
    return imports.resolve(made, files(spark, sf_dir))


@query(
    "build_edges",
    """WITH w AS (SELECT l_orderkey % 40 AS src, l_suppkey % 40 AS dst, CASE WHEN l_linenumber > 5 THEN 'test_import' ELSE 'import' END AS edge_type, l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem)
    SELECT src, dst, edge_type, min(pos) AS pos FROM w WHERE src <> dst GROUP BY ALL""",
)
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge of each pair and type: that of the first import."""
    line = load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("src"),
        (F.col("l_suppkey") % 40).alias("dst"),
        F.when(F.col("l_linenumber") > 5, "test_import").otherwise("import").alias("edge_type"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"),
    )
    return graph.build_edges(line)
