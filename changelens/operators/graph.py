"""The file dependency graph: edges (src, dst), where src depends on dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_counts(edges: DataFrame) -> DataFrame:
    """file_id, fan_in, fan_out over all edge rows."""
    ends = edges.select(F.col("dst").alias("file_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        edges.select(F.col("src").alias("file_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return ends.groupBy("file_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def reverse_dependents(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """start (file_id) -> start, file_id, distance: who depends on it within `depth` steps,
    and how near. A file on a cycle reports itself.

    Each step joins a distinct frontier with the edges, so paths never multiply; the depth
    is bounded, so the plan is.
    """
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to")).distinct()
    frontier = start.select(F.col("file_id").alias("start"), F.col("file_id").alias("at")).distinct()
    found = None
    for d in range(1, depth + 1):
        step = frontier.join(back, "at").select("start", F.col("to").alias("at")).distinct()
        level = step.select("start", F.col("at").alias("file_id"), F.lit(d).alias("distance"))
        found = level if found is None else found.unionByName(level)
        frontier = step
    return found.groupBy("start", "file_id").agg(F.min("distance").alias("distance"))


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """start (file_id) -> start, file_id, distance, paths: who depends on it within `depth`
    steps, how near, and by how many shortest paths. A file on a cycle reports itself.

    A level is a sum-product: the counts of the frontier are added up over its edges, and only
    files that no earlier level has reached go on. Counts are decimals, as they multiply.
    """
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to")).distinct()
    frontier = start.select(F.col("file_id").alias("start"), F.col("file_id").alias("at"), F.lit(1).cast("decimal(38,0)").alias("paths")).distinct()
    found = None
    for d in range(1, depth + 1):
        step = frontier.join(back, "at").groupBy("start", "to").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
        level = step.select("start", F.col("to").alias("file_id"), F.lit(d).alias("distance"), "paths")
        if found is not None:
            level = level.join(found.select("start", "file_id"), ["start", "file_id"], "left_anti")
        frontier = level.select("start", F.col("file_id").alias("at"), "paths")
        found = level if found is None else found.unionByName(level)
    return found


def neighbors(edges: DataFrame, center: int) -> DataFrame:
    """The edges that touch a file."""
    return edges.where((F.col("src") == center) | (F.col("dst") == center))


def subgraph(files: DataFrame, edges: DataFrame, max_nodes: int = 500, language: str | None = None, include_tests: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first files by path that the filters leave, and the edges among them."""
    kept = files
    if language:
        kept = kept.where(F.col("language") == language)
    if not include_tests:
        kept = kept.where("NOT is_test")
    nodes = kept.orderBy("path").limit(max_nodes)
    ids = nodes.select("file_id")
    inner = edges.join(ids.withColumnRenamed("file_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("file_id", "dst"), "dst", "left_semi")
    return nodes, inner


def path_tree(files: DataFrame) -> DataFrame:
    """path, name, depth, is_folder of every file and every folder above one."""
    parts = F.split("path", "/")
    prefix = files.select(F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    node = prefix.select(
        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"),
        F.element_at("parts", F.col("depth")).alias("name"),
        "depth",
        (F.col("depth") < F.size("parts")).alias("is_folder"),
    )
    return node.groupBy("path", "name", "depth").agg(F.max("is_folder").alias("is_folder"))


# Path parts of the layers, in order of precedence.
LAYERS = {
    "api": ("/api/", "/endpoints/", "/controllers/", "/views/", "/pages/", "/components/"),
    "service": ("/services/", "/domain/", "/usecases/", "/hooks/", "/store/", "/core/"),
    "data": ("/models/", "/schemas/", "/db/", "/lib/", "/utils/", "/common/"),
}


def layer(path, is_test):
    """The layer of a file: test, api, service, data or other."""
    low = F.lower(path)
    out = F.when(is_test | low.contains("test"), "test")
    for name, marks in LAYERS.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = out.when(hit, name)
    return out.otherwise("other")


def build_edges(resolved: DataFrame) -> DataFrame:
    """resolved (src, dst, edge_type, pos, ...) -> one edge for each src, dst and type: the
    first import's. Imports without a target and self imports go."""
    rest = [c for c in resolved.columns if c not in ("src", "dst", "edge_type")]
    kept = resolved.where("dst IS NOT NULL AND src <> dst")
    first = F.min(F.struct("pos", *[c for c in rest if c != "pos"])).alias("first")
    return kept.groupBy("src", "dst", "edge_type").agg(first).select("src", "dst", "edge_type", *[F.col(f"first.{c}") for c in rest])
