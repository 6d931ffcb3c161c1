"""Which tests to run for a set of sources.

Every signal is an equi join on something derived from the paths (stem, folder, substring of
a stem), so tests and sources never meet in a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import name_of, parent_of, stem_of
from changelens.operators import cochange

ORDER = ("naming", "proximity", "co-change", "import", "semantic")


def _tests(files: DataFrame) -> DataFrame:
    p = F.col("path")
    name = name_of(p)
    named = F.array(
        F.regexp_extract(name, r"^test_(.+)\.py$", 1), F.regexp_extract(name, r"^(.+)_test\.py$", 1), F.regexp_extract(name, r"^(.+)\.(?:test|spec)\.(?:ts|js)$", 1)
    )
    return files.where("is_test").select(
        F.col("file_id").alias("test_id"), p.alias("test_path"), parent_of(p).alias("parent"), stem_of(p).alias("test_stem"),
        F.split(p, "/").alias("parts"), F.filter(F.array_distinct(named), lambda x: x != "").alias("named"),
    )


def _sources(sources: DataFrame) -> DataFrame:
    p = F.col("path")
    return sources.select(F.col("file_id").alias("source_id"), parent_of(p).alias("parent"), stem_of(p).alias("stem"), name_of(parent_of(p)).alias("parent_name"))


def _substrings(stem: Column, lengths: Column) -> Column:
    """The substrings of a stem that have one of the lengths."""
    fit = F.filter(lengths, lambda k: k <= F.length(stem))
    return F.array_distinct(F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), F.length(stem) - k + 1), lambda i: F.substring(stem, i, k)))))


def naming(files: DataFrame, sources: DataFrame) -> DataFrame:
    """test_id, source_id, score: 0.85 for an expected name, 0.65 for a stem within a stem under tests."""
    t, s = _tests(files), _sources(sources).select("source_id", "stem").where("stem <> ''")
    exact = t.select("test_id", F.explode("named").alias("stem")).join(s, "stem").select("test_id", "source_id", F.lit(0.85).alias("score"))
    lengths = s.agg(F.collect_set(F.length("stem")).alias("lengths"))  # one row; a name has 255 at most
    under = t.where(F.array_contains("parts", "tests")).crossJoin(F.broadcast(lengths)).select("test_id", F.explode(_substrings(F.col("test_stem"), F.col("lengths"))).alias("stem"))
    within = under.join(s, "stem").select("test_id", "source_id", F.lit(0.65).alias("score"))
    return exact.union(within).groupBy("test_id", "source_id").agg(F.max("score").alias("score"))


def proximity(files: DataFrame, sources: DataFrame) -> DataFrame:
    """0.55 in the same folder; a test path that holds the source's folder name 0.50 under tests, 0.45 elsewhere."""
    t, s = _tests(files), _sources(sources)
    same = t.select("test_id", "parent").join(s.select("source_id", "parent"), "parent").select("test_id", "source_id", F.lit(0.55).alias("score"))
    part = t.select("test_id", F.array_contains("parts", "tests").alias("under"), F.explode(F.array_distinct("parts")).alias("parent_name"))
    near = part.join(s.where("parent_name <> ''").select("source_id", "parent_name"), "parent_name").select("test_id", "source_id", F.when(F.col("under"), 0.50).otherwise(0.45).alias("score"))
    return same.union(near).groupBy("test_id", "source_id").agg(F.max("score").alias("score"))


def by_cochange(files: DataFrame, sources: DataFrame, touched: DataFrame) -> DataFrame:
    n = cochange.path_counts(touched)
    pairs = cochange.pair_counts(touched, sources).join(files.where("is_test").select(F.col("file_id").alias("b")), "b", "left_semi")
    both = pairs.join(n.select(F.col("file_id").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("file_id").alias("b"), F.col("n").alias("n_b")), "b")
    score = F.least(F.lit(0.75), F.round(F.col("joint") / F.sqrt(F.col("n_a") * F.col("n_b").cast("double")), 6))
    return both.select(F.col("b").alias("test_id"), F.col("a").alias("source_id"), score.alias("score"))


def by_import(files: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    t = files.where("is_test").select(F.col("file_id").alias("src"))
    s = sources.select(F.col("file_id").alias("dst"))
    return edges.join(t, "src", "left_semi").join(s, "dst", "left_semi").select(F.col("src").alias("test_id"), F.col("dst").alias("source_id"), F.lit(0.95).alias("score")).distinct()


def signals(files: DataFrame, sources: DataFrame, edges: DataFrame, touched: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """test_id, source_id (null for semantic hits), score, signal (the place in ORDER)."""
    parts = [(naming(files, sources), 0), (proximity(files, sources), 1)]
    if touched is not None:
        parts.append((by_cochange(files, sources, touched), 2))
    parts.append((by_import(files, sources, edges), 3))
    if semantic is not None:
        hits = semantic.join(files.where("is_test").select("file_id"), "file_id", "left_semi")
        parts.append((hits.select(F.col("file_id").alias("test_id"), F.lit(None).cast("bigint").alias("source_id"), F.least("score", F.lit(0.8)).alias("score")), 4))
    out = None
    for frame, place in parts:
        frame = frame.withColumn("signal", F.lit(place))
        out = frame if out is None else out.unionByName(frame)
    return out.where("score > 0")


def recommend(found: DataFrame, files: DataFrame, top_k: int | None = 10) -> DataFrame:
    """test_id, path, score, reasons (distinct, in order, joined), linked (sorted sources)."""
    names = F.create_map(*[x for i, n in enumerate(ORDER) for x in (F.lit(i), F.lit(n))])
    out = found.groupBy("test_id").agg(
        F.round(F.least(F.lit(1.0), F.max("score")), 4).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set("signal")), lambda i: F.element_at(names, i)), "; ").alias("reasons"),
        F.array_sort(F.collect_set("source_id")).alias("linked"),
    )
    out = out.join(files.select(F.col("file_id").alias("test_id"), "path"), "test_id")
    return out.orderBy(F.desc("score"), "path").limit(top_k) if top_k else out
