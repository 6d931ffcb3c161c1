"""A training corpus from raw documents: five stages, each written and read again.

Language identification drops documents that belong to no known language, the quality
classifier drops documents it scores low, near-dedup keeps one document of each group,
decontamination drops documents that contain a benchmark item, and packing cuts what is left
into windows of token ids.

Every stage decides row by row: a null or repeated doc_id is treated like any other, and rows
that repeat are rows of their own. Columns beyond those of `documents` are ignored. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import decontaminate, language_id, minhash_dedup, packing, quality
from changelens.llm.common import materialize, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the languages of docs; texts without a letter or far from every centroid go,
    so null and empty texts do. Rows of a null language are judged, not learned from; without
    any language nothing is known, and all rows go. Equal texts are judged alike."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs.select(*COLUMNS), model).where("NOT rejected").select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from `labels`; documents that score below the limit go. Null and empty texts are
    scored as texts without words, labels of a null or absent doc_id are not learned from, and
    without labels every row has the same score. Equal texts are judged alike."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it stays the row's; a doc_id can be
    null or repeat."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))


def _reading(out: DataFrame, *stored: DataFrame) -> DataFrame:
    """out, which reads these stored frames: once it is written itself, they can go."""
    out.reads = stored
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group, on five-word shingles: that of the smallest doc_id, where
    a null comes last, then the first. Rows of equal texts are a group; texts that are null or
    have no words are in none, and stay."""
    rows = _numbered(docs)
    found = minhash_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    groups = found.where("NOT kept").select("component_id").distinct()
    members = materialize(found.select(F.col("doc_id").alias("row"), "component_id").join(groups, "component_id").join(rows.select("row", "doc_id"), "row"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = materialize(members.select("row").join(first.select("first.row"), "row", "left_anti"))
    release(members)
    return _reading(rows.join(gone, "row", "left_anti").select(*COLUMNS), rows, gone)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of `benchmark` go. Null and empty texts contain none, null
    and empty items are contained in none."""
    rows = _numbered(docs)
    leaks = materialize(decontaminate.contaminated(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct())
    return _reading(rows.join(leaks, "row", "left_anti").select(*COLUMNS), rows, leaks)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into windows of 4096 token ids; a null or empty text is one
    id, the end. A null doc_id stays null. The tokenizer's caches are smaller than they would be
    alone, as the workers hold what earlier stages left."""
    return packing.pack(docs.select("doc_id", "text"), cache_chunks=150_000, slice_mb=1).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack_windows),
]

# Centroids, boosted tables and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Once a stage's output is written, its input and what the
    stage has stored are deleted, so two copies of the corpus lie there at most."""
    docs = table(spark, sf_dir, "documents")
    given = True
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        written = materialize(out)
        for old in (*getattr(out, "reads", ()), *(() if given else (docs,))):
            release(old)
        docs, given = written, False
    return STAGES[-1][1](spark, docs, sf_dir)
