"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space that separates words: 0x20 and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies under spark.checkpoint.dir as the session names it. Where that is unset, a folder
    of the warehouse serves in local mode, as in tests; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_changelens"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that every
    executor sees, so a lost executor costs no recomputation. What is not released goes when
    the application ends: a result that is not computed yet may still read it.

    large_rows: rows are packed numbers of some megabytes. They are not compressed and are read
    by plain reads, as codecs and vectored reads keep buffers of their size outside of the heap."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**{"compression": "none"} if large_rows else {}).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    reading = {"parquet.hadoop.vectored.io.enabled": "false"} if large_rows else {}
    stored = spark.read.options(**reading).schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(df: DataFrame) -> None:
    """Delete the files of a materialized DataFrame that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows go to Python in what is computed within the block, where rows
    hold long texts. The session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hand_back() -> None:
    """Give freed memory back to the system. Python workers are used again by later tasks,
    and would keep what the largest batch so far has needed. Functions of earlier tasks refer to
    themselves, so that they, and the models they hold, go only with a collection."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


# --- words and their 64-bit hashes, a whole batch of texts at a time ---------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_CHUNK = 1 << 22


def word_hashes(data: bytes) -> np.ndarray:
    """The 64-bit hash of each word of an UTF-8 text, A-Z lower-cased, in order.

    A word's hash is a polynomial over its bytes (taken from one running sum over the text,
    so no word is ever built as a Python object), finalised together with its length.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if raw.size == 0:
        return np.zeros(0, dtype=np.uint64)
    if raw.size > _CHUNK:  # cut at white space: the running arrays stay small
        parts, at = [], 0
        while raw.size - at > _CHUNK:
            gap = np.flatnonzero(_SPACE[raw[at + 1 : at + _CHUNK]])
            if gap.size:
                end = at + 1 + int(gap[-1])
            else:
                rest = np.flatnonzero(_SPACE[raw[at + 1 :]])
                if rest.size == 0:
                    break
                end = at + 1 + int(rest[0])
            parts.append(_hash_words(raw[at:end]))
            at = end
        return np.concatenate([*parts, _hash_words(raw[at:])])
    return _hash_words(raw)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if starts.size == 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        inverse = pow(_BASE, -1, 1 << 64)
        sums = np.zeros(raw.size + 1, dtype=np.uint64)
        terms = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers(raw.size, _BASE)
        np.cumsum(terms, out=sums[1:])
        words = (sums[ends] - sums[starts]) * _powers(raw.size, inverse)[starts]
        return mix64(words ^ ((ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order, repeats included. A text of fewer words (but
    one at least) is a single run."""
    if words.size == 0:
        return words
    n = min(n, words.size)
    with np.errstate(over="ignore"):
        out = np.full(words.size - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + words[i : words.size - n + 1 + i])
        return out


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data), n))


_EDGES_A_TASK = 100_000  # 16 bytes each


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph as (node, component): component is the smallest
    node that can be reached. Nodes without an edge do not appear.

    Alternating large-star and small-star steps: each is a grouped minimum (combined on the
    map side, so a hub is no hot spot) and a join. Every round is written to the shared
    folder, and only a count and two sums reach the driver. Tasks are as many as the edges
    need: rounds are many, and a small graph would spend them on empty partitions.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sums = (F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")))
    before = tuple(e.agg(*sums).first())
    tasks = max(8, -(-before[0] // _EDGES_A_TASK))
    write = lambda df: materialize(df.coalesce(tasks))  # noqa: E731  coalesce never adds partitions
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is tied to the smallest of its neighbourhood.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node's smaller neighbours are tied to the smallest of them.
        least = write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = write(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        for old in (e, low, large, least):
            release(old)
        e = after
        now = tuple(e.agg(*sums).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())
