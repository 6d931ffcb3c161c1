"""Nearest chunks of a query vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.functions.vectors import cosine_score


def topk(chunks: DataFrame, query: Column, k: int) -> DataFrame:
    """The k chunks (chunk_id, embedding) nearest to the query, with score and rank order.
    Ties go to the smaller chunk. Spark keeps k rows a task and merges them."""
    return chunks.withColumn("score", cosine_score(F.col("embedding"), query)).orderBy(F.desc("score"), "chunk_id").limit(k)


def best_by_file(hits: DataFrame) -> DataFrame:
    """file_id, score: the best hit of each file."""
    return hits.groupBy("file_id").agg(F.max("score").alias("score"))


def _candidates(chunks: DataFrame, vectors: list, k: int, slice_rows: int = 256) -> DataFrame:
    """_query (position in vectors), chunk_id, embedding: all chunks that may be among the k
    nearest of a query, few more than k a query and task."""
    # the helpers are inner functions, which workers get with the task
    def plain(vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """length, positions, matrix: the vectors of each length whose components are all finite.
        The cosine of any other is 0, as is that of vectors of different lengths."""
        found: dict[int, list[int]] = {}
        whole = vectors.cast(pa.list_(pa.float64()))
        lengths = pc.list_value_length(whole).to_numpy(zero_copy_only=False)
        nulls = np.zeros(len(whole), dtype=bool)
        if whole.flatten().null_count:
            nulls = np.array([v is not None and None in v for v in whole.to_pylist()], dtype=bool)
        good = whole.is_valid().to_numpy(zero_copy_only=False) & ~nulls
        for size in np.unique(lengths[good]):
            at = np.flatnonzero(good & (lengths == size))
            x = whole.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(size))
            finite = np.isfinite(x).all(axis=1)
            found[int(size)] = (at[finite], x[finite])
        return [(size, at, x) for size, (at, x) in found.items()]

    def bounds(chunks: list, asked: list, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of cosine_score for m queries and n chunks, in ten-thousandths.
        They are equal but at the edge of a digit and where squares nearly leave the range of doubles."""
        low, high = np.zeros((m, n)), np.zeros((m, n))
        for size, at, x in chunks:
            for other, by, q in asked:
                if size != other or not len(at) or not len(by):
                    continue
                with np.errstate(all="ignore"):
                    a, c = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :]
                    raw = (q @ x.T) / (np.sqrt(a) * np.sqrt(c))
                # without length both bounds are 0: np.clip keeps NaN
                raw = np.where((a == 0) | (c == 0) | np.isnan(raw), 0.0, raw)
                lo, hi = (np.floor(np.clip(raw + e, 0.0, 1.0) * 1e4 + 0.5) for e in (-1e-9, 1e-9))
                unsure = ((a > 0) & ((a < 1e-200) | (a > 1e200))) | ((c > 0) & ((c < 1e-200) | (c > 1e200)))
                low[np.ix_(by, at)] = np.where(unsure, 0.0, lo)
                high[np.ix_(by, at)] = np.where(unsure, 1e4, hi)
        return low, high

    typed = pa.array([None if v is None else list(v) for v in vectors], type=pa.list_(pa.float64()))
    slices = [(i, typed.slice(i, slice_rows)) for i in range(0, len(typed), slice_rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(i, len(part), plain(part)) for i, part in slices]
        floors = np.full(len(typed), -1.0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            batch = batch.take(pc.sort_indices(batch.column("chunk_id"), null_placement="at_start"))
            met = plain(batch.column("embedding"))
            for i, m, queries in asked:
                low, high = bounds(met, queries, n, m)
                keep = high >= floors[i : i + m, None]
                if n > k:
                    # score, then place in the order of chunk_id, as one whole number
                    place = n - 1 - np.arange(n)
                    kth = np.partition(low * n + place, n - k, axis=1)[:, n - k]
                    keep &= high * n + place >= kth[:, None]
                    floors[i : i + m] = np.maximum(floors[i : i + m], np.floor(kth / n))
                q, at = np.nonzero(keep)
                found = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array((q + i).astype(np.int32)), found.column("chunk_id"), found.column("embedding")], ["_query", "chunk_id", "embedding"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"_query int, chunk_id {kind}, embedding array<double>")


def batch_topk(chunks: DataFrame, queries: DataFrame, k: int, broadcast_rows: int = 2_000) -> DataFrame:
    """The k nearest chunks of each row of a stated query set (query_id, query_vec): every
    chunk meets every query once, and k rows a query and task are left before any shuffle.

    At most broadcast_rows queries are sent to all tasks, which bound all scores by products of
    matrices; what may be among the k nearest is scored exactly. More queries meet the chunks
    block by block, partition against partition.
    """
    few = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec")).limit(broadcast_rows + 1).collect()
    if len(few) <= broadcast_rows:
        named = [(i, *r) for i, r in enumerate(few)]
        kind = queries.schema["query_id"].dataType.simpleString()
        asked = chunks.sparkSession.createDataFrame(named, f"_query int, query_id {kind}, query_vec array<double>")
        met = _candidates(chunks, [r["query_vec"] for r in few], k).join(F.broadcast(asked), "_query")
    else:
        met = chunks.crossJoin(queries)
    pairs = met.select("query_id", "chunk_id", cosine_score(F.col("embedding"), F.col("query_vec")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def cell_centres(chunks: DataFrame, cells: int, sample_rows: int = 20_000, seed: int = 1) -> np.ndarray:
    """The unit centres of an index of `cells` cells: k-means by cosine over a sample of about
    sample_rows chunks, drawn by a hash."""
    n = chunks.count()
    drawn = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_rows / max(1, n)) * (1 << 20))))
    points = drawn.select(F.col("embedding").cast("array<double>").alias("e")).where(F.exists("e", lambda x: x != 0)).select(array_to_vector("e").alias("e"))
    if points.limit(1).count() == 0:
        return np.zeros((0, 0))
    centres = np.array(KMeans(k=max(2, cells), featuresCol="e", distanceMeasure="cosine", seed=seed, maxIter=10).fit(points).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def nearest_cells(centres: np.ndarray, vector: Column, probes: int) -> Column:
    """The numbers of the `probes` cells nearest to a vector."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, centres.shape[1]))
        near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(near.astype(np.int32)))

    return run(vector)


def ann_topk(chunks: DataFrame, queries: DataFrame, k: int, cells: int = 64, probes: int = 16) -> DataFrame:
    """About the k nearest chunks of each query (query_id, query_vec): an inverted file over
    cells. Every chunk is in its nearest cell, a query looks into its `probes` nearest cells,
    and what it meets there is scored exactly. Chunks and queries meet by an equi join on the
    cell, of which a skewed one is split at run time; with probes = cells the result is exact."""
    centres = cell_centres(chunks, cells)
    if len(centres) == 0:
        return batch_topk(chunks, queries, k)
    placed = chunks.select("chunk_id", "embedding", F.element_at(nearest_cells(centres, F.col("embedding"), 1), 1).alias("cell"))
    asked = queries.select("query_id", "query_vec", F.explode(nearest_cells(centres, F.col("query_vec"), probes)).alias("cell"))
    pairs = asked.join(placed, "cell").select("query_id", "chunk_id", cosine_score(F.col("embedding"), F.col("query_vec")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
