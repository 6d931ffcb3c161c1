"""Progress, leases, outbox and generation lifecycle as predicates over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.operators import intervals, ordered

# The states, which may follow which, and limits in seconds.
TERMINAL = ("completed", "failed", "cancelled", "superseded")
NEXT_STATES = {
    "queued": ("preparing",), "preparing": ("parsing",), "parsing": ("embedding", "finalizing"),
    "embedding": ("finalizing",), "finalizing": ("completed",),
}
LEASE_SECONDS = {"parser": 125 * 60, "local": 27 * 60, "remote": 8 * 60}
OUTBOX_LEASE_SECONDS, FINALIZING_SECONDS, BACKOFF_CAP, GC_HOURS = 300, 120, 600, 24


def status_map(status: Column) -> Column:
    return F.when(status == "completed", "indexed").when(status.isin("failed", "cancelled", "superseded"), "index_failed").otherwise("indexing")


def progress_pct(phase: Column, done: Column, total: Column) -> Column:
    """Percent by phase: parsing to 25, saving 30, embeddings 30 to 85, the graph 95; 99 at most."""
    ratio = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    raw = F.when(phase == "parsing", ratio * 25.0).when(phase == "saving", 30.0).when(phase == "embeddings", 30.0 + ratio * 55.0).when(phase == "graph_and_commits", 95.0).otherwise(0.0)
    return F.round(F.least(raw, F.lit(99.0)).cast("decimal(12,6)"), 1).cast("double")  # in decimals, so ties round up


def eta_linear(elapsed: Column, pct: Column) -> Column:
    """Seconds left at the rate so far; null within 2 s or up to 1 %."""
    left = F.greatest((elapsed / pct * 100.0 - elapsed).cast("bigint"), F.lit(1))
    return F.when((elapsed >= 2.0) & (pct > 1.0), left)


def eta_rate(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left from files a second."""
    return ((total - done) / (done / F.greatest(F.lit(0.1), elapsed))).cast("bigint")


def monotone(log: DataFrame, key: str, order: str, pct: str) -> DataFrame:
    """log with pct that never falls within a key."""
    rows = ordered.blocks(log, [key], [order])
    return ordered.running(rows, [key], [order], pct, "max", "_most").withColumn(pct, F.col("_most")).drop("_most", "_block")


def ema(log: DataFrame, key: str, order: str, value: str, alpha: float = 0.35) -> DataFrame:
    """key, ema: the exponential mean of value in order, seeded with the first.

    With n values the i-th weighs alpha (1 - alpha)^(n - i), the first (1 - alpha)^(n - 1); so
    the mean is a sum over numbered rows, and no key's history is held in one place.
    """
    rows = ordered.blocks(log.select(key, F.col(order).alias("_order"), F.col(value).alias("v")), [key], ["_order"])
    numbered = ordered.numbered(rows, [key], ["_order"]).select(key, "v", (F.col("total") - F.col("place")).alias("back"))
    summed = numbered.groupBy(key).agg(F.sum(F.col("v") * F.pow(F.lit(1 - alpha), "back")).alias("s"), F.max(F.struct("back", "v")).alias("first"))
    seed = (1 - alpha) * F.col("first.v") * F.pow(F.lit(1 - alpha), "first.back")
    return summed.select(key, F.round(alpha * F.col("s") + seed, 6).alias("ema"))


def backoff(attempt: Column) -> Column:
    return F.least(F.lit(BACKOFF_CAP), F.pow(F.lit(2.0), attempt - 1)).cast("bigint")


def route(kind: Column, batch: Column, backend: Column) -> Column:
    """The queue of an event, or why it has none."""
    embed = F.when(batch.isNull(), "error: no batch_index").when(backend == "nim", "embeddings_nim_io").otherwise("embeddings_gpu")
    return F.when(kind == "prepare_requested", "indexing_cpu").when(kind == "embedding_batch_requested", embed).when(kind == "activation_requested", "workflow_control").otherwise("error: unroutable")


def activation_decision(status: Column, generation: Column, active: Column, desired: Column) -> Column:
    return (
        F.when((status == "completed") & active.eqNullSafe(generation), "already_active")
        .when(status.isin("failed", "cancelled", "superseded"), F.concat(F.lit("skipped: generation_is_"), status))
        .when(status != "finalizing", F.concat(F.lit("skipped: generation_status_"), status, F.lit("_not_finalizing")))
        .when(~desired.eqNullSafe(generation), "superseded")
        .otherwise("activated")
    )


def failure_status(generation: Column, desired: Column) -> Column:
    return F.when(desired.eqNullSafe(generation), "failed").otherwise("superseded")


def lease_claimable(status: Column, owner: Column, expires: Column, now: Column) -> Column:
    return status.isin("queued", "preparing", "parsing") & (owner.isNull() | (expires < now))


def transitions(log: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """log with the state before and whether the step from it is allowed."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(order))
    allowed = F.lit(False)
    for state, followers in NEXT_STATES.items():
        allowed = allowed | ((before == state) & F.col(status).isin(*followers, "failed", "cancelled", "superseded"))
    return log.withColumn("before", before).withColumn("allowed", before.isNull() | (before == F.col(status)) | allowed)


def batch_ranges(chunks: DataFrame, key: str, chunk: str, size: int = 16) -> DataFrame:
    """key, batch_index, first and last chunk of every run of `size` chunks of a key."""
    rows = ordered.numbered(ordered.blocks(chunks.select(key, chunk), [key], [chunk]), [key], [chunk])
    place = F.floor((F.col("place") - 1) / size).cast("bigint")
    return rows.select(key, chunk, place.alias("batch_index")).groupBy(key, "batch_index").agg(F.min(chunk).alias("first_chunk"), F.max(chunk).alias("last_chunk"), F.count("*").alias("n"))


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """ranges (key, start, end) with those that overlap or touch joined. Null ends come last, and
    of equal ranges the one that opens an island comes first."""
    order = [F.asc_nulls_last("start"), F.asc_nulls_last("end")]
    rows = ordered.blocks(ranges.select(key, "start", "end"), [key], order)
    opened = ordered.running(rows, [key], order, "end", "max", "most", own=False)
    opened = opened.withColumn("fresh", F.when(F.col("most").isNull() | (F.col("start") > F.col("most") + 1), 1).otherwise(0))
    before = ordered.running(opened, [key], [*order, F.desc("fresh")], "fresh", "sum", "before", own=False)
    island = before.withColumn("island", F.col("before") + F.col("fresh"))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(key, "start", "end")


def changed_symbols(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """symbols (path, symbol, start_line, end_line) that overlap a changed range of their
    file. changed (path, seq, ranges): a file without ranges changes all its symbols, and of
    a path that is given twice the last row counts."""
    last = changed.groupBy("path").agg(F.max_by("ranges", "seq").alias("ranges"))
    whole = symbols.join(last.where("coalesce(size(ranges), 0) <= 0").select("path"), "path", "left_semi").select("path", "symbol")
    parts = last.select("path", F.explode("ranges").alias("r")).select("path", F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"))
    marked = symbols.withColumnsRenamed({"start_line": "l_start", "end_line": "l_end"})
    return whole.union(intervals.overlaps(marked, parts, "path").select("path", "symbol")).distinct()
