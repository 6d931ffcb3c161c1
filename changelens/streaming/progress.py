"""Progress events as streams: the same logic as the batch operators, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream of events."""
    raw = spark.readStream.schema(EVENTS.replace("timestamp", "timestamp_ntz")).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events by window and kind; what comes later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("amount")).select(F.col("window.start").alias("start"), "event_type", "n", "amount")


def sliding(events: DataFrame, late: str = "1 day", width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _by_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def _kept(state: GroupState, value: float, rows: pd.DataFrame, retention: str) -> None:
    """Remember value until event time has passed the key's last event by `retention`."""
    state.update((value,))
    last = int(rows["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(pd.Timedelta(retention).total_seconds() * 1000))


def monotone(events: DataFrame, late: str = "1 day", retention: str = "90 days") -> DataFrame:
    """user_id, event_id, pct: a percentage that never falls, one number of state per key. A
    key without events for `retention` of event time is forgotten, and starts anew."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _by_order(frames)
        best = state.get[0] if state.exists else float("-inf")
        pct = rows["value"].cummax().clip(lower=best)
        _kept(state, float(pct.iloc[-1]), rows, retention)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "pct": pct})

    watched = events.withWatermark("ts", late).groupBy("user_id")
    return watched.applyInPandasWithState(step, "user_id long, event_id long, pct double", "best double", "append", GroupStateTimeout.EventTimeTimeout)


def ema(events: DataFrame, alpha: float = 0.35, late: str = "1 day", retention: str = "90 days") -> DataFrame:
    """user_id, event_id, ema: the exponential mean of value, seeded with the first. A key
    without events for `retention` of event time is forgotten, and is seeded anew."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _by_order(frames)
        now = state.get[0] if state.exists else None
        out = []
        for v in rows["value"]:
            now = v if now is None else alpha * v + (1 - alpha) * now
            out.append(now)
        _kept(state, float(now), rows, retention)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ema": out})

    watched = events.withWatermark("ts", late).groupBy("user_id")
    return watched.applyInPandasWithState(step, "user_id long, event_id long, ema double", "now double", "append", GroupStateTimeout.EventTimeTimeout)


# Fixed value: how many events of a key the log keeps.
MOST_EVENTS = 1000


def retained(log: DataFrame, now: Column, most: int = MOST_EVENTS, retention: str = "24 hours", terminal: str = "purchase") -> DataFrame:
    """The events that a log keeps: the `most` newest of each key, and nothing of a key whose
    terminal event is older than `retention`."""
    newest = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    ended = F.max(F.when(F.col("event_type") == terminal, F.col("ts"))).over(W.partitionBy("user_id"))
    kept = log.withColumn("_n", F.row_number().over(newest)).withColumn("_ended", ended)
    return kept.where((F.col("_n") <= most) & (F.col("_ended").isNull() | (F.col("_ended") >= now - F.expr(f"INTERVAL {retention}")))).drop("_n", "_ended")


def snapshot(log: DataFrame) -> tuple[DataFrame, int]:
    """The latest event of each key, and the last event id there is: the tail starts behind it."""
    tail = log.agg(F.coalesce(F.max("event_id"), F.lit(-1))).first()[0]
    state = log.where(F.col("event_id") <= tail).groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type", "value"), "event_id").alias("e"))
    return state.select("user_id", "e.*"), tail


def tail(events: DataFrame, after: int, terminal: str = "purchase", late: str = "1 day", retention: str = "90 days") -> DataFrame:
    """The events behind a snapshot, per key up to its first terminal event."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _by_order(frames)
        ended = state.exists and state.get[0] > 0
        stop = (rows["event_type"] == terminal).to_numpy()
        kept = rows.iloc[:0] if ended else rows.iloc[: int(stop.argmax()) + 1] if stop.any() else rows
        _kept(state, float(ended or stop.any()), rows, retention)
        yield pd.DataFrame({"user_id": key[0], "event_id": kept["event_id"], "event_type": kept["event_type"], "value": kept["value"]})

    behind = events.where(F.col("event_id") > after).withWatermark("ts", late).groupBy("user_id")
    return behind.applyInPandasWithState(step, "user_id long, event_id long, event_type string, value double", "ended double", "append", GroupStateTimeout.EventTimeTimeout)


# What a subscriber sees of a generation, and how an event changes it.
MERGED = "user_id long, event_id long, pct double, total long, done long, eta long"


def merged_batch(log: DataFrame) -> DataFrame:
    """The state after each event of log (user_id, event_id, pct, total, done, eta): percent and
    work done never fall, a total above 0 replaces the one before, and the last known time left
    stays."""
    so_far = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    return log.select(
        "user_id",
        "event_id",
        F.coalesce(F.max("pct").over(so_far), F.lit(0.0)).alias("pct"),
        F.coalesce(F.last(above("total"), ignorenulls=True).over(so_far), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.max(above("done")).over(so_far), F.lit(0)).cast("long").alias("done"),
        F.last("eta", ignorenulls=True).over(so_far).cast("long").alias("eta"),
    )


def merged_snapshot(log: DataFrame) -> DataFrame:
    """The state after the last event of each generation, by one aggregation."""
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    newest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("event_id")))
    return log.groupBy("user_id").agg(
        F.max("event_id").alias("event_id"),
        F.coalesce(F.max("pct"), F.lit(0.0)).alias("pct"),
        F.coalesce(newest(above("total")), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.max(above("done")), F.lit(0)).cast("long").alias("done"),
        newest(F.col("eta")).cast("long").alias("eta"),
    )


def merged(log: DataFrame, snapshot: DataFrame | None = None, late: str = "1 day", retention: str = "90 days") -> DataFrame:
    """The state after each event of a stream of log rows with ts (see merged_batch), begun from
    the snapshot of each generation, which is joined to its events: it counts where the stream
    has no state of its own yet. A generation without events for `retention` of event time is
    forgotten."""
    names = ["pct", "total", "done", "eta"]
    begin = (snapshot or merged_snapshot(log.sparkSession.createDataFrame([], MERGED))).select("user_id", *[F.col(n).alias(f"_{n}") for n in names])
    rows = log.withWatermark("ts", late).join(begin, "user_id", "left")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values("event_id", kind="stable")
        known = lambda v, other: other if pd.isna(v) else v
        if state.exists:
            pct, total, done, eta = state.get
        else:
            first = rows.iloc[0]
            pct, total, done = known(first["_pct"], 0.0), known(first["_total"], 0), known(first["_done"], 0)
            eta = known(first["_eta"], None)
        seen = []
        for event, p, t, d, e in zip(*(rows[c] for c in ("event_id", *names)), strict=True):
            pct = max(pct, known(p, pct))
            total = t if not pd.isna(t) and t > 0 else total
            done = max(done, known(d, done))
            eta = known(e, eta)
            seen.append((key[0], event, pct, total, done, eta))
        state.update((float(pct), int(total), int(done), None if eta is None else int(eta)))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(pd.Timedelta(retention).total_seconds() * 1000))
        frame = pd.DataFrame(seen, columns=["user_id", "event_id", *names])
        yield frame.astype({"event_id": "int64", "pct": "float64", "total": "int64", "done": "int64", "eta": "Int64"})

    return rows.groupBy("user_id").applyInPandasWithState(step, MERGED, "pct double, total long, done long, eta long", "append", GroupStateTimeout.EventTimeTimeout)


def publish(df: DataFrame, folder: str, checkpoint: str, fan_out=None):
    """Write each micro-batch to a folder, and hand it to `fan_out(batch, id)` as well."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")  # a batch that is run again replaces itself
        if fan_out is not None:
            fan_out(batch, batch_id)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
