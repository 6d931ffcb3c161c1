"""Streams give what the batch operators give over the same events."""

import time

import pytest
from pyspark.sql import functions as F

from changelens.operators import control
from changelens.streaming import progress

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_windows_equal_the_batch(spark, folder):
    got = drain(progress.tumbling(progress.read_events(spark, folder, 1)), "complete", "tumbling")
    batch = spark.read.parquet(folder)
    assert got.agg({"n": "sum"}).first()[0] == batch.count()
    assert drain(progress.sliding(progress.read_events(spark, folder)), "complete", "sliding").agg({"n": "sum"}).first()[0] == 2 * batch.count()


def test_duplicates_go(spark, folder):
    events = progress.read_events(spark, folder)
    got = drain(progress.deduplicated(events.union(progress.read_events(spark, folder))), "append", "dedup")
    assert got.count() == spark.read.parquet(folder).count()


def test_ema_equals_the_fold(spark, folder):
    got = drain(progress.ema(progress.read_events(spark, folder, 100)), "append", "ema_stream")
    last = {}
    for r in sorted(got.collect(), key=lambda r: r["event_id"]):  # ids follow time
        last[r["user_id"]] = r["ema"]
    want = control.ema(spark.read.parquet(folder), "user_id", "ts", "value")
    for r in want.collect():
        assert last[r["user_id"]] == pytest.approx(r["ema"], abs=1e-5)


def test_monotone_never_falls(spark, folder):
    rows = sorted(tuple(r) for r in drain(progress.monotone(progress.read_events(spark, folder, 100)), "append", "monotone").collect())
    for a, b in zip(rows, rows[1:], strict=False):
        assert a[0] != b[0] or a[2] <= b[2]


def test_publish_is_idempotent(spark, folder, tmp_path):
    seen = []
    events = progress.read_events(spark, folder, 1)
    progress.publish(events, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b, i: seen.append(i)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(folder).count() and seen


def test_keys_are_forgotten_after_their_retention(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "view", 90.0), (2, "2024-01-09 00:00:00", 8, "view", 1.0), (3, "2024-01-10 00:00:00", 8, "view", 2.0), (4, "2024-01-10 01:00:00", 7, "view", 5.0)]
    for k, r in enumerate(rows):
        df = spark.createDataFrame([r], "event_id long, ts string, user_id long, event_type string, value double")
        df.selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "'{}' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        time.sleep(1.1)  # files are read in order of their time
    got = {r["event_id"]: r["pct"] for r in drain(progress.monotone(progress.read_events(spark, str(tmp_path / "e"), 1), retention="24 hours"), "append", "forgotten").collect()}
    assert got == {1: 90.0, 2: 1.0, 3: 2.0, 4: 5.0}
    kept = {r["event_id"]: r["pct"] for r in drain(progress.monotone(progress.read_events(spark, str(tmp_path / "e"), 1)), "append", "remembered").collect()}
    assert kept[4] == 90.0


def test_snapshot_then_tail_covers_every_event_once(spark, folder):
    log = spark.read.parquet(folder)
    state, last = progress.snapshot(log.where("event_id <= 400"))
    assert state.count() == log.where("event_id <= 400").select("user_id").distinct().count() and last == 400
    got = drain(progress.tail(progress.read_events(spark, folder, 100), last, terminal="never"), "append", "tailed")
    assert got.count() == log.where("event_id > 400").count() == got.select("event_id").distinct().count()


def progress_events(df):
    k = F.get_json_object("props", "$.k").cast("long")
    return df.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(k % 5 != 0, F.col("value")).alias("pct"), F.when(k % 4 != 0, k).alias("total"), (k - 20).alias("done"), F.when(k % 3 == 0, k).alias("eta"))


def test_merged_state_survives_a_restart(spark, folder, tmp_path):
    whole = progress_events(spark.read.parquet(folder))
    want = sorted(tuple(r) for r in progress.merged_batch(whole).collect())
    by_hand = {}
    for r in sorted(whole.collect(), key=lambda r: r["event_id"]):
        s = by_hand.setdefault(r["user_id"], [0.0, 0, 0, None])
        s[0] = max(s[0], r["pct"] or 0.0)
        s[1] = r["total"] if (r["total"] or 0) > 0 else s[1]
        s[2] = max(s[2], r["done"])
        s[3] = s[3] if r["eta"] is None else r["eta"]
    last = {r["user_id"]: tuple(r)[2:] for r in progress.merged_snapshot(whole).collect()}
    assert last == {k: tuple(v) for k, v in by_hand.items()}
    # The first half as a snapshot; then a stream that stops after one file and starts again.
    half = len(want) // 2
    begin = progress.merged_snapshot(whole.where(F.col("event_id") < half))
    stream = lambda: progress.merged(progress_events(progress.read_events(spark, folder, 1)).where(F.col("event_id") >= half), begin)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    q = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    while not q.recentProgress and q.isActive:
        time.sleep(0.2)
    q.stop()
    q = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    got = sorted(tuple(r) for r in spark.read.schema(progress.MERGED).parquet(out).collect())
    assert got == [r for r in want if r[1] >= half]
