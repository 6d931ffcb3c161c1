"""Progress, outbox, lifecycle, ranges and event-time windows over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.operators import control as C
from changelens.plans.registry import query
from changelens.sources.tables_sink import shared_folder, stored
from changelens.streaming import progress
from changelens.sources.tables import LOG_SQL, load, progress_log

_L = f"WITH {LOG_SQL}"
# The log's kinds stand for phases, statuses and event types.
_STATES = {"signup": "queued", "view": "parsing", "click": "embedding", "purchase": "finalizing", "error": "failed"}
_STATE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " END"
_PHASES = {"signup": "parsing", "view": "saving", "click": "embeddings", "purchase": "graph_and_commits", "error": "other"}
_PHASE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PHASES.items()) + " END"
_ROUTES = {"signup": "prepare_requested", "view": "embedding_batch_requested", "click": "embedding_batch_requested", "purchase": "activation_requested", "error": "unknown"}
_ROUTE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROUTES.items()) + " END"


def _mapped(names: dict[str, str]):
    out = None
    for k, v in names.items():
        out = F.when(F.col("kind") == k, v) if out is None else out.when(F.col("kind") == k, v)
    return out


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_log(spark, sf_dir)


@query("status_map", f"{_L} SELECT seq, CASE WHEN s = 'completed' THEN 'indexed' WHEN s IN ('failed', 'cancelled', 'superseded') THEN 'index_failed' ELSE 'indexing' END AS status FROM (SELECT seq, CASE WHEN kind = 'purchase' THEN 'completed' ELSE {_STATE_SQL} END AS s FROM log)")
def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("kind") == "purchase", "completed").otherwise(_mapped(_STATES))
    return _log(spark, sf_dir).select("seq", C.status_map(state).alias("status"))


_PCT_SQL = f"""round(least(99e0, CASE {_PHASE_SQL} WHEN 'parsing' THEN batch / 100e0 * 25 WHEN 'saving' THEN 30e0 WHEN 'embeddings' THEN 30 + batch / 100e0 * 55 WHEN 'graph_and_commits' THEN 95e0 ELSE 0e0 END)::DECIMAL(12,6), 1)::DOUBLE"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("pct", C.progress_pct(_mapped(_PHASES), F.col("batch"), F.lit(100)))


@query("progress_pct", f"{_L} SELECT seq, {_PCT_SQL} AS pct FROM log")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).select("seq", "pct")


@query("eta_linear", f"{_L}, p AS (SELECT seq, amount, {_PCT_SQL} AS pct FROM log) SELECT seq, CASE WHEN amount >= 2 AND pct > 1 THEN greatest(trunc(amount / pct * 100 - amount)::BIGINT, 1) ELSE -1 END AS eta FROM p")
def eta_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-1 where there is no estimate yet."""
    return _progress(spark, sf_dir).select("seq", F.coalesce(C.eta_linear(F.col("amount"), F.col("pct")), F.lit(-1)).alias("eta"))


@query("eta_rate", f"{_L} SELECT seq, trunc((100 - b) / (b / greatest(0.1e0, amount)))::BIGINT AS eta FROM (SELECT seq, amount, batch + 1 AS b FROM log)")
def eta_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", C.eta_rate(F.col("batch") + 1, F.lit(100), F.col("amount")).alias("eta"))


@query("monotone_progress", f"{_L}, p AS (SELECT generation, seq, {_PCT_SQL} AS pct FROM log) SELECT generation, seq, max(pct) OVER (PARTITION BY generation ORDER BY seq) AS pct FROM p")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.monotone(_progress(spark, sf_dir), "generation", "seq", "pct").select("generation", "seq", "pct")


@query("ema", f"WITH RECURSIVE {LOG_SQL}, n AS (SELECT generation, amount, row_number() OVER (PARTITION BY generation ORDER BY seq) AS i FROM log), r AS (SELECT generation, i, amount AS e FROM n WHERE i = 1 UNION ALL SELECT n.generation, n.i, 0.35e0 * amount + 0.65e0 * e FROM r JOIN n ON n.generation = r.generation AND n.i = r.i + 1) SELECT generation, round(arg_max(e, i), 6) AS ema FROM r GROUP BY generation")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ema(_log(spark, sf_dir), "generation", "seq", "amount")


@query("latest_state", f"{_L} SELECT generation, max(seq) AS seq, arg_max(kind, seq) AS kind, max(batch) AS batch FROM log GROUP BY generation")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that a subscriber gets before the stream."""
    return _log(spark, sf_dir).groupBy("generation").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"), F.max("batch").alias("batch"))


@query(
    "progress_tail",
    """WITH t AS (SELECT max(event_id) // 2 AS tail FROM events), b AS (SELECT user_id, event_id, event_type, value, ts FROM events, t WHERE event_id > tail),
    o AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM b)
    SELECT user_id, event_id, event_type, value FROM o WHERE coalesce(ended, 0) = 0""",
)
def progress_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber gets behind its snapshot (here of the first half of the events): a
    stream per generation, up to its terminal event."""
    log = load(spark, sf_dir, "events")
    half = log.agg(F.expr("max(event_id) div 2")).first()[0]
    _, last = progress.snapshot(log.where(F.col("event_id") <= half))
    folder = shared_folder(spark)
    progress.publish(progress.tail(progress.read_events(spark, f"{sf_dir}/events.parque[t]"), last), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_id", "event_type", "value")


_MERGED = """t AS (SELECT max(event_id) // 2 AS tail FROM events), m AS (SELECT user_id, event_id, value AS pct, k * 10 AS total, event_id % 97 AS done, CASE WHEN k % 3 <> 0 THEN k END AS eta FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _progress_events(events: DataFrame) -> DataFrame:
    """Events with what they say of progress: pct, total, done and eta, which some don't know."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select("user_id", "event_id", "ts", F.col("value").alias("pct"), (k * 10).alias("total"), (F.col("event_id") % 97).alias("done"), F.when(k % 3 != 0, k).alias("eta"))


@query(
    "progress_merged",
    f"""WITH {_MERGED} SELECT user_id, event_id, pct, total, done, eta FROM (SELECT user_id, event_id, max(pct) OVER w AS pct, coalesce(last_value(CASE WHEN total > 0 THEN total END IGNORE NULLS) OVER w, 0) AS total,
    coalesce(max(done) OVER w, 0) AS done, last_value(eta IGNORE NULLS) OVER w AS eta FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), t WHERE event_id > tail""",
)
def progress_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged state after each event of the second half, as a stream that begins from the
    snapshot of the first."""
    log = load(spark, sf_dir, "events")
    half = log.agg(F.expr("max(event_id) div 2")).first()[0]
    if half is None:
        return progress.merged_batch(_progress_events(log))
    begin = progress.merged_snapshot(_progress_events(log.where(F.col("event_id") <= half)))
    events = _progress_events(progress.read_events(spark, f"{sf_dir}/events.parque[t]").where(F.col("event_id") > half))
    folder = shared_folder(spark)
    progress.publish(progress.merged(events, stored(begin)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(progress.MERGED).parquet(f"{folder}/out").select("user_id", "event_id", "pct", "total", "done", "eta")


@query("log_retention", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, max(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS ended, max(ts) OVER () AS newest FROM events)
  SELECT user_id, event_id FROM o WHERE n <= 1000 AND (ended IS NULL OR ended >= newest - INTERVAL 24 HOUR)""")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that the log keeps, as of the newest event."""
    log = load(spark, sf_dir, "events")
    newest = log.agg(F.max("ts")).first()[0]
    return progress.retained(log, F.to_timestamp_ntz(F.lit(str(newest)))).select("user_id", "event_id")


@query("batch_progress", f"{_L} SELECT generation, count(*) AS total, count(*) FILTER (WHERE kind = 'purchase') AS completed, count(*) FILTER (WHERE kind = 'error') AS failed FROM log GROUP BY generation")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "purchase").alias("completed"), F.count_if(F.col("kind") == "error").alias("failed"))


@query(
    "state_transitions",
    f"""{_L}, s AS (SELECT generation, seq, {_STATE_SQL} AS status FROM log), b AS (SELECT *, lag(status) OVER (PARTITION BY generation ORDER BY seq) AS before FROM s)
    SELECT generation, seq, before, status, before IS NULL OR before = status OR (before = 'queued' AND status IN ('preparing', 'failed', 'cancelled', 'superseded')) OR (before = 'preparing' AND status IN ('parsing', 'failed', 'cancelled', 'superseded'))
      OR (before = 'parsing' AND status IN ('embedding', 'finalizing', 'failed', 'cancelled', 'superseded')) OR (before = 'embedding' AND status IN ('finalizing', 'failed', 'cancelled', 'superseded')) OR (before = 'finalizing' AND status IN ('completed', 'failed', 'cancelled', 'superseded')) AS allowed FROM b""",
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).select("generation", "seq", _mapped(_STATES).alias("status"))
    return C.transitions(rows, "generation", "seq", "status").select("generation", "seq", "before", "status", "allowed")


_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


@query(
    "lease_claimable",
    f"{_L} SELECT seq, s IN ('queued', 'preparing', 'parsing') AND (batch % 2 = 0 OR at_time + INTERVAL 125 MINUTE < {_NOW}) AS claimable FROM (SELECT *, {_STATE_SQL} AS s FROM log)",
)
def lease_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lease is free if it has no owner (even batches) or has run out."""
    owner = F.when(F.col("batch") % 2 == 1, "worker")
    return _log(spark, sf_dir).select("seq", C.lease_claimable(_mapped(_STATES), owner, F.col("at") + F.expr("INTERVAL 125 MINUTES"), _now()).alias("claimable"))


@query("batch_ranges", "SELECT label AS generation, batch_index::BIGINT AS batch_index, min(vec_id) AS first_chunk, max(vec_id) AS last_chunk, count(*) AS n FROM (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS batch_index FROM embeddings) GROUP BY ALL")
def batch_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batch_ranges(load(spark, sf_dir, "embeddings").withColumnRenamed("label", "generation"), "generation", "vec_id")


@query("generations_complete", f"{_L} SELECT generation, bool_and(kind <> 'error') AS complete FROM log GROUP BY generation")
def generations_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("generation").agg(F.bool_and(F.col("kind") != "error").alias("complete"))


_GEN_SQL = f"{_L}, g AS (SELECT generation, CASE WHEN max(batch) = 99 THEN 'completed' ELSE arg_max({_STATE_SQL}, seq) END AS status, generation // 2 AS repo, max(at_time) AS terminal_at FROM log GROUP BY generation), r AS (SELECT repo, max(generation) AS desired, min(generation) FILTER (WHERE status = 'completed') AS active FROM g GROUP BY repo)"


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = (
        _log(spark, sf_dir)
        .withColumn("status", _mapped(_STATES))
        .groupBy("generation")
        .agg(F.max("batch").alias("b"), F.max_by("status", "seq").alias("s"), F.max("at").alias("terminal_at"))
        .select("generation", F.when(F.col("b") == 99, "completed").otherwise(F.col("s")).alias("status"), F.floor(F.col("generation") / 2).alias("repo"), "terminal_at")
    )
    r = g.groupBy("repo").agg(F.max("generation").alias("desired"), F.min(F.when(F.col("status") == "completed", F.col("generation"))).alias("active"))
    return g.join(r, "repo")


@query(
    "activation_decision",
    f"""{_GEN_SQL} SELECT generation, CASE WHEN status = 'completed' AND active = generation THEN 'already_active' WHEN status IN ('failed', 'cancelled', 'superseded') THEN 'skipped: generation_is_' || status
      WHEN status <> 'finalizing' THEN 'skipped: generation_status_' || status || '_not_finalizing' WHEN desired <> generation THEN 'superseded' ELSE 'activated' END AS decision FROM g JOIN r USING (repo)""",
)
def activation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generations(spark, sf_dir)
    return g.select("generation", C.activation_decision(g.status, g.generation, g.active, g.desired).alias("decision"))


@query("failure_status", f"{_GEN_SQL} SELECT generation, CASE WHEN desired = generation THEN 'failed' ELSE 'superseded' END AS outcome FROM g JOIN r USING (repo) WHERE status = 'failed'")
def failure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generations(spark, sf_dir).where("status = 'failed'")
    return g.select("generation", C.failure_status(g.generation, g.desired).alias("outcome"))


@query("gc_eligible", f"{_GEN_SQL} SELECT generation FROM g JOIN r USING (repo) WHERE status IN ('superseded', 'failed', 'cancelled') AND terminal_at < {_NOW} - INTERVAL 24 HOUR AND generation NOT IN (SELECT desired FROM r) AND generation NOT IN (SELECT active FROM r WHERE active IS NOT NULL)")
def gc_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended generations, a day old, that no repository points at."""
    g = _generations(spark, sf_dir)
    protected = g.select(F.explode(F.array("desired", "active")).alias("generation")).where("generation IS NOT NULL").distinct()
    old = g.where(F.col("status").isin("superseded", "failed", "cancelled") & (F.col("terminal_at") < _now() - F.expr("INTERVAL 24 HOURS")))
    return old.select("generation").join(protected, "generation", "left_anti")


@query("outbox_claim", f"{_L} SELECT seq, kind FROM log WHERE kind = 'signup' AND at_time <= {_NOW} ORDER BY at_time, seq LIMIT 100")
def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest events that are due."""
    return _log(spark, sf_dir).where((F.col("kind") == "signup") & (F.col("at") <= _now())).orderBy("at", "seq").limit(100).select("seq", "kind")


@query("outbox_backoff", f"{_L} SELECT seq, least(600, pow(2, batch % 20))::BIGINT AS seconds FROM log")
def outbox_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", C.backoff(F.col("batch") % 20 + 1).alias("seconds"))


@query(
    "outbox_route",
    f"""{_L} SELECT seq, CASE {_ROUTE_SQL} WHEN 'prepare_requested' THEN 'indexing_cpu' WHEN 'embedding_batch_requested' THEN CASE WHEN batch % 10 = 0 THEN 'error: no batch_index' WHEN batch % 3 = 0 THEN 'embeddings_nim_io' ELSE 'embeddings_gpu' END
      WHEN 'activation_requested' THEN 'workflow_control' ELSE 'error: unroutable' END AS queue FROM log""",
)
def outbox_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.when(F.col("batch") % 10 != 0, F.col("batch"))
    backend = F.when(F.col("batch") % 3 == 0, "nim")
    return _log(spark, sf_dir).select("seq", C.route(_mapped(_ROUTES), batch, backend).alias("queue"))


@query("reconcile_outbox", f"{_L} SELECT seq FROM log WHERE kind = 'view' AND at_time + INTERVAL 300 SECOND < {_NOW}")
def reconcile_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events claimed longer ago than their lease."""
    return _log(spark, sf_dir).where((F.col("kind") == "view") & (F.col("at") + F.expr("INTERVAL 300 SECONDS") < _now())).select("seq")


@query("reconcile_parser", f"{_L} SELECT DISTINCT generation FROM log WHERE {_STATE_SQL} = 'parsing' AND at_time + INTERVAL 125 MINUTE < {_NOW}")
def reconcile_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).withColumn("status", _mapped(_STATES))
    return rows.where((F.col("status") == "parsing") & (F.col("at") + F.expr("INTERVAL 125 MINUTES") < _now())).select("generation").distinct()


@query("reconcile_batches", f"{_L} SELECT seq FROM log WHERE kind = 'click' AND at_time + (CASE WHEN batch % 2 = 0 THEN INTERVAL 27 MINUTE ELSE INTERVAL 8 MINUTE END) < TIMESTAMP '2024-01-15 00:00:00'")
def reconcile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("at") + F.when(F.col("batch") % 2 == 0, F.expr("INTERVAL 27 MINUTES")).otherwise(F.expr("INTERVAL 8 MINUTES"))
    return _log(spark, sf_dir).where((F.col("kind") == "click") & (end < F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))).select("seq")


@query("reconcile_finalizing", f"{_GEN_SQL} SELECT generation FROM g WHERE status = 'finalizing' AND terminal_at + INTERVAL 120 SECOND < {_NOW} AND NOT EXISTS (SELECT 1 FROM log WHERE log.generation = g.generation AND kind = 'error' AND batch > 95)")
def reconcile_finalizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations that finalise for too long without an event on its way."""
    g = _generations(spark, sf_dir).where((F.col("status") == "finalizing") & (F.col("terminal_at") + F.expr("INTERVAL 120 SECONDS") < _now()))
    active = _log(spark, sf_dir).where("kind = 'error' AND batch > 95").select("generation")
    return g.select("generation").join(active, "generation", "left_anti")


@query("config_hash", f"{_L} SELECT DISTINCT generation, substr(sha256(concat_ws(':', CASE WHEN generation % 2 = 0 THEN 'local' ELSE 'remote' END, 'model-' || generation % 7, 768)), 1, 16) AS config_hash FROM log")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("generation")
    text = F.concat_ws(":", F.when(g % 2 == 0, "local").otherwise("remote"), F.concat(F.lit("model-"), g % 7), F.lit("768"))
    return _log(spark, sf_dir).select("generation", F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("config_hash")).distinct()


@query("dedup_events", f"{_L} SELECT generation, kind, batch, min(seq) AS seq FROM log GROUP BY ALL")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of each event."""
    return _log(spark, sf_dir).groupBy("generation", "kind", "batch").agg(F.min("seq").alias("seq"))


@query("tumbling_counts", f"{_L} SELECT time_bucket(INTERVAL 1 HOUR, at_time) AS start, kind, count(*) AS n, round(sum(amount), 2) AS amount FROM log GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.window("at", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")).select(F.col("w.start").alias("start"), "kind", "n", "amount")


@query("sliding_counts", f"{_L} SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, at_time), time_bucket(INTERVAL 30 MINUTE, at_time) - INTERVAL 30 MINUTE]) AS start FROM log) GROUP BY start")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.window("at", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("session_counts", f"{_L}, s AS (SELECT *, CASE WHEN at_time - lag(at_time) OVER w >= INTERVAL 30 MINUTE OR lag(at_time) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM log WINDOW w AS (PARTITION BY generation ORDER BY at_time)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY generation ORDER BY at_time) AS session FROM s) SELECT generation, min(at_time) AS start, count(*) AS n FROM i GROUP BY generation, session")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("generation", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("generation", F.col("w.start").alias("start"), "n")


_RANGES = "ranges AS (SELECT l_orderkey AS file, (l_partkey % 50)::BIGINT AS start, (l_partkey % 50 + l_quantity::BIGINT % 9)::BIGINT AS \"end\" FROM lineitem)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_partkey") % 50).cast("bigint")
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), start.alias("start"), (start + F.rint("l_quantity").cast("bigint") % 9).alias("end"))  # halves to even, as DuckDB casts


@query("merge_ranges", f'WITH {_RANGES}, m AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM ranges), i AS (SELECT *, sum(CASE WHEN most IS NULL OR start > most + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT file, min(start) AS start, max("end") AS "end" FROM i GROUP BY file, island')
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_ranges(_ranges(spark, sf_dir), "file")


@query(
    "changed_symbols",
    f"""WITH {_RANGES}, symbols AS (SELECT o_orderkey AS file, s AS symbol, s * 10 AS start_line, s * 10 + 6 AS end_line FROM orders, range(6) t(s)),
    files AS (SELECT o_orderkey AS file FROM orders WHERE o_orderstatus = 'P'),
    wide AS (SELECT file FROM files WHERE file NOT IN (SELECT file FROM ranges))
    SELECT DISTINCT concat('f', file) AS path, concat('s', symbol) AS symbol FROM symbols JOIN files USING (file) WHERE file IN (FROM wide) OR EXISTS (SELECT 1 FROM ranges r WHERE r.file = symbols.file AND start_line <= r."end" AND r.start <= end_line)""",
)
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that a changed range touches; orders are files, their lines the ranges."""
    orders = load(spark, sf_dir, "orders")
    path = F.concat(F.lit("f"), F.col("file"))
    symbols = orders.select(F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s")).select(path.alias("path"), F.concat(F.lit("s"), "s").alias("symbol"), (F.col("s") * 10).alias("start_line"), (F.col("s") * 10 + 6).alias("end_line"))
    lists = _ranges(spark, sf_dir).groupBy("file").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    changed = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("file")).join(lists, "file", "left").select(path.alias("path"), F.lit(0).alias("seq"), "ranges")
    return C.changed_symbols(symbols, changed)


@query("changed_union", "SELECT DISTINCT l_orderkey AS path, 'modified' AS change FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 'untracked' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def changed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the diff, and untracked ones that are not among them."""
    diff = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path")).distinct()
    extra = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path")).join(diff, "path", "left_anti")
    return diff.withColumn("change", F.lit("modified")).unionByName(extra.withColumn("change", F.lit("untracked")))


@query("changed_norm", "SELECT event_id, 'f' || event_id AS path, CASE WHEN event_type = 'view' THEN 'modified' ELSE event_type END AS change_type, CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS ranges FROM events")
def changed_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of any form as one record with defaults."""
    given = F.when(F.col("event_type") != "view", F.col("event_type"))
    lines = F.when(F.col("event_type") == "click", F.array(F.lit(1), F.lit(5)))
    return load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("f"), "event_id").alias("path"), F.coalesce(given, F.lit("modified")).alias("change_type"), F.size(F.coalesce(lines, F.array().cast("array<int>"))).alias("ranges"))


@query("diff_status_map", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'renamed' ELSE 'modified' END AS change_type, CASE WHEN event_type = 'error' THEN 'old' ELSE 'new' END || user_id AS path FROM events")
def diff_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status letters as change types; a deleted file keeps its old path."""
    letter = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "D").when(F.col("event_type") == "click", "R").otherwise("M")
    kind = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "R", "renamed").otherwise("modified")
    return load(spark, sf_dir, "events").select("event_id", kind.alias("change_type"), F.concat(F.when(letter == "D", "old").otherwise("new"), F.col("user_id")).alias("path"))


@query(
    "resolve_entity",
    "SELECT c_custkey, coalesce(n.n_name, r.r_name, 'unknown') AS entity, CASE WHEN n.n_name IS NOT NULL THEN 'id' WHEN r.r_name IS NOT NULL THEN 'remote' ELSE 'none' END AS via FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND c_acctbal > 5000 LEFT JOIN region r ON r.r_regionkey = c_custkey % 7",
)
def resolve_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several ways to find an entity that leads to one."""
    c = load(spark, sf_dir, "customer").withColumn("r_regionkey", (F.col("c_custkey") % 7).cast("int")).withColumn("n_nationkey", F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey")))
    both = c.join(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left").join(load(spark, sf_dir, "region"), "r_regionkey", "left")
    return both.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("entity"), F.when(F.col("n_name").isNotNull(), "id").when(F.col("r_name").isNotNull(), "remote").otherwise("none").alias("via"))
