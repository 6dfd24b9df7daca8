"""Streaming operators run over a whole table and read back, to be compared with their batch twins."""

from pyspark.sql import functions as F

from jobtrail.operators.logs import batch_entries
from jobtrail.plans.lifecycle_reports import _LIST, _current, _depth, _updates
from jobtrail.plans.lifecycle_reports import ms as _ms
from jobtrail.plans.registry import report
from jobtrail.plans.scalar_reports import _DASHED, _HEX, _raw_id
from jobtrail.session import shared_dir
from jobtrail.sources.frames import read_frames
from jobtrail.sources.tables import read_raw_lines, read_status_events, snapshot_and_tail
from jobtrail.streaming import jobs as J
from jobtrail.streaming import state as K

_NOW = {"availableNow": True}
_SLICES = 6
DELAY = "6 days"

_TIMES = (
    "epoch_us(queued_at) AS queued_at, epoch_us(started_at) AS started_at, "
    "epoch_us(finished_at) AS finished_at, epoch_us(updated_at) AS updated_at"
)


#: Key and time of the row that closes a stream: it moves the clock past all others.
_END, _LAST = "~end", "TIMESTAMP '2030-01-01 00:00:00'"


def as_stream(v, df, name, slices=_SLICES):
    """A whole frame as a stream in several micro-batches, with a last row that lets the clock run out.

    The file source takes files by modification time, so time slices are appended one after the other, from a copy
    of the frame. Files of one slice are in no order; ``DELAY`` spans a slice, so that none of its rows is late.
    """
    staged, path = shared_dir(v.spark, f"{name}-rows"), shared_dir(v.spark, name)
    df.write.parquet(staged)
    rows, t = v.spark.read.parquet(staged), F.unix_micros("ts")
    low, high = rows.agg(F.min(t), F.max(t)).first()
    width = (high - low) // slices + 1
    for i in range(slices):
        inside = (t >= low + i * width) & (t < low + (i + 1) * width)
        # Rebalancing sizes the files: one for little data, many for much.
        rows.where(inside).hint("rebalance").write.mode("append").parquet(path)
    n_files = len(v.spark.read.parquet(path).inputFiles())
    ends = {f.name: F.lit(_END) if f.name in ("job_id", "raw_id", "value", "container_id") else F.lit(None) for f in df.schema.fields}
    ends |= {"ts": F.expr(_LAST)} | ({"topic": F.lit("jobs.status.Queued")} if "topic" in df.columns else {})
    ends |= {"status": F.lit("Queued")} if "status" in df.columns else {}
    ends |= {"seq": F.lit(0)} if "seq" in df.columns else {}
    ends |= {"logs": F.expr(f"array(struct({_LAST}, '', 'stdout'))")} if "logs" in df.columns else {}
    end = v.spark.range(1).select(*[ends[f.name].cast(f.dataType).alias(f.name) for f in df.schema.fields])
    end.write.mode("append").parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(2, n_files // slices)).parquet(path)


def real(df, column="job_id"):
    """Without what the closing row left behind."""
    return df.where(F.col(column) != _END)


def drain(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@report(
    "r01_stream_lifecycle",
    f"SELECT job_id, status, reason, {_TIMES} FROM summary",
    "summary",
)
def _(v):
    out = shared_dir(v.spark, "r01")
    events = as_stream(v, v.status_events(), "events")
    drain(J.start_updates(J.stream_lifecycle(events), f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(J.latest(v.spark, f"{out}/rows"))


@report(
    "r02_stream_expiry",
    f"""SELECT job_id, status, reason, {_TIMES},
          updated_at + CASE WHEN status IN ('Succeeded', 'Failed', 'Stopped') THEN INTERVAL 2 DAY ELSE INTERVAL 2200 DAY END
            < TIMESTAMP '2030-01-01' - INTERVAL 6 DAY AS is_expired FROM summary""",
    "summary",
)
def _(v):
    out = shared_dir(v.spark, "r02")
    events = as_stream(v, v.status_events(), "events")
    summaries = K.stream_lifecycle_expiring(events, DELAY, retention=2 * 86400, stale_ttl=2200 * 86400)
    drain(J.start_updates(summaries, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(J.latest(v.spark, f"{out}/rows"))


@report(
    "r03_stream_logs",
    """SELECT job_id, container_id, seq, CAST(pos AS BIGINT) AS pos, message, output_stream FROM batch_entries
       UNION ALL SELECT CAST(user_id AS VARCHAR), event_type, event_id, NULL, NULL, NULL FROM events WHERE event_type = 'signup'""",
    "batch_entries",
)
def _(v):
    out = shared_dir(v.spark, "r03")
    # Every third batch comes twice, as after a second watch.
    batches = v.log_batches()
    twice = batches.unionByName(batches.where(F.col("seq") % 3 == 0))
    drain(J.start_logs(as_stream(v, twice, "batches"), f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(J.read_logs(v.spark, f"{out}/rows")).select("job_id", "container_id", "seq", "pos", "message", "output_stream")


_RUNS = """(SELECT job_id, ts AS completed_at FROM
    (SELECT job_id, status, ts, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS prev FROM status_events WHERE status <> 'Queued')
    WHERE status <> 'Running' AND prev = 'Running')"""


@report(
    "r04_stream_completions",
    f"""SELECT c.job_id, epoch_us(completed_at) AS completed_at, epoch_us(first_at) AS first_at, true AS complete
        FROM {_RUNS} c JOIN (SELECT job_id, min(ts) AS first_at FROM status_events GROUP BY job_id) f ON f.job_id = c.job_id""",
    "status_events",
)
def _(v):
    out = shared_dir(v.spark, "r04c")
    events = as_stream(v, v.status_events(), "events")
    clock = as_stream(v, v.log_batches("day").select("ts"), "clock")
    ready = K.stream_completions(events, clock, DELAY)
    drain(J.start_append(ready, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return v.spark.read.parquet(f"{out}/rows").select("job_id", "completed_at", "first_at", "complete")


@report(
    "r04_stream_documents",
    f"""WITH e AS (SELECT job_id, max(completed_at) AS completed_at FROM {_RUNS} GROUP BY job_id),
        b AS (SELECT job_id, container_id, string_agg(concat(output_stream, ':', message), '|' ORDER BY seq, pos) AS lines, count(*) AS n FROM day_batch_entries GROUP BY ALL)
        SELECT e.job_id, epoch_us(completed_at) AS completed_at, s.slot, s.container_id, coalesce(b.n, 0) AS entries, md5(coalesce(b.lines, '')) AS digest
        FROM e JOIN day_slots s ON s.job_id = e.job_id LEFT JOIN b ON b.job_id = s.job_id AND b.container_id = s.container_id""",
    "status_events",
    "day_slots",
    "day_batch_entries",
)
def _(v):
    out = shared_dir(v.spark, "r04")
    batches = as_stream(v, v.log_batches("day"), "batches")
    drain(J.start_logs(batches, f"{out}/logs", f"{out}/logs-checkpoint", _NOW))
    events = as_stream(v, v.status_events(), "events")
    # A day of drain: in this data the log rows of a job run on until midnight.
    ready = K.stream_completions(events, J.committed_logs(v.spark, f"{out}/logs"), DELAY, drain=86400 + 30)
    drain(J.start_documents(ready, f"{out}/logs", f"{out}/docs", f"{out}/checkpoint", _NOW))
    # A job that completes again is written again, in a later batch or with both ends in one.
    docs = J.read_documents(v.spark, f"{out}/docs").select("job_id", "completed_at", F.inline("containers"))
    last = docs.groupBy("job_id", "slot", "container_id").agg(F.max_by(F.struct("completed_at", "entries"), "completed_at").alias("d"))
    line = F.transform("d.entries", lambda e: F.concat(e["output_stream"], F.lit(":"), e["message"]))
    return last.select(
        "job_id", "d.completed_at", "slot", "container_id", F.size("d.entries").cast("long").alias("entries"), F.md5(F.array_join(line, "|").cast("binary")).alias("digest")
    )


@report(
    "r06_stream_metrics",
    f"""WITH t AS (SELECT max(ts) AS as_of FROM status_events),
      k AS (SELECT s.* FROM summary s, t WHERE NOT (CASE WHEN status IN ('Succeeded', 'Failed', 'Stopped') THEN updated_at < as_of - INTERVAL 40 DAY ELSE updated_at < as_of - INTERVAL 4 DAY END)),
      d AS (SELECT CAST(trunc(CAST(sum(ms) AS DOUBLE) / count(*)) AS BIGINT) AS avg_ms, quantile_disc(ms, 0.95) AS p95_ms, count(*) AS n
        FROM (SELECT {_ms('started_at', 'finished_at')} AS ms FROM k WHERE started_at IS NOT NULL AND finished_at IS NOT NULL))
      SELECT 'status_count' AS metric, status AS dimension, count(*) AS value FROM k GROUP BY status
      UNION ALL SELECT 'queue_depth', coalesce(priority, 'total'), pending FROM ({_depth("true")})
      UNION ALL SELECT 'duration_avg_ms', '', avg_ms FROM d UNION ALL SELECT 'duration_p95_ms', '', p95_ms FROM d UNION ALL SELECT 'duration_count', '', n FROM d
      UNION ALL SELECT 'throughput_per_min', '', count(*) FROM k, t WHERE finished_at > as_of - INTERVAL 1 DAY""",
    "status_events",
    "summary",
    "queue",
)
def _(v):
    out = shared_dir(v.spark, "r06")
    # No closing row: the newest event is the snapshot's time.
    events = as_stream(v, v.status_events(), "events").where(F.col("job_id") != _END)
    queue, dispatched = (shared_dir(v.spark, x) for x in ("queue", "dispatched"))
    v.queue().write.parquet(queue)
    v.dispatched().write.parquet(dispatched)
    tables = (lambda spark: spark.read.parquet(queue)), (lambda spark: spark.read.parquet(dispatched))
    drain(J.start_metrics(events, *tables, f"{out}/state", f"{out}/metrics", f"{out}/checkpoint", _NOW, 40 * 86400, 4 * 86400, 86400, 400 * 86400))
    rows = v.spark.read.parquet(f"{out}/metrics")
    last = rows.agg(F.max("batch_id")).scalar()
    return rows.where(F.col("batch_id") == last).select("metric", "dimension", "value")


@report(
    "r07_stream_throughput",
    """WITH f AS (SELECT epoch_us(finished_at) - 1 AS t FROM summary WHERE finished_at IS NOT NULL),
       w AS (SELECT (t // 21600000000 - k) * 21600000000 AS a FROM f, (VALUES (0), (1), (2), (3)) o(k))
       SELECT a AS window_start, a + 86400000000 AS window_end, count(*) AS n FROM w GROUP BY a""",
    "summary",
)
def _(v):
    from jobtrail.operators.lifecycle import lifecycle

    out = shared_dir(v.spark, "r07")
    done = lifecycle(v.status_events()).where(F.col("finished_at").isNotNull()).select(F.col("finished_at").alias("ts"))
    counts = J.stream_throughput(as_stream(v, done, "finishes"), DELAY, "1 day", "6 hours")
    drain(J.start_append(counts, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return v.spark.read.parquet(f"{out}/rows")


@report(
    "r08_stream_dedup",
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
       w AS (SELECT key, rn, seq, ts, ts AS kept, true AS taken FROM r WHERE rn = 1
         UNION ALL SELECT r.key, r.rn, r.seq, r.ts, CASE WHEN r.ts >= w.kept + INTERVAL 6 HOUR THEN r.ts ELSE w.kept END, r.ts >= w.kept + INTERVAL 6 HOUR
         FROM w JOIN r ON r.key = w.key AND r.rn = w.rn + 1)
       SELECT key AS job_id, seq, epoch_us(ts) AS ts FROM w WHERE taken""",
    recursive=True,
)
def _(v):
    out = shared_dir(v.spark, "r08")
    rows = v.events().select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts")
    kept = K.stream_dedup(as_stream(v, rows, "queue"), 6 * 3600, watermark=DELAY)
    drain(J.start_append(kept, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(v.spark.read.parquet(f"{out}/rows"))


@report(
    "r09_stream_timeouts",
    """WITH r AS (SELECT job_id, status, ts, lag(status) OVER w AS prev, min(CASE WHEN status <> 'Running' THEN ts END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ended
         FROM order_events WHERE status <> 'Queued' WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq))
       SELECT r.job_id, 'Failed' AS status, concat('job timed out after ', CAST(timeout_seconds AS VARCHAR), ' seconds') AS reason,
         epoch_us(ts) + timeout_seconds * 1000000 AS deadline
       FROM r JOIN jobs j ON j.job_id = r.job_id
       WHERE r.status = 'Running' AND (prev IS NULL OR prev <> 'Running') AND timeout_seconds > 0 AND (ended IS NULL OR ended > ts + to_seconds(timeout_seconds))""",
    "order_events",
    "jobs",
)
def _(v):
    out = shared_dir(v.spark, "r09")
    events = as_stream(v, v.status_events("order"), "events")
    late = K.stream_timeouts(events, v.jobs(), DELAY)
    drain(J.start_append(late, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(v.spark.read.parquet(f"{out}/rows"))


@report(
    "r10_stream_split_rejects",
    f"""SELECT o_orderkey AS seq, CASE WHEN bad THEN NULL ELSE job_id END AS job_id,
          CASE WHEN bad THEN 'bad_id' WHEN o_custkey % 5 = 0 THEN 'missing_payload' WHEN o_custkey % 5 = 1 THEN 'bad_payload' ELSE 'ok' END AS reject,
          CASE WHEN bad OR o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN '{{"id": 12' ELSE concat('{{"id":"', job_id, '","name":"n"}}') END AS value
        FROM (SELECT *, o_orderkey % 6 = 4 OR (o_orderkey % 6 = 5 AND contains({_HEX}, 'a')) AS bad, {_DASHED} AS job_id FROM orders)""",
)
def _(v):
    out = shared_dir(v.spark, "r10")
    orders = v.table("orders")
    raw, dash = _raw_id(F.col("o_orderkey"))
    queue = orders.select(F.col("o_orderkey").alias("seq"), raw.alias("raw_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    body = F.when(F.col("o_custkey") % 5 == 1, F.lit('{"id": 12')).otherwise(F.to_json(F.struct(dash.alias("id"), F.lit("n").alias("name"))))
    stored = shared_dir(v.spark, "payloads")
    orders.where(F.col("o_custkey") % 5 != 0).select(dash.alias("job_id"), body.alias("value")).write.parquet(stored)
    drain(
        J.start_split_rejects(as_stream(v, queue, "queue"), lambda spark: spark.read.parquet(stored), f"{out}/ok", f"{out}/rejects", f"{out}/checkpoint", _NOW)
    )
    good = v.spark.read.parquet(f"{out}/ok").select("raw_id", "seq", "job_id", F.lit("ok").alias("reject"), "value")
    bad = v.spark.read.parquet(f"{out}/rejects").select("raw_id", "seq", "job_id", "reject", "value")
    return real(good.unionByName(bad), "raw_id").drop("raw_id")


@report(
    "s05_tail_logs",
    "SELECT job_id, container_id, seq, epoch_us(ts) AS ts, message, output_stream FROM day_batch_entries WHERE job_id = (SELECT min(job_id) FROM day_batch_entries)",
    "day_batch_entries",
)
def _(v):
    """The retained part as a snapshot, then what is appended as a stream: together every row once."""
    out, path = shared_dir(v.spark, "s05"), shared_dir(v.spark, "s05-logs")
    entries = batch_entries(v.log_batches("day")).select("job_id", "container_id", "seq", "pos", "ts", "message", "output_stream")
    early = F.col("seq") % 2 == 0
    entries.where(early).write.parquet(path)
    job = entries.agg(F.min("job_id")).first()[0]
    first, live = snapshot_and_tail(v.spark, path, job, f"{out}/files")
    entries.where(~early).write.mode("append").parquet(path)
    drain(J.start_append(live, f"{out}/rows", f"{out}/checkpoint", _NOW))
    rows = v.spark.read.schema(entries.schema).parquet(f"{out}/rows")
    return rows.unionByName(first).drop("pos")


@report(
    "s02_stream_status_events",
    "SELECT job_id, status, reason, epoch_us(ts) AS ts, seq FROM status_events",
    "status_events",
)
def _(v):
    out = shared_dir(v.spark, "s02")
    topic = F.concat(F.lit("jobs.status."), F.col("status"))
    raw = v.status_events().select(topic.alias("topic"), F.col("job_id").alias("value"), "reason", "ts", "seq")
    rows = read_status_events(as_stream(v, raw, "messages"))
    drain(J.start_append(rows, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(v.spark.read.parquet(f"{out}/rows")).select("job_id", "status", "reason", "ts", "seq")


@report(
    "s04_raw_lines",
    """SELECT CAST(doc_id % 16 AS VARCHAR) AS job_id, 'c' AS container_id, 'stdout' AS stream,
         row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id, i) - 1 AS line_no, line
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)""",
)
def _(v):
    """Texts of documents written as the output of sixteen jobs, in files by ranges of documents, and read back line by line."""
    path = shared_dir(v.spark, "s04")
    docs = v.table("documents").where(F.col("text").isNotNull())
    job = (F.col("doc_id") % 16).cast("string").alias("job_id")
    out = docs.select(job, F.lit("c").alias("container_id"), F.lit("stdout").alias("stream"), "doc_id", F.col("text").alias("value"))
    out = out.repartitionByRange("job_id", "doc_id").sortWithinPartitions("job_id", "doc_id").drop("doc_id")
    out.write.partitionBy("job_id", "container_id", "stream").text(path)
    return read_raw_lines(v.spark, path)


@report(
    "w12_stream_batches",
    """SELECT job_id, container_id, seq, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS batch_tick,
         (row_number() OVER (PARTITION BY job_id, container_id, floor(epoch_us(ts) / 86400000000) ORDER BY seq, pos) - 1) // 2 AS batch_id FROM log_entries""",
    "log_entries",
)
def _(v):
    """The rows of w12_assign_batches from a stream: a day is flushed when the clock has passed its end."""
    out = shared_dir(v.spark, "w12")
    entries = v.log_entries().select("job_id", "container_id", "seq", "pos", "ts")
    batches = K.stream_batches(as_stream(v, entries, "entries"), 2, 86400, DELAY)
    drain(J.start_append(batches, f"{out}/rows", f"{out}/checkpoint", _NOW))
    return real(v.spark.read.parquet(f"{out}/rows")).select("job_id", "container_id", "seq", "batch_tick", "batch_id")


@report(
    "s04_framed_lines",
    """SELECT CAST(doc_id % 16 AS VARCHAR) AS job_id, 'c' AS container_id, CASE i % 2 WHEN 0 THEN 'stdout' ELSE 'stderr' END AS stream,
         row_number() OVER (PARTITION BY doc_id % 16, i % 2 ORDER BY doc_id, i) - 1 AS line_no, line
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)""",
)
def _(v):
    """Texts written as interleaved frames: every other line to the second stream, two lines at a time in four frames of half a line."""
    path = shared_dir(v.spark, "s04-frames")
    docs = v.table("documents").where(F.col("text").isNotNull())
    job = (F.col("doc_id") % 16).cast("string").alias("job_id")
    lines = F.split("text", "\n")
    pairs = docs.select(job, "doc_id", lines.alias("l"), F.explode(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(2))).alias("i"))
    a, b = F.col("l")[F.col("i")].cast("binary"), F.get("l", F.col("i") + 1).cast("binary")
    half = lambda x: F.floor(F.octet_length(x) / 2).cast("int")

    def frame(stream, size, payload):
        length = F.unhex(F.lpad(F.hex(size.cast("long")), 8, "0"))
        return F.concat(F.unhex(F.lit(f"0{stream}000000")), length, payload)

    def first(stream, x):
        return frame(stream, half(x), F.substring(x, F.lit(1), half(x)))

    def rest(stream, x):
        return frame(stream, F.octet_length(x) - half(x) + 1, F.substring(x, half(x) + 1, F.octet_length(x)))

    # The writer's newline is the last byte of the row's last frame.
    both = F.concat(first(1, a), first(2, b), rest(1, a), F.lit(b"\n"), rest(2, b))
    one = F.concat(first(1, a), rest(1, a))
    out = pairs.select("job_id", F.lit("c").alias("container_id"), "doc_id", "i", F.when(b.isNull(), one).otherwise(both).cast("string").alias("value"))
    out = out.repartitionByRange("job_id", "doc_id", "i").sortWithinPartitions("job_id", "doc_id", "i").drop("doc_id", "i")
    out.write.partitionBy("job_id", "container_id").text(path)
    return read_frames(v.spark, path)


@report(
    "t03_live_list",
    f"""WITH u AS (SELECT job_id, status, nullif(reason, '') AS reason, seq,
          max(seq) FILTER (status <> 'Failed') OVER (PARTITION BY job_id) AS gone FROM user_events WHERE day(ts) > 25),
        n AS (SELECT job_id, arg_max(status, seq) AS status, arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason, min(seq) AS entry
          FROM u WHERE gone IS NULL OR seq > gone GROUP BY job_id),
        c AS (SELECT * FROM ({_LIST}) WHERE job_id NOT IN (SELECT job_id FROM u WHERE gone IS NOT NULL))
        SELECT coalesce(c.job_id, n.job_id) AS job_id, coalesce(n.status, c.status) AS status, coalesce(n.reason, c.reason) AS reason,
          row_number() OVER (ORDER BY c.position IS NOT NULL, coalesce(c.position, -entry), coalesce(c.job_id, n.job_id)) - 1 AS position
        FROM c FULL OUTER JOIN n ON c.job_id = n.job_id WHERE coalesce(n.status, c.status) = 'Failed'""",
    "user_events",
)
def _(v):
    """The feed of t03_upsert_summaries as a stream, in the order of its numbers; places are compared too."""
    out, first = shared_dir(v.spark, "t03"), shared_dir(v.spark, "t03-first")
    _current(v).write.parquet(first)
    late = _updates(v).withColumn("ts", F.timestamp_seconds("seq"))
    updates = as_stream(v, late, "updates").where(F.col("job_id") != _END).drop("ts")
    drain(J.start_live_list(updates, f"{out}/list", f"{out}/checkpoint", _NOW, lambda spark: spark.read.parquet(first), "Failed", 1 << 30))
    return J.live_list(v.spark, f"{out}/list").select("job_id", "status", "reason", "position")
