"""Reports on job timelines, lists and metrics."""

from pyspark.sql import functions as F

from jobtrail.functions import scalars as P
from jobtrail.operators import lifecycle as L
from jobtrail.operators import metrics as M
from jobtrail.plans.registry import AS_OF, report
from jobtrail.session import shared_dir
from jobtrail.sources import tables as T

_MS = "CAST(trunc((epoch_us({b}) - epoch_us({a})) / 1000) AS BIGINT)"


def ms(a: str, b: str) -> str:
    return _MS.format(a=a, b=b)


_TIMES = (
    "epoch_us(queued_at) AS queued_at, epoch_us(started_at) AS started_at, "
    "epoch_us(finished_at) AS finished_at, epoch_us(updated_at) AS updated_at"
)
_JOB_TIME = "coalesce(finished_at, started_at, queued_at)"


def summary(v):
    return L.lifecycle(v.status_events())


@report("s02_read_status_events", f"SELECT job_id, status, reason, epoch_us(ts) AS ts, seq FROM status_events WHERE seq % 17 <> 0", "status_events")
def _(v):
    # Messages as the broker keeps them; every 17th has a topic without a valid status.
    topic = F.when(F.col("seq") % 17 == 0, F.lit("jobs.status.")).otherwise(F.concat(F.lit("jobs.status."), F.col("status")))
    raw = v.status_events().select(topic.alias("topic"), F.col("job_id").alias("value"), "reason", "ts", "seq")
    return T.read_status_events(raw)


@report("f01_valid_events", "SELECT status, count(*) AS n FROM status_events WHERE seq % 5 <> 0 AND seq % 7 <> 0 GROUP BY status", "status_events")
def _(v):
    bad = v.status_events().withColumn("job_id", F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("job_id")))
    bad = bad.withColumn("status", F.when(F.col("seq") % 7 == 0, F.lower("status")).otherwise(F.col("status")))
    return M.status_counts(L.valid_events(bad))


@report("f02_filter_status", f"SELECT job_id, status, reason, {_TIMES} FROM summary WHERE lower(status) = 'failed'", "summary")
def _(v):
    return L.filter_status(summary(v), "FAILED")


@report(
    "f03_filter_topic",
    """SELECT topic, count(*) AS n FROM (SELECT concat('logs.', container_id, '.', CASE WHEN seq % 3 = 0 THEN 'a.b' ELSE job_id END) AS topic FROM log_entries)
       WHERE regexp_full_match(topic, 'logs\\.[^.]+\\.[^.]+') GROUP BY topic""",
    "log_entries",
)
def _(v):
    tail = F.when(F.col("seq") % 3 == 0, F.lit("a.b")).otherwise(F.col("job_id"))
    topic = F.concat(F.lit("logs."), F.col("container_id"), F.lit("."), tail)
    kept = L.filter_topic(v.log_entries().select(topic.alias("topic")), "logs.*.*")
    return kept.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@report("a01_lifecycle", f"SELECT job_id, status, reason, {_TIMES} FROM summary", "summary")
def _(v):
    return summary(v)


@report("a02_lifecycle_with_enqueue", f"SELECT job_id, status, reason, {_TIMES}, name, priority, step_count FROM enq_summary", "enq_summary")
def _(v):
    return L.lifecycle_with_enqueue(v.status_events(), v.enqueues())


@report("a03_status_counts", "SELECT status, count(*) AS n FROM summary GROUP BY status", "summary")
def _(v):
    return M.status_counts(summary(v))


@report(
    "a04_status_counts_filled",
    """SELECT CAST(ord AS BIGINT) AS ord, d.status, count(s.job_id) AS n
       FROM (VALUES (0, 'Queued'), (1, 'Running'), (2, 'Succeeded'), (3, 'Failed'), (4, 'Stopped')) d(ord, status)
       LEFT JOIN (SELECT * FROM summary WHERE status <> 'Stopped') s ON s.status = d.status GROUP BY ALL""",
    "summary",
)
def _(v):
    return M.status_counts_filled(summary(v).where(F.col("status") != "Stopped"))


def _depth(waiting: str) -> str:
    """Depth per priority and in total; ``waiting`` is a condition on queue rows."""
    return f"""SELECT priority, CAST(sum(n) AS BIGINT) AS pending FROM (
          SELECT priority, count(*) FILTER (dispatched_at IS NULL AND {waiting}) AS n FROM queue GROUP BY priority
          UNION ALL SELECT * FROM (VALUES ('high', 0), ('medium', 0), ('low', 0)) p(priority, n)) GROUP BY ROLLUP (priority)"""


@report("a05_queue_depth", _depth("true"), "queue")
def _(v):
    return M.queue_depth(v.queue(), v.dispatched())


@report("a05_queue_depth_one_empty", _depth("priority <> 'medium'"), "queue")
def _(v):
    return M.queue_depth(v.queue().where(F.col("priority") != "medium"), v.dispatched())


@report("a05_queue_depth_idle", _depth("false"), "queue")
def _(v):
    # Every queue row has been dispatched.
    return M.queue_depth(v.queue(), v.queue().select("job_id"))


@report("u04_pending", "SELECT job_id, queue, priority, seq FROM queue WHERE dispatched_at IS NULL", "queue")
def _(v):
    return M.pending(v.queue(), v.dispatched()).select("job_id", "queue", "priority", "seq")


_DURATIONS = f"SELECT status, {ms('started_at', 'finished_at')} AS ms FROM summary WHERE started_at IS NOT NULL AND finished_at IS NOT NULL"
_DURATION_COLS = "CAST(trunc(CAST(sum(ms) AS DOUBLE) / count(*)) AS BIGINT) AS avg_ms, quantile_disc(ms, 0.95) AS p95_ms, count(*) AS n"


@report("a06_duration_summary", f"SELECT status, {_DURATION_COLS} FROM ({_DURATIONS}) GROUP BY status", "summary")
def _(v):
    return M.duration_summary(summary(v), ["status"])


@report("a06_duration_summary_total", f"SELECT {_DURATION_COLS} FROM ({_DURATIONS})", "summary")
def _(v):
    return M.duration_summary(summary(v))


@report("a07_throughput", f"SELECT count(*) AS n FROM summary WHERE finished_at > {AS_OF} - INTERVAL 6 HOUR", "summary")
def _(v):
    return M.throughput(summary(v), v.as_of, 6 * 3600)


@report(
    "a08_metrics_snapshot",
    f"""WITH d AS (SELECT {_DURATION_COLS} FROM ({_DURATIONS})), m AS (
      SELECT 'status_count' AS metric, status AS dimension, count(*) AS value FROM summary GROUP BY status
      UNION ALL SELECT 'queue_depth', coalesce(priority, 'total'), pending FROM ({_depth("true")})
      UNION ALL SELECT 'duration_avg_ms', '', avg_ms FROM d UNION ALL SELECT 'duration_p95_ms', '', p95_ms FROM d
      UNION ALL SELECT 'duration_count', '', n FROM d
      UNION ALL SELECT 'throughput_per_min', '', count(*) FROM summary WHERE finished_at > {AS_OF} - INTERVAL 6 HOUR)
    SELECT epoch_us({AS_OF}) AS as_of, metric, dimension, value FROM m""",
    "summary",
    "queue",
)
def _(v):
    return M.metrics_snapshot(summary(v), v.queue(), v.dispatched(), v.as_of, 6 * 3600)


@report("a12_known_jobs", "SELECT DISTINCT job_id FROM status_events", "status_events")
def _(v):
    return L.known_jobs(v.status_events())


@report("a12_last_status", "SELECT job_id, arg_max(status, row(ts, seq)) AS status FROM user_events GROUP BY job_id", "user_events")
def _(v):
    return L.last_status(v.status_events("user"))


@report(
    "w05_sweep",
    f"""SELECT job_id, status, epoch_us(updated_at) AS updated_at FROM summary
        WHERE NOT (CASE WHEN status IN ('Succeeded', 'Failed', 'Stopped') THEN updated_at < {AS_OF} - INTERVAL 3 DAY
                   ELSE updated_at < {AS_OF} - INTERVAL 10 DAY END)""",
    "summary",
)
def _(v):
    return L.sweep(summary(v), v.as_of, 3 * 86400, 10 * 86400).select("job_id", "status", "updated_at")


@report(
    "w06_cap_newest",
    "SELECT job_id, epoch_us(updated_at) AS updated_at FROM summary ORDER BY summary.updated_at DESC, job_id DESC LIMIT 1000",
    "summary",
)
def _(v):
    return L.cap_newest(summary(v), 1000).select("job_id", "updated_at")


@report(
    "w16_transitions",
    f"""SELECT job_id, from_status, status AS to_status, {ms('from_ts', 'ts')} AS dwell_ms,
        CASE from_status WHEN 'Queued' THEN 0 WHEN 'Running' THEN 1 ELSE 2 END < CASE status WHEN 'Queued' THEN 0 WHEN 'Running' THEN 1 ELSE 2 END AS in_order
        FROM (SELECT *, lag(status) OVER w AS from_status, lag(ts) OVER w AS from_ts FROM user_events
              WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) WHERE from_status IS NOT NULL""",
    "user_events",
)
def _(v):
    return L.transitions(v.status_events("user"))


_ENRICHED = """CASE WHEN s.name = '' AND f.name IS NOT NULL THEN f.name ELSE s.name END AS name,
  CASE WHEN s.name = '' AND f.name IS NOT NULL AND s.step_count = 0 THEN f.step_count ELSE s.step_count END AS step_count"""


@report(
    "j01_enrich",
    f"SELECT s.job_id, s.status, {_ENRICHED} FROM enq_summary s LEFT JOIN job_facts f ON s.job_id = f.job_id",
    "enq_summary",
    "job_facts",
)
def _(v):
    summaries = L.lifecycle_with_enqueue(v.status_events(), v.enqueues())
    return L.enrich(summaries, v.job_facts()).select("job_id", "status", "name", "step_count")


@report(
    "j02_job_detail",
    f"""SELECT coalesce(s.job_id, p.id) AS job_id, coalesce(s.status, 'Unknown') AS status, coalesce(s.reason, '') AS reason,
          {_TIMES}, coalesce(p.name, '') AS name, CASE WHEN p.id IS NULL THEN 0 ELSE 2 END AS step_count,
          epoch_us(p.timestamp) AS submitted_at, coalesce(p.timeout_seconds, 0) AS timeout_seconds, p.id IS NOT NULL AS payload_available,
          CASE WHEN p.id IS NULL OR o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 4 = 0 THEN '' ELSE '••••••' END AS git_password,
          CASE WHEN p.id IS NOT NULL THEN concat('export DEPLOY_SECRET=••••••; svn checkout https://bot:••••••@code.example/tree') END AS script
        FROM order_summary s FULL OUTER JOIN payloads p ON s.job_id = p.id""",
    "order_summary",
    "payloads",
)
def _(v):
    detail = L.job_detail(L.lifecycle(v.status_events("order")), v.payloads())
    first = F.try_element_at("steps", F.lit(1))
    return detail.withColumns(
        {"git_password": F.try_element_at("metadata", F.lit("GIT_PASSWORD")), "script": first["script"]}
    ).drop("metadata", "steps")


_PAGE = f"SELECT *, {_JOB_TIME} AS job_time FROM enq_summary ORDER BY job_time DESC NULLS LAST, job_id LIMIT 500"


@report(
    "t01_job_list",
    f"SELECT s.job_id, s.status, epoch_us(s.job_time) AS job_time, {_ENRICHED} FROM ({_PAGE}) s LEFT JOIN job_facts f ON s.job_id = f.job_id",
    "enq_summary",
    "job_facts",
)
def _(v):
    summaries = L.lifecycle_with_enqueue(v.status_events(), v.enqueues())
    return L.job_list(summaries, v.job_facts()).select("job_id", "status", "job_time", "name", "step_count")


# The list before a feed: jobs seen up to day 25, newest first; updates are the later ones.
_LIST = """SELECT job_id, arg_max(status, row(ts, seq)) AS status, max(reason) FILTER (reason <> '') AS reason, -max(seq) AS position
  FROM user_events WHERE day(ts) <= 25 GROUP BY job_id"""
_UPDATES = "SELECT job_id, arg_max(row(status, nullif(reason, ''), seq), seq) AS u FROM user_events WHERE day(ts) > 25 GROUP BY job_id"


def _current(v):
    seen = v.status_events("user").where(F.day("ts") <= 25)
    return seen.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max(F.when(F.col("reason") != "", F.col("reason"))).alias("reason"),
        (-F.max("seq")).alias("position"),
    )


def _updates(v):
    late = v.status_events("user").where(F.day("ts") > 25)
    return late.select("job_id", "status", P.empty_to_null(F.col("reason")).alias("reason"), "seq")


@report(
    "t03_upsert_summaries",
    f"""WITH u AS (SELECT job_id, status, nullif(reason, '') AS reason, seq,
          max(seq) FILTER (status <> 'Failed') OVER (PARTITION BY job_id) AS gone FROM user_events WHERE day(ts) > 25),
        n AS (SELECT job_id, arg_max(status, seq) AS status, arg_max(reason, seq) FILTER (reason IS NOT NULL) AS reason, min(seq) AS entry
          FROM u WHERE gone IS NULL OR seq > gone GROUP BY job_id),
        c AS (SELECT * FROM ({_LIST}) WHERE job_id NOT IN (SELECT job_id FROM u WHERE gone IS NOT NULL))
        SELECT coalesce(c.job_id, n.job_id) AS job_id, coalesce(n.status, c.status) AS status, coalesce(n.reason, c.reason) AS reason
        FROM c FULL OUTER JOIN n ON c.job_id = n.job_id
        WHERE coalesce(n.status, c.status) = 'Failed'
        ORDER BY c.position IS NOT NULL, coalesce(c.position, -entry), coalesce(c.job_id, n.job_id) LIMIT 500""",
    "user_events",
)
def _(v):
    return L.upsert_summaries(_current(v), _updates(v), "Failed")


@report(
    "t04_merge_detail",
    f"""SELECT c.job_id, coalesce(u[1], c.status) AS status, coalesce(u[2], c.reason) AS reason, c.position
        FROM ({_LIST}) c LEFT JOIN ({_UPDATES}) n ON c.job_id = n.job_id""",
    "user_events",
)
def _(v):
    return L.merge_detail(_current(v), _updates(v))


@report(
    "s10_upsert_jobs",
    """SELECT job_id, arg_max(name, version) AS name, max(version) AS version
       FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, props AS name, event_id AS version FROM events) GROUP BY job_id""",
)
def _(v):
    rows = v.events().select(F.col("user_id").cast("string").alias("job_id"), F.col("props").alias("name"), F.col("event_id").alias("version"))
    early = F.col("version") % 2 == 0
    return T.upsert_jobs(rows.where(early), rows.where(~early))


@report(
    "s10_keyed_table",
    """SELECT job_id, arg_max(name, version) AS name, max(version) AS version
       FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, props AS name, event_id AS version FROM events) GROUP BY job_id""",
)
def _(v):
    """The same as a table on disk, written in three parts of which the last repeats the first."""
    path = shared_dir(v.spark, "s10")
    rows = v.events().select(F.col("user_id").cast("string").alias("job_id"), F.col("props").alias("name"), F.col("event_id").alias("version"))
    early = F.col("version") % 2 == 0
    for part in (rows.where(early), rows.where(~early), rows.where(early)):
        T.write_keyed(v.spark, path, part)
    return v.spark.read.parquet(path).select("job_id", "name", "version")


@report(
    "p37_job_times",
    f"""SELECT job_id, epoch_us({_JOB_TIME}) AS job_time,
        CASE WHEN started_at IS NOT NULL THEN {ms('started_at', f'coalesce(finished_at, {AS_OF})')} END AS duration_ms FROM summary""",
    "summary",
)
def _(v):
    s = L.with_duration(summary(v), v.as_of)
    when = P.job_time(F.col("finished_at"), F.col("started_at"), F.col("queued_at"))
    return s.select("job_id", when.alias("job_time"), "duration_ms")


@report(
    "p35_texts_of_times",
    f"""WITH t AS (SELECT job_id, CASE WHEN started_at IS NOT NULL THEN {ms('started_at', f'coalesce(finished_at, {AS_OF})')} END AS ms,
          {ms('updated_at', AS_OF)} AS age FROM summary),
        r AS (SELECT *, CAST(floor((age + 500) / 1000) AS BIGINT) AS s, CAST(floor((ms + 500) / 1000) AS BIGINT) AS d,
              CAST(floor((ms + 50) / 100) AS BIGINT) AS t FROM t)
        SELECT job_id, CASE WHEN ms IS NULL THEN '-' WHEN ms < 1000 THEN concat(ms, 'ms')
            WHEN ms < 60000 THEN concat(t // 10, '.', t % 10, 's') ELSE concat(d // 60, 'm ', d % 60, 's') END AS duration,
          CASE WHEN s < 60 THEN concat(s, 's ago') WHEN s < 3600 THEN concat(s // 60, 'm ago')
            WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END AS age FROM r""",
    "summary",
)
def _(v):
    s = L.with_duration(summary(v), v.as_of)
    return s.select(
        "job_id",
        P.format_duration(F.col("duration_ms")).alias("duration"),
        P.relative_time(F.col("updated_at"), v.as_of).alias("age"),
    )
