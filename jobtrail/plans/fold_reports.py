"""Reports on order-dependent folds. Those named ``…_hot_keys`` set the threshold low, so that the block path runs
for many keys of the table; the others use the threshold a job would use."""

from pyspark.sql import functions as F

from jobtrail.operators import folds
from jobtrail.operators import ordered
from jobtrail.plans.registry import report

_GREEDY = """r AS (SELECT key, ts, seq, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM src),
  w AS (SELECT key, rn, seq, ts, ts AS kept, true AS taken FROM r WHERE rn = 1
        UNION ALL SELECT r.key, r.rn, r.seq, r.ts, CASE WHEN r.ts >= w.kept + INTERVAL {gap} THEN r.ts ELSE w.kept END, r.ts >= w.kept + INTERVAL {gap}
        FROM w JOIN r ON r.key = w.key AND r.rn = w.rn + 1)"""


@report(
    "w10_dedup_within",
    f"""WITH src AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq FROM events), {_GREEDY.format(gap='6 HOUR')}
        SELECT key AS job_id, seq, epoch_us(ts) AS ts FROM w WHERE taken""",
    recursive=True,
)
def _(v):
    rows = v.events().select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts")
    return folds.dedup_within(rows, "job_id", "ts", 6 * 3600)


@report(
    "w10_dedup_within_hot_keys",
    f"""WITH src AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq FROM events), {_GREEDY.format(gap='6 HOUR')}
        SELECT key AS job_id, seq, epoch_us(ts) AS ts FROM w WHERE taken""",
    recursive=True,
)
def _(v):
    rows = v.events().select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts")
    return folds.dedup_within(rows, "job_id", "ts", 6 * 3600, hot_rows=66)


@report(
    "w13_throttle",
    f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq,
          max(ts - to_seconds(CAST(event_id % 7 AS BIGINT) * 7200)) OVER (PARTITION BY user_id ORDER BY event_id) AS ts FROM events),
        src AS (SELECT key, ts, min(seq) AS seq FROM p GROUP BY key, ts), {_GREEDY.format(gap='12 HOUR')}
        SELECT key, epoch_us(ts) AS ts FROM w WHERE taken""",
    recursive=True,
)
def _(v):
    progress = F.timestamp_micros(F.unix_micros("ts") - F.col("event_id") % 7 * F.lit(7200 * 1_000_000))
    rows = v.events().select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), progress.alias("ts"))
    return folds.throttle(rows, "key", "ts", 12 * 3600, ["seq"], [ordered.seq_block("seq", 3000)])


@report(
    "w13_throttle_hot_keys",
    f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq,
          max(ts - to_seconds(CAST(event_id % 7 AS BIGINT) * 7200)) OVER (PARTITION BY user_id ORDER BY event_id) AS ts FROM events),
        src AS (SELECT key, ts, min(seq) AS seq FROM p GROUP BY key, ts), {_GREEDY.format(gap='12 HOUR')}
        SELECT key, epoch_us(ts) AS ts FROM w WHERE taken""",
    recursive=True,
)
def _(v):
    progress = F.timestamp_micros(F.unix_micros("ts") - F.col("event_id") % 7 * F.lit(7200 * 1_000_000))
    rows = v.events().select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), progress.alias("ts"))
    return folds.throttle(rows, "key", "ts", 12 * 3600, ["seq"], [ordered.seq_block("seq", 3000)], hot_rows=30)


@report(
    "w14_lockout_report",
    """WITH r AS (SELECT key, ts, ok, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM attempts),
       w AS (SELECT key, rn, CASE WHEN ok THEN 0 ELSE 1 END AS n, ts + INTERVAL 3 DAY AS until, false AS locks, false AS refused FROM r WHERE rn = 1
         UNION ALL SELECT key, rn,
           CASE WHEN refused THEN n0 WHEN ok THEN 0 WHEN n0 = 0 OR ts > until0 THEN 1 ELSE n0 + 1 END,
           CASE WHEN refused OR ok THEN until0 ELSE ts + INTERVAL 3 DAY END,
           NOT refused AND NOT ok AND CASE WHEN n0 = 0 OR ts > until0 THEN 1 ELSE n0 + 1 END >= 4, refused
         FROM (SELECT r.key, r.rn, r.ts, r.ok, w.n AS n0, w.until AS until0, w.n >= 4 AND r.ts < w.until AS refused FROM w JOIN r ON r.key = w.key AND r.rn = w.rn + 1))
       SELECT key, epoch_us(until - INTERVAL 3 DAY) AS locked_from, epoch_us(until) AS locked_until, count(*) FILTER (refused) AS refused
       FROM w WHERE locks OR refused GROUP BY key, until""",
    "attempts",
    recursive=True,
)
def _(v):
    return folds.lockout_report(v.attempts(), 4, 3 * 86400)


@report(
    "w14_lockout_report_hot_keys",
    """WITH r AS (SELECT key, ts, ok, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM attempts),
       w AS (SELECT key, rn, CASE WHEN ok THEN 0 ELSE 1 END AS n, ts + INTERVAL 3 DAY AS until, false AS locks, false AS refused FROM r WHERE rn = 1
         UNION ALL SELECT key, rn,
           CASE WHEN refused THEN n0 WHEN ok THEN 0 WHEN n0 = 0 OR ts > until0 THEN 1 ELSE n0 + 1 END,
           CASE WHEN refused OR ok THEN until0 ELSE ts + INTERVAL 3 DAY END,
           NOT refused AND NOT ok AND CASE WHEN n0 = 0 OR ts > until0 THEN 1 ELSE n0 + 1 END >= 4, refused
         FROM (SELECT r.key, r.rn, r.ts, r.ok, w.n AS n0, w.until AS until0, w.n >= 4 AND r.ts < w.until AS refused FROM w JOIN r ON r.key = w.key AND r.rn = w.rn + 1))
       SELECT key, epoch_us(until - INTERVAL 3 DAY) AS locked_from, epoch_us(until) AS locked_until, count(*) FILTER (refused) AS refused
       FROM w WHERE locks OR refused GROUP BY key, until""",
    "attempts",
    recursive=True,
)
def _(v):
    return folds.lockout_report(v.attempts(), 4, 3 * 86400, hot_rows=26, steps=5, fanout=2)


_W15 = "SELECT job_id, string_agg(left(status, 1), '' ORDER BY ts, seq) AS result FROM status_events GROUP BY job_id"
_INITIAL = dict(start=str, step=lambda held, row: held + row[2][0], result="string", values=["status"])


@report("w15_ordered_fold", _W15, "status_events")
def _(v):
    return folds.ordered_fold(v.status_events(), ["job_id"], ["ts", "seq"], **_INITIAL)


@report("w15_ordered_fold_blocks", _W15, "status_events")
def _(v):
    """The same with every key cut into days, whose states are joined."""
    days = [ordered.time_block("ts", 86400)]
    return folds.ordered_fold(v.status_events(), ["job_id"], ["ts", "seq"], **_INITIAL, combine=lambda a, b: a + b, blocks=days)
