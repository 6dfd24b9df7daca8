"""Reports on log lines, batches and job documents."""

from datetime import date

from pyspark.sql import functions as F

from jobtrail.functions import text as X
from jobtrail.operators import lifecycle as L
from jobtrail.operators import logs as G
from jobtrail.plans.registry import AS_OF, report
from jobtrail.sources import tables as T

_SPACE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = f"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_PARSED = f"""WITH t AS (SELECT job_id, container_id, stream, line_no, {_TRIM} AS line FROM raw_lines),
  k AS (SELECT *, regexp_matches(line, 'time="[^"]*".*level="[^"]*".*msg="[^"]*"') AS structured, string_split(line, ' ') AS p FROM t WHERE line <> ''),
  x AS (SELECT *, CASE WHEN structured THEN regexp_replace(regexp_replace(p[2], '^time="', ''), '"$', '') ELSE p[1] END AS ts_text FROM k),
  y AS (SELECT *, CASE WHEN regexp_full_match(ts_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?Z')
    THEN TRY_CAST(replace(rtrim(ts_text, 'Z'), 'T', ' ') AS TIMESTAMP) END AS t FROM x),
  z AS (SELECT *, CASE WHEN structured THEN len(p) < 3 ELSE t IS NULL END AS whole FROM y),
  parsed AS (SELECT job_id, container_id, CAST(CASE WHEN stream = 'stdout' THEN 0 ELSE 1 END AS BIGINT) AS seq, line_no AS pos,
    epoch_us(coalesce(CASE WHEN NOT whole THEN t END, TIMESTAMP '2024-01-01')) AS ts,
    CASE WHEN whole THEN line WHEN structured THEN array_to_string(p[3:], ' ') ELSE array_to_string(p[2:], ' ') END AS message,
    stream AS output_stream, CASE WHEN whole OR t IS NULL THEN 'fallback' WHEN structured THEN 'structured' ELSE 'simple' END AS kind FROM z)"""


def _ingest():
    return F.lit("2024-01-01").cast("timestamp")


@report("p18_parse_logs", f"{_PARSED} SELECT * FROM parsed", "raw_lines")
def _(v):
    return G.parse_logs(v.raw_lines(), _ingest())


@report(
    "p18_parse_counts",
    f"""{_PARSED} SELECT job_id, count(*) FILTER (kind = 'structured') AS structured, count(*) FILTER (kind = 'simple') AS simple,
        count(*) FILTER (kind = 'fallback') AS fallback FROM parsed GROUP BY job_id""",
    "raw_lines",
)
def _(v):
    return G.parse_counts(G.parse_logs(v.raw_lines(), _ingest()))


@report("f05_non_blank", f"SELECT job_id, line_no, {_TRIM} AS line FROM raw_lines WHERE {_TRIM} <> ''", "raw_lines")
def _(v):
    return G.non_blank(v.raw_lines()).select("job_id", "line_no", "line")


@report(
    "u01_union_streams",
    """SELECT job_id, stream, line_no, CAST(CASE WHEN stream = 'stdout' THEN 0 ELSE 1 END AS BIGINT) AS seq FROM raw_lines""",
    "raw_lines",
)
def _(v):
    lines = v.raw_lines().select("job_id", "stream", "line_no")
    part = lambda name: lines.where(F.col("stream") == name).drop("stream")
    return G.union_streams(part("stdout"), part("stderr"))


@report(
    "p18_rfc3339",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 7200000000 WHEN 2 THEN epoch_us(ts) + 19800000000 END AS ts,
         CASE WHEN event_id % 5 < 3 THEN epoch_us(ts) % 1000000 * 1000 + CASE WHEN event_id % 5 = 0 THEN 789 ELSE 0 END END AS nanos FROM events""",
)
def _(v):
    form = F.col("event_id") % 5
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(form == 0, F.concat(base, F.lit("789Z")))
        .when(form == 1, F.concat(base, F.lit("+02:00")))
        .when(form == 2, F.concat(base, F.lit("-05:30")))
        .when(form == 3, base)
        .otherwise(F.concat(F.lit("x"), base, F.lit("Z")))
    )
    return v.events().select("event_id", X.rfc3339(text).alias("ts"), X.rfc3339_nanos(text).alias("nanos"))


@report(
    "s03_read_log_batches",
    """SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS container_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS entries, CASE WHEN event_type <> 'signup' THEN props END AS message
       FROM events WHERE event_id % 10 > 1""",
)
def _(v):
    form = F.col("seq") % 10
    batch = v.log_batches().withColumn("job_id", F.when(form == 1, "").otherwise(F.col("job_id")))
    text = F.to_json(F.struct("job_id", "container_id", "logs"))
    raw = batch.select("seq", F.when(form == 0, F.substring(text, F.lit(2), F.length(text))).otherwise(text).alias("value"))
    read = T.read_log_batches(raw)
    first = F.try_element_at("logs", F.lit(1))["message"]
    return read.select("job_id", "container_id", "seq", F.coalesce(F.size("logs"), F.lit(0)).alias("entries"), first.alias("message"))


@report("f04_valid_batches", "SELECT container_id, count(*) AS n FROM log_entries WHERE seq % 3 <> 0 AND seq % 4 <> 0 GROUP BY container_id", "log_entries")
def _(v):
    rows = v.log_entries().withColumn("job_id", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("job_id")))
    rows = rows.withColumn("container_id", F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("container_id")))
    return G.valid_batches(rows).groupBy("container_id").agg(F.count(F.lit(1)).alias("n"))


@report("w01_container_slots", "SELECT * FROM day_slots", "day_slots")
def _(v):
    return G.container_slots(v.log_batches("day"), block=1000)


@report(
    "w02_number_lines",
    "SELECT seq, job_id, container_id, row_number() OVER (PARTITION BY job_id, container_id ORDER BY seq, pos) - 1 AS line_no FROM log_entries",
    "log_entries",
)
def _(v):
    return G.number_lines(v.log_entries(), block=2000).select("seq", "job_id", "container_id", "line_no")


_TRIMMED = """SELECT *, row_number() OVER (PARTITION BY job_id, container_id ORDER BY seq, pos) AS up FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, container_id ORDER BY seq DESC, pos DESC) AS rn FROM batch_entries) WHERE rn <= 5"""


@report("w03_tail_trim", "SELECT job_id, container_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id, container_id ORDER BY seq DESC, pos DESC) AS rn FROM log_entries) WHERE rn <= 5", "log_entries")
def _(v):
    return G.tail_trim(v.log_entries(), 5, block=2000).select("job_id", "container_id", "seq")


@report(
    "w04_retain_batches",
    f"""SELECT job_id, seq FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS g FROM (
          SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM log_entries WHERE ts >= {AS_OF} - INTERVAL 20 DAY) WHERE rn <= 30)
        WHERE g <= 700""",
    "log_entries",
)
def _(v):
    kept = G.retain_batches(v.log_batches(), v.as_of, 20 * 86400, 30, 700, block=1000)
    return kept.select("job_id", "seq")


_REPLAYED = """SELECT *, row_number() OVER (PARTITION BY job_id, container_id, d, output_stream, message ORDER BY seq) AS rn FROM
  (SELECT *, date_trunc('day', ts) AS d FROM log_entries)"""


@report("w11_dedup_replay", f"SELECT job_id, container_id, epoch_us(d) AS ts, output_stream, message, seq FROM ({_REPLAYED}) WHERE rn = 1", "log_entries")
def _(v):
    rows = v.log_entries().withColumn("ts", F.date_trunc("day", "ts"))
    return G.dedup_replay(rows).select("job_id", "container_id", "ts", "output_stream", "message", "seq")


@report("u02_union_backlog", "SELECT job_id, container_id, seq, epoch_us(ts) AS ts, message FROM log_entries", "log_entries")
def _(v):
    rows = v.log_entries()
    backlog, live = rows.where(F.col("seq") % 3 != 0), rows.where(F.col("seq") % 3 != 1)
    return G.union_backlog(backlog, live).select("job_id", "container_id", "seq", "ts", "message")


@report(
    "w12_assign_batches",
    """SELECT job_id, container_id, seq, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS batch_tick,
         (row_number() OVER (PARTITION BY job_id, container_id, floor(epoch_us(ts) / 86400000000) ORDER BY seq, pos) - 1) // 2 AS batch_id FROM log_entries""",
    "log_entries",
)
def _(v):
    return G.assign_batches(v.log_entries(), 2, 86400).select("job_id", "container_id", "seq", "batch_tick", "batch_id")


_DOC_LINES = "string_agg(concat(output_stream, ':', message), '|' ORDER BY seq, pos)"
_COALESCED = f"""SELECT s.job_id, s.slot, s.container_id, coalesce(lines, '') AS lines, coalesce(n, 0) AS n_entries FROM slots s LEFT JOIN
  (SELECT job_id, container_id, {_DOC_LINES} AS lines, count(*) AS n FROM ({_TRIMMED}) GROUP BY ALL) e ON e.job_id = s.job_id AND e.container_id = s.container_id"""


def _lines(entries):
    return F.array_join(F.transform(entries, lambda e: F.concat(e["output_stream"], F.lit(":"), e["message"])), "|")


@report("a09_coalesce_logs", _COALESCED, "slots", "batch_entries")
def _(v):
    boxes = G.coalesce_logs(v.log_batches(), 5)
    return boxes.select("job_id", "slot", "container_id", _lines(F.col("entries")).alias("lines"), "n_entries")


@report(
    "a09_ordered_lines",
    """SELECT e.job_id, e.container_id, e.seq, e.pos::BIGINT AS pos, slot, row_number() OVER (PARTITION BY e.job_id, e.container_id ORDER BY e.seq, e.pos) - 1 AS line_no
       FROM batch_entries e JOIN slots s ON s.job_id = e.job_id AND s.container_id = e.container_id""",
    "slots",
    "batch_entries",
)
def _(v):
    return G.ordered_lines(v.log_batches(), 0, block=3000).select("job_id", "container_id", "seq", "pos", "slot", "line_no")


@report(
    "a09_coalesce_logs_uncapped",
    f"""SELECT s.job_id, s.slot, s.container_id, piece, greatest(ceil(n / 7), 1)::BIGINT AS pieces, coalesce(lines, '') AS lines, coalesce(n, 0) AS n_entries
        FROM slots s LEFT JOIN (SELECT job_id, container_id, count(*) AS n FROM batch_entries GROUP BY ALL) c ON c.job_id = s.job_id AND c.container_id = s.container_id,
          LATERAL (SELECT unnest(range(greatest(ceil(coalesce(n, 0) / 7), 1)::BIGINT)) AS piece) p
        LEFT JOIN (SELECT job_id, container_id, line_no // 7 AS at, {_DOC_LINES} AS lines
          FROM (SELECT *, row_number() OVER (PARTITION BY job_id, container_id ORDER BY seq, pos) - 1 AS line_no FROM batch_entries) GROUP BY ALL) e
        ON e.job_id = s.job_id AND e.container_id = s.container_id AND e.at = piece""",
    "slots",
    "batch_entries",
)
def _(v):
    boxes = G.coalesce_logs(v.log_batches(), 0, piece_lines=7)
    return boxes.select("job_id", "slot", "container_id", "piece", "pieces", _lines(F.col("entries")).alias("lines"), "n_entries")


@report(
    "a10_job_documents",
    f"""WITH c AS (SELECT *, sum(n_entries + 1) OVER (PARTITION BY job_id ORDER BY slot) - n_entries - 1 AS before FROM ({_COALESCED}))
        SELECT job_id, CAST(before // 8 AS BIGINT) AS part, CAST(last // 8 + 1 AS BIGINT) AS parts,
          string_agg(concat(container_id, '=', lines), ';' ORDER BY slot) AS body
        FROM (SELECT *, max(before) OVER (PARTITION BY job_id) AS last FROM c) GROUP BY job_id, before // 8, last""",
    "slots",
    "batch_entries",
)
def _(v):
    docs = G.job_documents(v.log_batches(), 5, part_lines=8)
    body = F.array_join(F.transform("containers", lambda c: F.concat(c["container_id"], F.lit("="), _lines(c["entries"]))), ";")
    return docs.select("job_id", "part", "parts", body.alias("body"))


@report(
    "a10_job_documents_uncapped",
    f"""SELECT s.job_id, md5(string_agg(concat(s.container_id, '=', coalesce(lines, '')), ';' ORDER BY slot)) AS digest
        FROM slots s LEFT JOIN (SELECT job_id, container_id, {_DOC_LINES} AS lines FROM batch_entries GROUP BY ALL) e ON e.job_id = s.job_id AND e.container_id = s.container_id
        GROUP BY s.job_id""",
    "slots",
    "batch_entries",
)
def _(v):
    """Whole documents put together from small parts that cut containers."""
    docs = G.job_documents(v.log_batches(), 0, piece_lines=5, part_lines=9)

    def text(c):
        head = F.when(c["piece"] == 0, F.concat(F.when(c["slot"] == 0, "").otherwise(";"), c["container_id"], F.lit("="))).otherwise("|")
        return F.concat(head, _lines(c["entries"]))

    parts = docs.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("part", F.array_join(F.transform("containers", text), "").alias("t")))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return parts.select("job_id", F.md5(whole.cast("binary")).alias("digest"))


@report("a10_step_log", f"SELECT job_id, container_id, lines FROM ({_COALESCED}) WHERE slot = 1", "slots", "batch_entries")
def _(v):
    step = G.step_log_at(G.job_documents(v.log_batches(), 5), 1)
    return step.select("job_id", "container_id", _lines(F.col("entries")).alias("lines"))


@report(
    "t02_log_tail",
    f"""WITH l AS (SELECT e.job_id, slot, left(e.container_id, 12) AS container, up - 1 AS line_no, epoch_us(ts) AS ts, message, output_stream = 'stderr' AS is_stderr
          FROM ({_TRIMMED}) e JOIN slots s ON s.job_id = e.job_id AND s.container_id = e.container_id)
        SELECT * EXCLUDE (rn) FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS total, row_number() OVER (PARTITION BY job_id ORDER BY slot DESC, line_no DESC) AS rn FROM l)
        WHERE rn <= 12""",
    "slots",
    "batch_entries",
)
def _(v):
    return G.log_tail(v.log_batches(), 12, 5, block=2000)


@report(
    "s06_job_logs",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS job_id, slot, container_id, lines FROM customer
        LEFT JOIN ({_COALESCED}) l ON l.job_id = CAST(c_custkey AS VARCHAR)""",
    "slots",
    "batch_entries",
)
def _(v):
    requests = v.table("customer").select(F.col("c_custkey").cast("string").alias("job_id"))
    logs = G.requested_logs(G.coalesce_logs(v.log_batches(), 5), requests)
    return logs.select("job_id", "slot", "container_id", _lines(F.col("entries")).alias("lines"))


@report(
    "s07_since",
    """SELECT e.job_id, e.container_id, seq FROM log_entries e LEFT JOIN
         (SELECT job_id, container_id, max(ts) AS offset_ts FROM log_entries WHERE container_id <> 'view' AND day(ts) <= 20 GROUP BY ALL) o
         ON o.job_id = e.job_id AND o.container_id = e.container_id WHERE offset_ts IS NULL OR ts >= offset_ts""",
    "log_entries",
)
def _(v):
    seen = v.log_entries().where((F.col("container_id") != "view") & (F.day("ts") <= 20))
    offsets = seen.groupBy("job_id", "container_id").agg(F.max("ts").alias("offset_ts"))
    return G.since(v.log_entries(), offsets).select("job_id", "container_id", "seq")


@report(
    "j05_watched_logs",
    "SELECT job_id, container_id, seq FROM day_entries WHERE job_id IN (SELECT job_id FROM status_events WHERE status = 'Running')",
    "day_entries",
    "status_events",
)
def _(v):
    return G.watched_logs(v.log_entries("day"), v.status_events()).select("job_id", "container_id", "seq")


_USABLE = "callback_url LIKE 'https://%'"


@report(
    "j06_delivery_set",
    f"""SELECT c.job_id, callback_url, epoch_us(completed_at) AS completed_at FROM order_completions c JOIN jobs j ON j.job_id = c.job_id WHERE {_USABLE}""",
    "order_completions",
    "jobs",
)
def _(v):
    return G.delivery_set(v.status_events("order"), v.jobs())


@report(
    "j10_logs_in_run",
    """SELECT seq, e.job_id, coalesce(ts >= started_at AND (finished_at IS NULL OR ts <= finished_at), false) AS in_run
       FROM day_entries e LEFT JOIN summary s ON s.job_id = e.job_id""",
    "day_entries",
    "summary",
)
def _(v):
    return G.logs_in_run(v.log_entries("day"), L.lifecycle(v.status_events())).select("seq", "job_id", "in_run")


@report(
    "w07_flush_expired",
    f"""SELECT seq, job_id FROM day_entries WHERE job_id NOT IN (SELECT job_id FROM completions WHERE completed_at <= {AS_OF} - INTERVAL 10 DAY)""",
    "day_entries",
    "completions",
)
def _(v):
    return G.flush_expired(v.log_entries("day"), v.status_events(), v.as_of, 10 * 86400).select("seq", "job_id")


_ORDER_KEY = "CAST(user_id * 30 + day(ts) - 1 AS VARCHAR)"


@report(
    "s08_export_job_logs",
    f"""WITH sl AS (SELECT job_id, container_id, row_number() OVER (PARTITION BY job_id ORDER BY first_seq, container_id) - 1 AS slot
          FROM (SELECT {_ORDER_KEY} AS job_id, event_type AS container_id, min(event_id) AS first_seq FROM events GROUP BY ALL)),
        e AS (SELECT {_ORDER_KEY} AS job_id, event_type AS container_id, string_agg(concat(CASE pos WHEN 1 THEN 'stderr' ELSE 'stdout' END, ':', props), '|' ORDER BY event_id, pos) AS lines
          FROM events, (VALUES (0), (1)) p(pos) WHERE event_type <> 'signup' AND (pos = 0 OR event_type = 'error') GROUP BY ALL)
        SELECT CASE WHEN callback_url LIKE '%h_x%' THEN 'h_x' ELSE 'host.example:8443' END AS target_host, callback_url, c.job_id,
          slot, sl.container_id, md5(coalesce(lines, '')) AS digest
        FROM order_completions c JOIN jobs j ON j.job_id = c.job_id JOIN sl ON sl.job_id = c.job_id
        LEFT JOIN e ON e.job_id = sl.job_id AND e.container_id = sl.container_id WHERE {_USABLE}""",
    "order_completions",
    "jobs",
)
def _(v):
    """The bodies of a job's parts, cut small here, must make one JSON text with every line in it."""
    docs = G.job_documents(v.log_batches("order"), 0, piece_lines=3, part_lines=4)
    out = T.export_job_logs(docs, G.delivery_set(v.status_events("order"), v.jobs()))
    whole = out.groupBy("target_host", "callback_url", "job_id").agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["body"]), "")
    shape = "array<struct<job_id: string, container_id: string, logs: array<struct<message: string, output_stream: string>>>>"
    boxes = whole.select("target_host", "callback_url", F.posexplode(F.from_json(text, shape)).alias("slot", "c"))
    digest = F.md5(_lines(F.col("c.logs")).cast("binary")).alias("digest")
    return boxes.select("target_host", "callback_url", "c.job_id", "slot", "c.container_id", digest)


@report(
    "s11_validated_writes",
    "SELECT CAST(ts AS DATE)::VARCHAR AS event_date, count(*) AS n FROM status_events WHERE seq % 4 <> 0 GROUP BY 1",
    "status_events",
)
def _(v):
    from jobtrail.session import shared_dir

    path = shared_dir(v.spark, "status")
    bad = v.status_events().withColumn("status", F.when(F.col("seq") % 4 == 0, "Paused").otherwise(F.col("status")))
    T.write_status(bad, path)
    back = v.spark.read.parquet(path)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))


@report(
    "r11_expire_partitions",
    f"SELECT job_id, container_id, seq FROM log_entries WHERE ts >= {AS_OF} - INTERVAL 5 DAY",
    "log_entries",
)
def _(v):
    from jobtrail.session import shared_dir

    path = shared_dir(v.spark, "logs")
    T.write_logs(v.log_entries(), path)
    return T.expire_partitions(v.spark, path, v.as_of, 5 * 86400).select("job_id", "container_id", "seq")


@report(
    "r11_drop_expired",
    f"SELECT job_id, container_id, seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM log_entries WHERE CAST(ts AS DATE) >= CAST({AS_OF} - INTERVAL 5 DAY AS DATE)",
    "log_entries",
)
def _(v):
    """Two calls: the first publishes the oldest date to keep, the second deletes; the folders left are read as they are."""
    from jobtrail.session import shared_dir

    path = shared_dir(v.spark, "dated-logs")
    T.write_logs(v.log_entries(), path)
    for _i in range(2):
        T.drop_expired(v.spark, path, date(2024, 1, 31), 5)
    return v.spark.read.parquet(path).select("job_id", "container_id", "seq", F.col("event_date").cast("string").alias("event_date"))
