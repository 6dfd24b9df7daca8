"""Reports that apply the scalar functions over whole tables."""

from pyspark.sql import functions as F

from jobtrail import schemas as S
from jobtrail.functions import redact as R
from jobtrail.functions import scalars as P
from jobtrail.operators import admission as A
from jobtrail.operators import execution as E
from jobtrail.plans import views_sql as Q
from jobtrail.plans.registry import report
from jobtrail.sources import tables as T

_RANKS = "CASE WHEN bucket = 'high' THEN 3 WHEN bucket = 'medium' THEN 2 ELSE 1 END"


@report(
    "p01_priority_bucket",
    f"""WITH b AS (SELECT l_linenumber - 3 AS priority, CASE WHEN l_linenumber - 3 >= 3 THEN 'high' WHEN l_linenumber - 3 <= 1 THEN 'low'
          ELSE 'medium' END AS bucket FROM lineitem)
        SELECT CAST(priority AS BIGINT) AS priority, bucket, CAST({_RANKS} AS BIGINT) AS rank, count(*) AS n FROM b GROUP BY ALL""",
)
def _(v):
    rows = v.table("lineitem").select((F.col("l_linenumber") - 3).alias("priority"))
    named = rows.withColumn("bucket", P.priority_bucket(F.col("priority")))
    return named.groupBy("priority", "bucket", P.priority_rank(F.col("bucket")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@report(
    "p04_status_from_topic",
    """SELECT seq, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN lower(status) ELSE status END AS status, seq % 4 = 3 AS valid
       FROM status_events""",
    "status_events",
)
def _(v):
    s, form = F.col("status"), F.col("seq") % 4
    topic = F.when(form == 0, s).when(form == 1, F.concat(s, F.lit("."))).when(form == 2, F.concat(F.lit("a."), F.lower(s)))
    status = P.status_from_topic(topic.otherwise(F.concat(F.lit("a.b."), s)))
    return v.status_events().select("seq", status.alias("status"), P.is_valid_status(status).alias("valid"))


@report(
    "p06_terminal_share",
    "SELECT status, status IN ('Succeeded', 'Failed', 'Stopped') AS terminal, count(*) AS n FROM status_events GROUP BY ALL",
    "status_events",
)
def _(v):
    s = F.col("status")
    return v.status_events().groupBy("status", P.is_terminal(s).alias("terminal")).agg(F.count(F.lit(1)).alias("n"))


@report(
    "p07_first_reason",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN props ELSE event_type END AS reason FROM events",
)
def _(v):
    e = F.col("event_id") % 3
    reasons = F.when(e == 0, F.array(F.lit(""), F.lit(""))).when(e == 1, F.array(F.lit(""), "props", "event_type")).otherwise(
        F.array("event_type", F.lit(""))
    )
    return v.events().select("event_id", P.first_reason(reasons).alias("reason"))


@report(
    "p08_memory_limits",
    f"""SELECT memory_limit, {Q.mem_bytes('memory_limit')} AS bytes, {Q.mem_error('memory_limit')} AS error, count(*) AS n
        FROM step_rows GROUP BY memory_limit""",
    "step_rows",
)
def _(v):
    c = F.col("memory_limit")
    return v.step_rows().groupBy("memory_limit", P.memory_limit_bytes(c).alias("bytes"), P.memory_limit_error(c).alias("error")).agg(
        F.count(F.lit(1)).alias("n")
    )


@report(
    "p09_find_limits",
    f"""SELECT job_id, sum(CASE WHEN cpu_limit = 0 THEN 3 ELSE least(cpu_limit, 3) END)::BIGINT AS cpu,
        sum(coalesce(least(nullif({Q.mem_bytes('memory_limit')}, 0), nullif({Q.mem_bytes('memory_swap')}, 0)), 0))::BIGINT AS memory
        FROM step_rows GROUP BY job_id""",
    "step_rows",
)
def _(v):
    limits = v.step_rows().select(
        "job_id",
        P.find_limit(F.col("cpu_limit"), F.lit(3)).alias("c"),
        P.find_memory_limit(F.col("memory_limit"), F.col("memory_swap")).alias("m"),
    )
    return limits.groupBy("job_id").agg(F.sum("c").alias("cpu"), F.sum("m").alias("memory"))


@report("p11_network_modes", f"SELECT network, {Q.net_error('network')} AS error, count(*) AS n FROM step_rows GROUP BY network", "step_rows")
def _(v):
    c = F.col("network")
    return v.step_rows().groupBy("network", P.network_mode_error(c).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@report(
    "p12_callback_urls",
    f"""SELECT job_id, {Q.url_error('callback_url')} AS error,
        CASE callback_url WHEN 'https://user:tok@h_x/logs?s=1#f' THEN 'https://h_x/logs' ELSE callback_url END AS clean FROM jobs""",
    "jobs",
)
def _(v):
    url = F.col("callback_url")
    return v.jobs().select("job_id", P.callback_url_error(url).alias("error"), P.sanitize_callback_url(url).alias("clean"))


@report(
    "p12_page_urls",
    """SELECT page_id, url, CASE WHEN regexp_matches(url, '^https?://[^/?#]') THEN NULL ELSE 'bad' END AS error,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^([^?#]*)', 1) AS clean FROM pages""",
)
def _(v):
    url = F.col("url")
    error = F.when(P.callback_url_error(url).isNotNull(), "bad")
    return v.table("pages").select(
        "page_id", "url", error.alias("error"), P.callback_host(url).alias("host"), P.sanitize_callback_url(url).alias("clean")
    )


_STEP_ENV = """SELECT s.job_id, s.id AS step_id, s.script, s.continue_on_error, p.name FROM payload_steps s JOIN payloads p ON p.id = s.job_id"""
_ENV = f"""steps AS ({_STEP_ENV}),
  all_env AS (
    SELECT job_id, step_id, 'UUID' AS key, job_id AS value, 3 AS prio FROM steps
    UNION ALL SELECT job_id, step_id, 'JOB_NAME', name, 3 FROM steps
    UNION ALL SELECT job_id, step_id, 'STEP_SCRIPT', script, 3 FROM steps WHERE continue_on_error AND trim(script) <> ''
    UNION ALL SELECT job_id, step_id, key, value, 2 FROM payload_meta WHERE step_id > 0
    UNION ALL SELECT s.job_id, s.step_id, m.key, m.value, 1 FROM steps s JOIN payload_meta m ON m.job_id = s.job_id AND m.step_id = 0)"""


@report(
    "p14_env_report",
    f"""WITH {_ENV} SELECT job_id, CAST(step_id AS BIGINT) AS step_id, key, arg_max(value, prio) AS value,
        CASE max(prio) WHEN 3 THEN 'reserved' WHEN 2 THEN 'step' ELSE 'job' END AS source FROM all_env GROUP BY job_id, step_id, key""",
    "payloads",
    "payload_steps",
    "payload_meta",
)
def _(v):
    return E.env_report(v.payloads(), script_key="STEP_SCRIPT")


@report(
    "p15_env_rows",
    """SELECT job_id, string_agg(concat(key, '=', value), ';' ORDER BY key) AS env FROM payload_meta WHERE step_id = 0 GROUP BY job_id""",
    "payload_meta",
)
def _(v):
    rows = P.env_rows(F.col("metadata"))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["name"], F.lit("="), r["value"])), ";")
    return v.payloads().where(F.col("metadata").isNotNull()).select(F.col("id").alias("job_id"), text.alias("env"))


_EFFECTIVE = f"""SELECT job_id, image, nullif(coalesce(least(nullif(cpu_limit, 0), 3), 0), 0) AS cpu,
  nullif(coalesce(least(nullif(cpu_limit, 0), 3), 0), 0) * 1000000000 AS nano_cpus,
  nullif(coalesce(least(nullif({Q.mem_bytes('memory_limit')}, 0), 1073741824), 0), 0) AS memory_bytes,
  {Q.mem_bytes('memory_swap')} AS swap_bytes, CASE WHEN pids_limit > 0 THEN pids_limit END AS pids, nullif(network, '') AS network_mode
  FROM step_rows"""


@report("p16_effective_resources", _EFFECTIVE, "step_rows")
def _(v):
    report_ = E.resource_report(v.step_rows(), 3, "1G")
    return report_.select("job_id", "image", "cpu", "nano_cpus", "memory_bytes", "swap_bytes", "pids", "network_mode")


@report(
    "p16_resource_totals",
    f"""SELECT image, count(*) AS steps, sum(cpu)::BIGINT AS cpu, sum(memory_bytes)::BIGINT AS memory_bytes, max(pids) AS max_pids
        FROM ({_EFFECTIVE}) GROUP BY image""",
    "step_rows",
)
def _(v):
    return E.resource_totals(E.resource_report(v.step_rows(), 3, "1G"), "image")


@report(
    "p17_effective_requests",
    """SELECT image, cpu_request, memory_request, count(*) AS n FROM (
         SELECT image, CASE WHEN pids_limit < 2 AND pids_limit <> 0 THEN cpu_limit WHEN pids_limit = 0 THEN 7 END AS cpu_request,
           CASE WHEN pids_limit < 2 AND pids_limit <> 0 THEN memory_limit WHEN pids_limit >= 2 THEN '9M' END AS memory_request FROM step_rows)
       GROUP BY ALL""",
    "step_rows",
)
def _(v):
    pids = F.col("pids_limit")
    asked_cpu = F.when(pids == 0, F.lit(7).cast("bigint"))
    asked_memory = F.when(pids >= 2, F.lit("9M"))
    req = P.effective_requests(F.col("cpu_limit"), F.col("memory_limit"), asked_cpu, asked_memory)
    rows = v.step_rows().select("image", *[c.alias(n) for n, c in req.items()])
    return rows.groupBy("image", "cpu_request", "memory_request").agg(F.count(F.lit(1)).alias("n"))


@report(
    "p26_failure_reason",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('job timed out after ', event_id % 700 + 1, ' seconds')
         WHEN length(t) > 500 THEN concat(left(t, 500), '…') ELSE t END AS reason
       FROM (SELECT event_id, concat('pull failed: https://u:••••••@h/ ', repeat('ä ', CAST(event_id % 400 AS INTEGER))) AS t FROM events)""",
)
def _(v):
    e = F.col("event_id")
    error = F.concat(F.lit("pull failed: https://u:p"), e.cast("string"), F.lit("@h/ "), F.repeat(F.lit("ä "), (e % 400).cast("int")))
    reason = R.failure_reason(error, e % 4 == 0, e % 700 + 1, S.MAX_REASON_CHARS)
    return v.events().select("event_id", reason.alias("reason"))


@report("p27_truncate_ids", "SELECT DISTINCT left(md5(job_id), 8) AS short, left(md5(job_id), 12) AS longer FROM status_events", "status_events")
def _(v):
    h = F.md5(F.col("job_id"))
    return v.status_events().select(P.truncate_id(h).alias("short"), P.truncate_id(h, 12).alias("longer")).distinct()


_HEX = "md5(CAST(o_orderkey AS VARCHAR))"
_DASHED = f"concat(left({_HEX}, 8), '-', substr({_HEX}, 9, 4), '-', substr({_HEX}, 13, 4), '-', substr({_HEX}, 17, 4), '-', right({_HEX}, 12))"


def _raw_id(key):
    h = F.md5(key.cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    dash = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    form = (
        F.when(key % 6 == 0, F.upper(dash))
        .when(key % 6 == 1, F.concat(F.lit("{"), dash, F.lit("}")))
        .when(key % 6 == 2, F.concat(F.lit("URN:uuid:"), dash))
        .when(key % 6 == 3, h)
        .when(key % 6 == 4, F.concat(dash, F.lit("0")))
        .otherwise(F.translate(dash, "a", "g"))
    )
    return form, dash


@report(
    "p28_canonical_ids",
    f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN contains({_HEX}, 'a') THEN NULL ELSE {_DASHED} END ELSE {_DASHED} END AS job_id FROM orders",
)
def _(v):
    raw, _dash = _raw_id(F.col("o_orderkey"))
    return v.table("orders").select("o_orderkey", P.canonical_job_id(raw).alias("job_id"))


@report(
    "p29_container_states",
    """SELECT CASE raw_state WHEN 'waiting' THEN 'Pending' WHEN 'running' THEN 'Running' ELSE
         CASE WHEN pids_limit > 3 THEN 'Unknown' WHEN exit_code = 0 THEN 'Succeeded' ELSE 'Failed' END END AS state, count(*) AS n
       FROM step_rows GROUP BY 1""",
    "step_rows",
)
def _(v):
    raw = F.col("raw_state")
    state = P.container_state(raw == "waiting", raw == "running", F.when(F.col("pids_limit") <= 3, F.col("exit_code")))
    return v.step_rows().groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@report("p30_label_priority", "SELECT job_id, CAST(own AS BIGINT) AS priority FROM executions", "executions")
def _(v):
    return v.executions().select("job_id", P.label_priority(F.col("labels")).alias("priority"))


@report(
    "p31_clamp_timeouts",
    """SELECT job_id, CASE WHEN timeout_seconds > 0 THEN least(timeout_seconds * CASE WHEN seq % 2 = 0 THEN 1 ELSE 10000000000 END, 9223372036) END AS seconds FROM jobs""",
    "jobs",
)
def _(v):
    t = F.col("timeout_seconds") * F.when(F.col("seq") % 2 == 0, F.lit(1)).otherwise(F.lit(10_000_000_000))
    return v.jobs().select("job_id", P.clamp_timeout(t).alias("seconds"))


_JOB_ERRORS = f"""step_errors AS (SELECT job_id, arg_min(e, id) AS step_error FROM (SELECT job_id, id, {Q.step_error()} AS e FROM payload_steps)
    WHERE e IS NOT NULL GROUP BY job_id),
  verdicts AS (SELECT p.id AS job_id, {Q.job_error('step_error')} AS error,
    CASE WHEN coalesce(priority, 3) >= 3 THEN 'high' WHEN coalesce(priority, 3) <= 1 THEN 'low' ELSE 'medium' END AS queue
    FROM payloads p LEFT JOIN step_errors s ON s.job_id = p.id)"""


@report("p32_admission_report", f"WITH {_JOB_ERRORS} SELECT job_id, error, queue FROM verdicts", "payloads", "payload_steps")
def _(v):
    return A.admission_report(v.payloads()).select(F.col("id").alias("job_id"), "error", "queue")


@report(
    "p32_admission_errors",
    f"WITH {_JOB_ERRORS} SELECT coalesce(error, '') AS error, count(*) AS n FROM verdicts GROUP BY 1",
    "payloads",
    "payload_steps",
)
def _(v):
    return A.error_counts(A.admission_report(v.payloads()))


@report(
    "p32_admission_flat",
    f"""WITH e AS (SELECT job_id, step_id, {Q.step_error()} AS e FROM steps),
          s AS (SELECT job_id, arg_min(e, step_id) AS step_error FROM e WHERE e IS NOT NULL GROUP BY job_id)
        SELECT j.job_id, {Q.job_error('step_error')} AS error FROM jobs j LEFT JOIN s ON s.job_id = j.job_id""",
    "jobs",
    "steps",
)
def _(v):
    return A.admission_report_flat(v.jobs(), v.steps().withColumnRenamed("step_id", "pos"))


@report(
    "p33_job_specs",
    """SELECT p.id AS name, 'build' AS namespace, CASE WHEN timeout_seconds > 0 THEN timeout_seconds END AS timeout,
         s.image AS image2, CASE WHEN s.cpu_limit > 0 THEN CAST(s.cpu_limit AS VARCHAR) END AS cpu2, nullif(s.memory_limit, '') AS memory2,
         nullif(s.memory_swap, '') AS swap2, s.continue_on_error AS continue2, nullif(s.script, '') AS script2,
         CASE WHEN o_orderkey % 13 <> 0 THEN concat('b', o_custkey % 3) END AS label
       FROM payloads p JOIN payload_steps s ON s.job_id = p.id AND s.id = 2""",
    "payloads",
    "payload_steps",
)
def _(v):
    specs = E.job_spec_rows(v.payloads(), "build", priority_key="BRANCH")
    get = lambda path: F.get_json_object("spec", path)
    return specs.select(
        "name",
        "namespace",
        get("$.timeoutSeconds").cast("bigint").alias("timeout"),
        get("$.steps[1].image").alias("image2"),
        get("$.steps[1].cpuLimit").alias("cpu2"),
        get("$.steps[1].memoryLimit").alias("memory2"),
        get("$.steps[1].memorySwap").alias("swap2"),
        get("$.steps[1].continueOnError").cast("boolean").alias("continue2"),
        get("$.steps[1].script").alias("script2"),
        F.try_element_at("labels", F.lit("BRANCH")).alias("label"),
    )


@report(
    "p34_priority_metadata",
    """SELECT id AS job_id, CASE WHEN priority >= 3 THEN 'high' WHEN priority <= 1 THEN 'low' ELSE 'medium' END AS name,
         CASE WHEN priority >= 3 THEN '3' WHEN priority <= 1 THEN '1' ELSE '2' END AS branch, CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 5 END AS entries
       FROM (SELECT * REPLACE (coalesce(priority, 3) AS priority) FROM payloads)""",
    "payloads",
)
def _(v):
    m = P.priority_metadata(F.col("metadata"), F.coalesce("priority", F.lit(3)), key="BRANCH")
    get = lambda key: F.try_element_at("m", F.lit(key))
    return v.payloads().withColumn("m", m).select(
        F.col("id").alias("job_id"), get("priorityName").alias("name"), get("BRANCH").alias("branch"), F.size("m").alias("entries")
    )


@report(
    "s01_decode_jobs",
    """SELECT id, name, coalesce(priority, 3) AS priority, epoch_us(timestamp) AS timestamp, callback_url, timeout_seconds, 2 AS steps,
         concat('img-', o_orderkey % 20) AS image2 FROM payloads WHERE o_orderkey % 10 <> 0""",
    "payloads",
)
def _(v):
    jobs = v.payloads()
    text = F.to_json(F.struct("id", "name", "timestamp", "metadata", "steps", "callback_url", "timeout_seconds", "priority"))
    broken = F.when(F.col("id").endswith("0"), F.substring(text, 1, 20)).otherwise(text)
    decoded = T.decode_jobs(jobs.select(broken.alias("value")))
    good = decoded.where(~F.col("corrupt"))
    return good.select(
        "id", "name", "priority", "timestamp", "callback_url", "timeout_seconds", F.size("steps").alias("steps"), F.col("steps")[1]["image"].alias("image2")
    )


@report(
    "s09_split_rejects",
    f"""SELECT o_orderkey AS seq, CASE WHEN bad THEN 'bad_id' WHEN o_custkey % 5 = 0 THEN 'missing_payload' WHEN o_custkey % 5 = 1 THEN 'bad_payload' END AS reject
        FROM (SELECT *, o_orderkey % 6 = 4 OR (o_orderkey % 6 = 5 AND contains({_HEX}, 'a')) AS bad FROM orders)""",
)
def _(v):
    orders = v.table("orders")
    raw, dash = _raw_id(F.col("o_orderkey"))
    queue = orders.select(F.col("o_orderkey").alias("seq"), raw.alias("raw_id"))
    body = F.when(F.col("o_custkey") % 5 == 1, F.lit('{"id": 12')).otherwise(F.to_json(F.struct(dash.alias("id"), F.lit("n").alias("name"))))
    payloads = orders.where(F.col("o_custkey") % 5 != 0).select(dash.alias("job_id"), body.alias("value"))
    return A.classify_queue(queue, payloads).select("seq", "reject")


@report(
    "j03_resolve_queue",
    """SELECT q.queue, q.priority, j.job_id IS NOT NULL AS resolved, count(*) AS n FROM queue q
       LEFT JOIN (SELECT job_id FROM jobs WHERE seq % 3 <> 0) j ON j.job_id = q.job_id GROUP BY ALL""",
    "queue",
    "jobs",
)
def _(v):
    known = v.jobs().where(F.col("seq") % 3 != 0).select("job_id", "name")
    found, missing = A.resolve_queue(v.queue(), known)
    tag = lambda df, flag: df.select("queue", "priority", F.lit(flag).alias("resolved"))
    return tag(found, True).unionByName(tag(missing, False)).groupBy("queue", "priority", "resolved").agg(F.count(F.lit(1)).alias("n"))
