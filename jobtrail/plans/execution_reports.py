"""Reports on steps, containers and admission to execution."""

from pyspark.sql import functions as F

from jobtrail.operators import execution as E
from jobtrail.operators import lifecycle as L
from jobtrail.plans.registry import AS_OF, report


@report(
    "f06_match_labels",
    "SELECT namespace, count(*) AS n FROM executions WHERE o_orderpriority = '2-HIGH' GROUP BY namespace",
    "executions",
)
def _(v):
    return L.match_labels(v.executions(), {"priority": "3"}).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@report(
    "j04_drain_status",
    """SELECT c.job_id, count(*) FILTER (done AND NOT coalesce(p.logs_published, false)) = 0 AS drained,
         count(*) FILTER (done AND NOT coalesce(p.logs_published, false)) AS pending
       FROM (SELECT *, state IN ('Succeeded', 'Failed') AS done FROM containers) c
       LEFT JOIN (SELECT * FROM containers WHERE step_id % 5 <> 0) p ON p.job_id = c.job_id AND p.name = c.name GROUP BY c.job_id""",
    "containers",
)
def _(v):
    c = v.containers()
    return E.drain_status(c, c.where(F.col("step_id") % 5 != 0).select("job_id", "name", "logs_published"))


@report("j07_explode_steps", "SELECT job_id, CAST(id - 1 AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, name, image FROM payload_steps", "payload_steps")
def _(v):
    return E.explode_steps(v.payloads()).select("job_id", "pos", "id", "name", "image")


@report("j08_resolve_priority", "SELECT job_id, namespace, CAST(priority AS BIGINT) AS priority FROM prioritized", "prioritized")
def _(v):
    return E.resolve_priority(v.executions(), v.parents()).select("job_id", "namespace", "priority")


@report(
    "j09_merge_container_states",
    """SELECT c.job_id, c.name, CAST(CASE WHEN step_id % 4 = 0 THEN 0 ELSE step_id END AS BIGINT) AS step_id,
         CASE WHEN step_id % 3 = 0 OR step_id % 4 = 0 THEN state ELSE 'Pending' END AS state, logs_published AND step_id % 4 <> 0 AS logs_published FROM containers c""",
    "containers",
)
def _(v):
    c = v.containers()
    known = c.where(F.col("step_id") % 4 != 0).select("job_id", "name", "step_id", F.lit("Pending").alias("state"), "logs_published")
    seen = c.where((F.col("step_id") % 3 == 0) | (F.col("step_id") % 4 == 0)).select("job_id", "name", "state", F.col("step_id").alias("seq"))
    return E.merge_container_states(known, seen)


@report(
    "u03_all_containers",
    "SELECT is_app, state, count(*) AS n FROM containers GROUP BY ALL",
    "containers",
)
def _(v):
    c = v.containers()
    rows = E.all_containers(c.where(~F.col("is_app")).drop("is_app"), c.where(F.col("is_app")).drop("is_app"))
    return rows.groupBy("is_app", "state").agg(F.count(F.lit(1)).alias("n"))


@report(
    "a11_active_executions",
    "SELECT namespace, count(*) AS active FROM executions WHERE NOT finished AND NOT suspended GROUP BY namespace",
    "executions",
)
def _(v):
    return E.active_executions(v.executions())


@report(
    "a13_current_step",
    """SELECT job_id, CAST(CASE WHEN count(*) FILTER (NOT is_app) = 0 THEN 1
         ELSE coalesce(min(idx) FILTER (NOT is_app AND raw_state IN ('running', 'waiting')), count(*)) + 1 END AS BIGINT) AS current_step
       FROM containers GROUP BY job_id""",
    "containers",
)
def _(v):
    c = v.containers()
    return E.current_step(c, c)


_STUCK = """SELECT job_id, arg_min(concat(waiting_reason, ' (', CASE WHEN is_app THEN 'container' ELSE 'step' END, ' ', CAST(idx + 1 AS VARCHAR), '): ', image),
    row(is_app, idx)) AS reason, arg_min(waiting_reason, row(is_app, idx)) AS waiting_reason, arg_min(image, row(is_app, idx)) AS image
  FROM containers WHERE waiting_reason IN ('ImagePullBackOff', 'CrashLoopBackOff') GROUP BY job_id"""


@report("a14_stuck_report", _STUCK, "containers")
def _(v):
    return E.stuck_report(v.containers())


@report("a14_stuck_counts", f"SELECT waiting_reason, image, count(*) AS jobs FROM ({_STUCK}) GROUP BY ALL", "containers")
def _(v):
    return E.stuck_counts(E.stuck_report(v.containers()))


@report(
    "a15_condition_outcome",
    """SELECT job_id, o_orderstatus = 'F' AS done, o_orderstatus = 'F' AND o_custkey % 2 = 0 AS succeeded,
         CASE WHEN o_orderstatus <> 'F' THEN '' WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'bad' END AS message FROM executions""",
    "executions",
)
def _(v):
    return E.condition_outcome(v.executions())


@report(
    "a16_completion_time",
    f"""SELECT job_id, epoch_us(CASE WHEN o_orderkey % 4 = 0 THEN created_at + INTERVAL 2 HOUR WHEN o_orderstatus = 'F' THEN created_at + INTERVAL 3 HOUR
         ELSE {AS_OF} END) AS completed_at FROM executions""",
    "executions",
)
def _(v):
    return E.completion_time(v.executions(), v.as_of)


@report(
    "a17_outcome_report",
    """WITH f AS (SELECT *, exit_code <> 0 AS failed FROM steps),
       x AS (SELECT job_id, min(step_id) FILTER (failed AND NOT continue_on_error) AS fatal, arg_min(exit_code, step_id) FILTER (failed AND NOT continue_on_error) AS code FROM f GROUP BY job_id)
       SELECT f.job_id, CASE WHEN fatal IS NULL THEN 'Succeeded' ELSE 'Failed' END AS outcome, CAST(fatal AS BIGINT) AS failed_step, CAST(code AS BIGINT) AS exit_code,
         count(*) FILTER (failed AND continue_on_error AND (fatal IS NULL OR step_id < fatal)) AS tolerated, count(*) FILTER (step_id > fatal) AS skipped,
         CASE WHEN fatal IS NULL THEN '' ELSE concat('container exited with status ', CAST(code AS VARCHAR)) END AS reason
       FROM f JOIN x ON x.job_id = f.job_id GROUP BY f.job_id, fatal, code""",
    "steps",
)
def _(v):
    return E.outcome_report(v.steps())


@report(
    "a18_draining",
    "SELECT job_id, bool_or(state IN ('Succeeded', 'Failed') AND NOT logs_published) AS draining FROM containers GROUP BY job_id",
    "containers",
)
def _(v):
    return E.draining(v.containers())


@report(
    "a19_expected_containers",
    """SELECT job_id, concat('step-', CAST(step_id AS VARCHAR)) AS name, CAST(step_id AS BIGINT) AS step_id, 'Pending' AS state, false AS logs_published FROM steps
       UNION ALL SELECT DISTINCT job_id, 'buildjob-finalizer', 0, 'Pending', false FROM steps""",
    "steps",
)
def _(v):
    return E.expected_containers(v.steps())


@report("w08_dispatch_order", "SELECT job_id, queue, priority, row_number() OVER (PARTITION BY queue ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, seq) AS position FROM queue", "queue")
def _(v):
    return E.dispatch_order(v.queue(), ["queue"]).select("job_id", "queue", "priority", "position")


@report("w08_dispatch_order_global", "SELECT job_id, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, seq) AS position FROM queue", "queue")
def _(v):
    return E.dispatch_order(v.queue(), block=5000).select("job_id", "position")


@report(
    "w08_dispatch_report",
    """SELECT priority, count(*) AS jobs, count(w) AS dispatched, CAST(trunc(CAST(sum(w) AS DOUBLE) / count(w)) AS BIGINT) AS avg_wait_ms, max(w) AS max_wait_ms
       FROM (SELECT priority, CAST(trunc((epoch_us(dispatched_at) - epoch_us(enqueued_at)) / 1000) AS BIGINT) AS w FROM queue) GROUP BY priority""",
    "queue",
)
def _(v):
    return E.dispatch_report(v.queue())


_NEXT = """SELECT namespace, arg_min(job_id, row(-priority, created_at, job_id)) AS job_id,
  CAST(max(priority) AS BIGINT) AS priority FROM prioritized WHERE suspended AND NOT finished GROUP BY namespace"""


@report("w09_next_to_admit", _NEXT, "prioritized")
def _(v):
    return E.next_to_admit(E.resolve_priority(v.executions(), v.parents()))


@report(
    "w09_capacity_report",
    f"""SELECT coalesce(a.namespace, n.namespace) AS namespace, coalesce(active, 0) AS active, job_id, priority FROM
        (SELECT namespace, count(*) AS active FROM executions WHERE NOT finished AND NOT suspended GROUP BY namespace) a
        FULL OUTER JOIN ({_NEXT}) n ON a.namespace = n.namespace""",
    "prioritized",
)
def _(v):
    return E.capacity_report(E.resolve_priority(v.executions(), v.parents()))


@report(
    "r09_timeouts",
    f"""SELECT s.job_id, 'Failed' AS status, concat('job timed out after ', CAST(timeout_seconds AS VARCHAR), ' seconds') AS reason,
         epoch_us(started_at) + timeout_seconds * 1000000 AS deadline
       FROM order_summary s JOIN jobs j ON j.job_id = s.job_id
       WHERE started_at IS NOT NULL AND finished_at IS NULL AND timeout_seconds > 0 AND started_at + to_seconds(timeout_seconds) < {AS_OF}""",
    "order_summary",
    "jobs",
)
def _(v):
    return E.timeouts(L.lifecycle(v.status_events("order")), v.jobs(), v.as_of)


