"""Step, container and executor state: outcomes, drain gates, admission order, resources."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import schemas as S
from jobtrail.functions import scalars as P
from jobtrail.operators import ordered


def explode_steps(jobs: DataFrame) -> DataFrame:
    """One row per step with its 0-based position; a job without steps keeps one row of NULLs."""
    rows = jobs.select(F.col("id").alias("job_id"), F.posexplode_outer("steps").alias("pos", "step"))
    return rows.select("job_id", "pos", "step.*")


# --- containers ----------------------------------------------------------------------------


def all_containers(init: DataFrame, app: DataFrame) -> DataFrame:
    return init.withColumn("is_app", F.lit(False)).unionByName(app.withColumn("is_app", F.lit(True)))


def terminated(state: Column) -> Column:
    return state.isin("Succeeded", "Failed")


def drain_status(containers: DataFrame, published: DataFrame) -> DataFrame:
    """Per job: are the logs of every terminated container published, and how many are not."""
    flags = published.groupBy("job_id", "name").agg(F.bool_or("logs_published").alias("_published"))
    joined = containers.join(flags, ["job_id", "name"], "left")
    open_end = terminated(F.col("state")) & ~F.coalesce("_published", F.lit(False))
    return joined.groupBy("job_id").agg(
        (~F.bool_or(F.coalesce(open_end, F.lit(False)))).alias("drained"), F.count(F.when(open_end, True)).alias("pending")
    )


def draining(containers: DataFrame) -> DataFrame:
    open_end = terminated(F.col("state")) & ~F.col("logs_published")
    return containers.groupBy("job_id").agg(F.bool_or(F.coalesce(open_end, F.lit(False))).alias("draining"))


def merge_container_states(current: DataFrame, observed: DataFrame) -> DataFrame:
    """Lay observed states over the known rows by name; unknown names join with step id 0."""
    seen = observed.groupBy("job_id", "name").agg(F.max_by("state", "seq").alias("_state"))
    return current.join(seen, ["job_id", "name"], "full_outer").select(
        "job_id",
        "name",
        F.coalesce("step_id", F.lit(0)).alias("step_id"),
        F.coalesce("_state", "state").alias("state"),
        F.coalesce("logs_published", F.lit(False)).alias("logs_published"),
    )


def expected_containers(steps: DataFrame, finalizer: str = "buildjob-finalizer") -> DataFrame:
    """The rows a new job starts with: one pending container per step and one finalizer."""
    # The names of step containers and of the finalizer.
    fresh = [F.lit("Pending").alias("state"), F.lit(False).alias("logs_published")]
    per_step = steps.select(
        "job_id", F.concat(F.lit("step-"), F.col("step_id").cast("string")).alias("name"), "step_id", *fresh
    )
    last = steps.select("job_id").distinct().select("job_id", F.lit(finalizer).alias("name"), F.lit(0).alias("step_id"), *fresh)
    return per_step.unionByName(last)


def current_step(containers: DataFrame, steps: DataFrame) -> DataFrame:
    """First running or waiting step container (1-based); past the last step when none is left; 1 before any."""
    # "raw_state" of init containers, "idx" 0-based.
    busy = F.col("raw_state").isin("running", "waiting")
    first = containers.where(~F.col("is_app")).groupBy("job_id").agg(F.min(F.when(busy, F.col("idx"))).alias("_busy"), F.lit(True).alias("_any"))
    totals = steps.groupBy("job_id").agg(F.count(F.lit(1)).alias("_steps"))
    step = F.when(F.col("_any").isNull(), F.lit(1)).otherwise(F.coalesce(F.col("_busy"), F.col("_steps")) + 1)
    return totals.join(first, "job_id", "left").select("job_id", step.cast("bigint").alias("current_step"))


def stuck_report(containers: DataFrame) -> DataFrame:
    """Jobs with a container wedged in a waiting state that will not clear, and why."""
    # "idx" is 0-based within the init or app list.
    label = F.when(F.col("is_app"), "container").otherwise("step")
    text = F.concat(
        F.col("waiting_reason"), F.lit(" ("), label, F.lit(" "), (F.col("idx") + 1).cast("string"), F.lit("): "), F.col("image")
    )
    stuck = containers.where(F.col("waiting_reason").isin(S.STUCK_REASONS))
    first = F.min(F.struct("is_app", "idx", "waiting_reason", "image", text.alias("reason"))).alias("f")
    return stuck.groupBy("job_id").agg(first).select("job_id", "f.reason", "f.waiting_reason", "f.image")


def stuck_counts(stuck: DataFrame) -> DataFrame:
    return stuck.groupBy("waiting_reason", "image").agg(F.count(F.lit(1)).alias("jobs"))


# --- executor records ----------------------------------------------------------------------


def _deciding(conditions: Column) -> Column:
    return F.filter(conditions, lambda c: c["type"].isin("Complete", "Failed") & (c["status"] == "True"))


def condition_outcome(executions: DataFrame) -> DataFrame:
    """The first true Complete or Failed condition decides."""
    c = F.try_element_at(_deciding(F.col("conditions")), F.lit(1))
    return executions.select(
        "job_id",
        c.isNotNull().alias("done"),
        F.coalesce(c["type"] == "Complete", F.lit(False)).alias("succeeded"),
        F.coalesce(c["message"], F.lit("")).alias("message"),
    )


def completion_time(executions: DataFrame, as_of: Column) -> DataFrame:
    latest = F.array_max(F.transform(_deciding(F.col("conditions")), lambda c: c["transition_at"]))
    return executions.select("job_id", F.coalesce(F.col("completed_at"), latest, as_of).alias("completed_at"))


def active_executions(executions: DataFrame) -> DataFrame:
    active = ~F.col("finished") & ~F.coalesce("suspended", F.lit(False))
    return executions.where(active).groupBy("namespace").agg(F.count(F.lit(1)).alias("active"))


def resolve_priority(executions: DataFrame, parents: DataFrame, default: int = 1) -> DataFrame:
    """An execution's own label priority; where that is the default, its parent's; else 1."""
    own = executions.withColumn("_own", P.label_priority(F.col("labels"), default=default))
    up = parents.select(
        F.col("namespace").alias("_ns"), F.col("name").alias("_name"), P.label_priority(F.col("labels"), default=default).alias("_up")
    )
    joined = own.join(up, (F.col("namespace") == F.col("_ns")) & (F.col("parent") == F.col("_name")), "left")
    priority = F.when(F.col("_own") != default, F.col("_own")).otherwise(F.coalesce("_up", F.lit(1)))
    return joined.select(*executions.columns, priority.cast("bigint").alias("priority"))


def next_to_admit(executions: DataFrame) -> DataFrame:
    """Per namespace the suspended, unfinished execution of highest priority, oldest first.

    Input carries ``priority`` (see ``resolve_priority``). A minimum over a struct combines before the shuffle.
    """
    waiting = executions.where(F.col("suspended") & ~F.col("finished"))
    first = F.min(F.struct((-F.col("priority")).alias("_rank"), "created_at", "job_id", "priority")).alias("f")
    return waiting.groupBy("namespace").agg(first).select("namespace", "f.job_id", "f.priority")


def capacity_report(executions: DataFrame) -> DataFrame:
    """Active executions and the next one to admit, per namespace."""
    return active_executions(executions).join(next_to_admit(executions), "namespace", "full_outer").select(
        "namespace", F.coalesce("active", F.lit(0)).cast("bigint").alias("active"), "job_id", "priority"
    )


def dispatch_order(queue: DataFrame, keys: list[str] | None = None, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """Consumption order: strict priority, first come first served inside it. Positions from 1 per ``keys``."""
    rank = -P.priority_rank(F.col("priority"))
    return ordered.numbered(queue, keys or [], [rank, "seq"], [rank, ordered.seq_block("seq", block)], "position")


def dispatch_report(queue: DataFrame) -> DataFrame:
    """Jobs and wait per priority; the queue carries enqueued_at and dispatched_at."""
    wait = P.millis_between(F.col("enqueued_at"), F.col("dispatched_at"))
    return queue.groupBy("priority").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count(wait).alias("dispatched"),
        F.call_function("div", F.sum(wait), F.nullif(F.count(wait), F.lit(0))).alias("avg_wait_ms"),
        F.max(wait).alias("max_wait_ms"),
    )


# --- steps ---------------------------------------------------------------------------------


def outcome_report(steps: DataFrame) -> DataFrame:
    """Job outcome from step exit codes (job_id, step_id, exit_code, continue_on_error).

    The first failing step that is not tolerated fails the job and skips the rest.
    """
    failed, tolerant = F.col("exit_code") != 0, F.coalesce("continue_on_error", F.lit(False))
    fatal = F.when(failed & ~tolerant, F.struct("step_id", "exit_code"))
    first = steps.groupBy("job_id").agg(F.min(fatal).alias("_fatal"))
    # The join needs no new shuffle of the first aggregate, and the second aggregate none at all.
    rows = steps.join(first, "job_id")
    step, at = F.col("step_id"), F.col("_fatal.step_id")
    counts = rows.groupBy("job_id").agg(
        F.first("_fatal").alias("_fatal"),
        F.count(F.when(failed & tolerant & (at.isNull() | (step < at)), True)).alias("tolerated"),
        F.count(F.when(step > at, True)).alias("skipped"),
    )
    code = F.col("_fatal.exit_code")
    return counts.select(
        "job_id",
        F.when(F.col("_fatal").isNull(), "Succeeded").otherwise("Failed").alias("outcome"),
        F.col("_fatal.step_id").alias("failed_step"),
        code.alias("exit_code"),
        "tolerated",
        "skipped",
        F.coalesce(F.concat(F.lit("container exited with status "), code.cast("string")), F.lit("")).alias("reason"),
    )


def resource_report(steps: DataFrame, cpu_default: int = 0, memory_default: str = "") -> DataFrame:
    """Effective limits per step. Narrow."""
    row = {c: F.col(c) for c in ("cpu_limit", "memory_limit", "memory_swap", "pids_limit", "network")}
    limits = P.effective_resources(row, cpu_default, memory_default)
    return steps.select(*[c for c in steps.columns if c not in row], *[c.alias(name) for name, c in limits.items()])


def resource_totals(report: DataFrame, by: str) -> DataFrame:
    return report.groupBy(by).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("cpu").alias("cpu"),
        F.sum("memory_bytes").alias("memory_bytes"),
        F.max("pids").alias("max_pids"),
    )


def env_report(jobs: DataFrame, script_key: str | None = None) -> DataFrame:
    """One row per (job, step, variable) with its final value and where it comes from."""
    steps = jobs.select(F.col("id").alias("job_id"), "name", "metadata", F.explode("steps").alias("step"))
    reserved = P.reserved_env(F.col("job_id"), F.col("name"), F.col("step"), script_key)
    # Each value carries its source and the rank of its source, so overlaying them is the last one by rank per key.
    layers = (("job", F.col("metadata")), ("step", F.col("step.metadata")), ("reserved", reserved))
    told = lambda rank, source, m: F.transform(
        F.map_entries(F.coalesce(m, P.empty_map())),
        lambda e: F.struct(e["key"].alias("key"), F.lit(rank).alias("rank"), e["value"].alias("value"), F.lit(source).alias("source")),
    )
    every = F.array_sort(F.concat(*[told(i, source, m) for i, (source, m) in enumerate(layers)]))
    rows = steps.select("job_id", F.col("step.id").alias("step_id"), every.alias("_all"))
    last = F.filter("_all", lambda e, i: ~F.coalesce(F.get("_all", i + 1)["key"] == e["key"], F.lit(False)))
    return rows.select("job_id", "step_id", F.inline(last)).drop("rank")


def job_spec_rows(jobs: DataFrame, namespace: str, priority_key: str = "priority", labels: dict[str, str] | None = None) -> DataFrame:
    """Project payloads to executor records: labels, and a JSON spec without empty optional fields."""
    filled = lambda c: F.when(c != "", c)
    positive = lambda c: F.when(c > 0, c)
    step = lambda s: F.struct(
        s["id"].alias("id"),
        s["name"].alias("name"),
        s["image"].alias("image"),
        F.coalesce(s["continue_on_error"], F.lit(False)).alias("continueOnError"),
        filled(s["script"]).alias("script"),
        F.when(F.size(s["metadata"]) > 0, s["metadata"]).alias("metadata"),
        positive(s["cpu_limit"]).cast("string").alias("cpuLimit"),
        filled(s["memory_limit"]).alias("memoryLimit"),
        filled(s["network"]).alias("network"),
        filled(s["memory_swap"]).alias("memorySwap"),
        positive(s["pids_limit"]).alias("pidsLimit"),
    )
    spec = F.struct(
        F.col("name").alias("name"),
        F.col("metadata").alias("metadata"),
        F.transform("steps", step).alias("steps"),
        positive(F.col("timeout_seconds")).alias("timeoutSeconds"),
    )
    fixed = F.create_map(F.lit("job-id"), F.col("id"), *[F.lit(x) for kv in (labels or {"source": "scheduler"}).items() for x in kv])
    priority = F.try_element_at(F.col("metadata"), F.lit(priority_key))
    tagged = F.when(F.coalesce(priority, F.lit("")) != "", P.overlay(fixed, F.create_map(F.lit(priority_key), priority))).otherwise(fixed)
    return jobs.select(
        F.col("id").alias("name"), F.lit(namespace).alias("namespace"), tagged.alias("labels"), F.to_json(spec).alias("spec")
    )


def timeouts(summaries: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Started, unfinished jobs past their time limit (seconds; 0 or less = none)."""
    limit = P.clamp_timeout(F.col("timeout_seconds"))
    limits = jobs.where(limit.isNotNull()).select("job_id", "timeout_seconds", limit.alias("_limit"))
    running = summaries.where(F.col("started_at").isNotNull() & F.col("finished_at").isNull()).select("job_id", "started_at")
    # A far limit would leave the range of timestamps, so compare elapsed time, not deadlines.
    elapsed = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    late = running.join(limits, "job_id").where(elapsed > F.col("_limit") * 1_000_000)
    return late.select(
        "job_id",
        F.lit("Failed").alias("status"),
        P.timeout_reason(F.col("timeout_seconds")).alias("reason"),
        F.timestamp_micros(F.unix_micros(F.col("started_at").cast("timestamp")) + F.col("_limit") * 1_000_000).alias("deadline"),
    )
