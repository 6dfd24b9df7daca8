"""Submission checks: the first error of a job, rejects, and counts per error."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import schemas as S
from jobtrail.functions import scalars as P


# The error texts of the checks below are what submitters are shown.


def step_error(step) -> Column:
    """First error of one step, or NULL. ``step`` offers the step fields by name."""
    limit, swap = F.coalesce(step["memory_limit"], F.lit("")), F.coalesce(step["memory_swap"], F.lit(""))
    return (
        F.when((limit != "") & P.memory_limit_error(limit).isNotNull(), "Failed to parse RAM limit")
        .when((swap != "") & P.memory_limit_error(swap).isNotNull(), "Failed to parse memory_swap limit")
        .when((swap != "") & (limit == ""), "memory_swap requires memory_limit to be set")
        .when(
            (swap != "") & (P.memory_limit_bytes(swap) < P.memory_limit_bytes(limit)),
            "memory_swap must be greater than or equal to memory_limit",
        )
        .when(step["pids_limit"] < 0, "pids_limit cannot be negative")
        .otherwise(P.network_mode_error(step["network"]))
    )


def head_error(job) -> Column:
    """Errors found before the steps are looked at."""
    timeout = F.coalesce(job["timeout_seconds"], F.lit(0))
    return (
        F.when(F.coalesce(job["name"], F.lit("")) == "", 'Invalid request payload: "Name" is required')
        .when(timeout < 0, "timeout_seconds cannot be negative")
        .when(timeout > S.MAX_TIMEOUT_SECONDS, F.lit(f"timeout_seconds must not exceed {S.MAX_TIMEOUT_SECONDS}"))
    )


def tail_error(job) -> Column:
    """Errors found after the steps."""
    url = F.coalesce(job["callback_url"], F.lit(""))
    return F.when(url != "", F.concat(F.lit("Invalid callback_url: "), P.callback_url_error(url)))


def validate_job(job) -> Column:
    """First error of a nested job row, or NULL when it is admitted."""
    errors = F.filter(F.transform(job["steps"], step_error), lambda e: e.isNotNull())
    return F.coalesce(head_error(job), F.try_element_at(errors, F.lit(1)), tail_error(job))


def admission_report(jobs: DataFrame) -> DataFrame:
    """Nested jobs plus ``error`` (NULL = admitted) and the queue they go to. Narrow."""
    columns = {c: F.col(c) for c in ("name", "timeout_seconds", "callback_url", "steps")}
    priority = F.coalesce(F.col("priority"), F.lit(S.DEFAULT_PRIORITY))
    return jobs.withColumns({"error": validate_job(columns), "queue": P.priority_bucket(priority)})


def admission_report_flat(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """The same verdict where steps are their own table (job_id, pos, step columns): job_id, error.

    Errors are found row by row; only a job's first one travels, and it combines before the shuffle.
    """
    found = steps.select("job_id", "pos", step_error({c: F.col(c) for c in S.STEP.names[6:]}).alias("e"))
    first = found.where(F.col("e").isNotNull()).groupBy("job_id").agg(F.min(F.struct("pos", "e"))["e"].alias("_step"))
    job = {c: F.col(c) for c in ("name", "timeout_seconds", "callback_url")}
    error = F.coalesce(head_error(job), F.col("_step"), tail_error(job))
    return jobs.join(first, "job_id", "left").select("job_id", error.alias("error"))


def error_counts(report: DataFrame) -> DataFrame:
    return report.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def split_admitted(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    return report.where(F.col("error").isNull()), report.where(F.col("error").isNotNull())


# --- queue resolution ----------------------------------------------------------------------


def resolve_queue(queue: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue rows with their payload, and those whose payload is missing."""
    return queue.join(jobs, "job_id", "inner"), queue.join(jobs.select("job_id"), "job_id", "left_anti")


def classify_queue(queue: DataFrame, payloads: DataFrame) -> DataFrame:
    """Queue rows (raw_id) with their payload text (job_id, value) and a reject class, NULL when fine.

    An unreadable id, a missing payload and an undecodable payload are final; a row whose ``lookup_failed``
    flag is set could not be looked up and is retried.
    """
    keyed = queue.withColumn("job_id", P.canonical_job_id(F.col("raw_id")))
    # Unreadable ids are all NULL, which would be one key in the join; spread by their text they match nothing either.
    spread = F.coalesce("job_id", F.concat(F.lit("~"), F.xxhash64("raw_id").cast("string")))
    named = payloads.withColumnRenamed("job_id", "_payload_id")
    joined = keyed.withColumn("_key", spread).join(named, F.col("_key") == F.col("_payload_id"), "left").drop("_key", "_payload_id")
    decoded = F.from_json("value", S.JOB, {"mode": "PERMISSIVE"})
    transient = F.col("lookup_failed") if "lookup_failed" in queue.columns else F.lit(False)
    rows = joined.withColumn("job", decoded)
    return rows.withColumn(
        "reject",
        F.when(F.col("job_id").isNull(), "bad_id")
        .when(transient, "retry")
        .when(F.col("value").isNull(), "missing_payload")
        .when(undecodable(F.col("value"), F.col("job")), "bad_payload"),
    )


def undecodable(value: Column, decoded: Column) -> Column:
    """A text that is no JSON object of the wanted shape decodes to NULL or to nothing but NULLs."""
    fields = F.json_object_keys(value)
    return value.isNotNull() & (decoded.isNull() | fields.isNull())


def split_rejects(queue: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = classify_queue(queue, payloads)
    return rows.where(F.col("reject").isNull()), rows.where(F.col("reject").isNotNull())
