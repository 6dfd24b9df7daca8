"""Counts, queue depth, durations and throughput over job summaries."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import schemas as S
from jobtrail.functions import scalars as P
from jobtrail.operators import ordered
from jobtrail.operators.lifecycle import seconds


def status_counts(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_counts_filled(summaries: DataFrame) -> DataFrame:
    """All five statuses in display order, zero where no job has one."""
    values = ", ".join(f"({i}L, '{status}')" for i, status in enumerate(S.STATUSES))
    dim = summaries.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(ord, status)")
    filled = dim.join(status_counts(summaries), "status", "left")
    return filled.select("ord", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def pending(queued: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Queue rows whose job has not been dispatched."""
    return queued.join(dispatched.select("job_id"), "job_id", "left_anti")


def queue_depth(queued: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Waiting jobs per priority, zero where none waits; the NULL priority row is the total."""
    counts = pending(queued, dispatched).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    values = ", ".join(f"('{p}')" for p in S.PRIORITIES)
    known = queued.sparkSession.sql(f"SELECT priority, 0L AS n FROM VALUES {values} AS t(priority)")
    return known.unionByName(counts).rollup("priority").agg(F.sum("n").alias("pending"))


def _histogram(summaries: DataFrame, by: Sequence[str], recent: Column) -> DataFrame:
    """Jobs per group, duration and recency. Every figure below is a sum over these rows, and because none
    of them filters before the grouping, Spark runs the fold and this exchange once and reuses them."""
    ms = P.millis_between(F.col("started_at"), F.col("finished_at"))
    rows = summaries.select(*by, ms.alias("_ms"), F.coalesce(recent, F.lit(False)).alias("_recent"))
    hist = rows.groupBy(*by, "_ms", "_recent").agg(F.count(F.lit(1)).alias("_n"))
    return hist.withColumn("_timed", F.when(F.col("_ms").isNotNull(), F.col("_n")).otherwise(F.lit(0)))


def _durations(hist: DataFrame, keys: Sequence[str], width_ms: int) -> DataFrame:
    total = F.sum(F.col("_ms") * F.col("_timed"))
    n = F.sum("_timed")
    means = hist.groupBy(*keys).agg(
        F.coalesce(F.call_function("div", total, F.nullif(n, F.lit(0))), F.lit(0)).alias("avg_ms"),
        F.coalesce(n, F.lit(0)).alias("n"),
    )
    p95 = ordered.nearest_rank(hist, keys, "_ms", 0.95, "p95_ms", width_ms, "_timed")
    out = means.where(F.col("n") > 0).join(p95, list(keys)) if keys else means.withColumn("p95_ms", F.coalesce(p95.scalar(), F.lit(0)))
    return out.select(*keys, "avg_ms", F.col("p95_ms").cast("bigint").alias("p95_ms"), "n")


def duration_summary(summaries: DataFrame, by: Sequence[str] = (), width_ms: int = 60_000) -> DataFrame:
    """Mean (truncated), nearest-rank p95 and count of the durations of jobs that started and finished."""
    return _durations(_histogram(summaries, list(by), F.lit(False)), list(by), width_ms)


def finished_since(as_of: Column, window: int) -> Column:
    return F.col("finished_at") > as_of - seconds(window)


def throughput(summaries: DataFrame, as_of: Column, window: int = 60) -> DataFrame:
    """Jobs that finished in the last ``window`` seconds (strictly after its start)."""
    return summaries.agg(F.count(F.when(finished_since(as_of, window), True)).alias("n"))


def metrics_snapshot(
    summaries: DataFrame, queued: DataFrame, dispatched: DataFrame, as_of: Column, window: int = 60, width_ms: int = 60_000
) -> DataFrame:
    """All figures of the dashboard in long form: as_of, metric, dimension, value."""
    hist = _histogram(summaries, ["status"], finished_since(as_of, window))
    counts = hist.groupBy("status").agg(F.sum("_n").alias("n"))
    rate = hist.agg(F.coalesce(F.sum(F.when(F.col("_recent"), F.col("_n"))), F.lit(0)).alias("n"))
    return snapshot_of(counts, hist, rate, queued, dispatched, as_of, width_ms)


def snapshot_of(
    counts: DataFrame, hist: DataFrame, rate: DataFrame, queued: DataFrame, dispatched: DataFrame, as_of: Column, width_ms: int = 60_000
) -> DataFrame:
    """The same from aggregates: ``status, n``; ``_ms, _timed`` (jobs per duration); and ``n`` recent finishes."""
    row = lambda df, metric, dimension, value: df.select(
        as_of.alias("as_of"),
        F.lit(metric).alias("metric"),
        dimension.alias("dimension"),
        value.cast("bigint").alias("value"),
    )
    none = F.lit("")
    durations = _durations(hist, [], width_ms).select(
        F.inline(
            F.array(
                F.struct(F.lit("duration_avg_ms").alias("metric"), F.col("avg_ms").alias("value")),
                F.struct(F.lit("duration_p95_ms").alias("metric"), F.col("p95_ms").alias("value")),
                F.struct(F.lit("duration_count").alias("metric"), F.col("n").alias("value")),
            )
        )
    )
    return (
        row(counts, "status_count", F.col("status"), F.col("n"))
        .unionByName(row(queue_depth(queued, dispatched), "queue_depth", F.coalesce("priority", F.lit("total")), F.col("pending")))
        .unionByName(durations.select(as_of.alias("as_of"), "metric", none.alias("dimension"), F.col("value").cast("bigint").alias("value")))
        .unionByName(row(rate, "throughput_per_min", none, F.col("n")))
    )
