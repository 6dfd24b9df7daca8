"""Streaming forms of the operators. Functions named ``stream_*`` take and return streaming frames; those
named ``start_*`` start a query with a sink and return it.

Sinks that run inside ``foreachBatch`` write one folder per batch id and overwrite it, so a batch that is
replayed after a failure leaves the same result.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtrail import schemas as S
from jobtrail.functions import scalars as P
from jobtrail.operators import admission as A
from jobtrail.operators import lifecycle as L
from jobtrail.operators import logs as G
from jobtrail.operators import metrics as M
from jobtrail.sources import files
from jobtrail.sources import runs as U

Trigger = dict


def stream_lifecycle(events: DataFrame) -> DataFrame:
    """The lifecycle fold over a stream; run it in update mode. See ``state`` for the form with expiry."""
    return L.lifecycle(events)


def stream_throughput(finishes: DataFrame, watermark: str = "1 minute", window: str = "1 minute", every: str = "5 seconds") -> DataFrame:
    """Finishes per trailing window (open at its start, closed at its end): window_start, window_end, n."""
    # Windows are closed at the start; a microsecond less turns that around.
    at = F.timestamp_micros(F.unix_micros("ts") - F.lit(1))
    late = finishes.select(at.alias("at")).withWatermark("at", watermark)
    counts = late.groupBy(F.window("at", window, every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def stream_log_entries(batches: DataFrame) -> DataFrame:
    """Entries of a batch stream, however late they are. A batch read again comes again: see ``read_logs``."""
    rows = G.valid_batches(batches).select("job_id", "container_id", "seq", F.posexplode_outer("logs").alias("pos", "e"))
    return rows.select(
        "job_id", "container_id", "seq", "pos", F.col("e.timestamp").alias("ts"), "e.message", "e.output_stream"
    )


# --- sinks ---------------------------------------------------------------------------------


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str, trigger: Trigger) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def start_append(df: DataFrame, path: str, checkpoint: str, trigger: Trigger, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Append rows to a Parquet table, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.partitionBy(*partition_by).option("path", path).trigger(**trigger).start()


def start_updates(
    df: DataFrame, path: str, checkpoint: str, trigger: Trigger, key: str = "job_id", keep: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Write every batch of an update-mode frame; read the table back with ``latest``.

    Batches are merged to the newest row per key as they pile up (``sources.runs``), so neither a reader's folders nor
    superseded rows grow with history. ``keep`` says which of the newest rows stay when a merge goes back to the first
    batch, e.g. a ``lifecycle.sweep``: rows that it drops have expired and leave the table.
    """

    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        merged = U.newest(rows, key)
        return keep(merged) if keep and whole else merged

    def each(batch: DataFrame, batch_id: int) -> None:
        U.compact(batch.sparkSession, path, batch_id, merge)
        U.write(batch.withColumn(U.BATCH, F.lit(batch_id).cast("bigint")), path, batch_id)

    return start(df, each, checkpoint, "update", trigger)


def latest(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """The newest row per key of a table written by ``start_updates``, which must have written a batch."""
    return U.newest(U.read(spark, path), key).drop(U.BATCH)


def start_logs(batches: DataFrame, path: str, checkpoint: str, trigger: Trigger) -> StreamingQuery:
    """Append log entries to a table by date. Batches without entries keep a row without a message, which
    registers their container; coalescing happens on read, see ``stored_batches``. Nothing is kept between
    batches, so no entry is too late for the table."""
    entries = stream_log_entries(batches).withColumn("event_date", F.to_date("ts"))
    return start_append(entries, path, checkpoint, trigger, ("event_date",))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log table; of batches that were read again (same job, container, seq and place) one copy."""
    return spark.read.parquet(path).dropDuplicates(["job_id", "container_id", "seq", "pos"])


def committed_logs(spark: SparkSession, path: str) -> DataFrame:
    """The rows a log writer has committed, as a stream. As ``progress`` of ``state.stream_completions`` it holds a
    job's document back until the log table itself has come as far. The table must have been started."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def stored_batches(entries: DataFrame) -> DataFrame:
    """Rows of a log table as the batches they came in; of a batch that was read again one copy."""
    entry = F.struct(F.col("ts").alias("timestamp"), "message", "output_stream")
    rows = entries.groupBy("job_id", "container_id", "seq").agg(F.min("ts").alias("ts"), F.sort_array(F.collect_set(F.struct("pos", entry.alias("e")))).alias("_all"))
    return rows.select("job_id", "container_id", "seq", "ts", F.transform(F.filter("_all", lambda x: x["pos"].isNotNull()), lambda x: x["e"]).alias("logs"))


def start_documents(
    ready: DataFrame, log_path: str, out_path: str, checkpoint: str, trigger: Trigger, max_entries: int = S.MAX_LOG_ENTRIES
) -> StreamingQuery:
    """Write the documents of jobs as they complete (``state.stream_completions``).

    Only the dates between the first event and the end of the batch's jobs are read from the log table, and a
    join with the batch's ids keeps just their rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = batch_folder(out_path, batch_id)
        batch.write.mode("overwrite").parquet(f"{folder}/ready")
        done = spark.read.parquet(f"{folder}/ready")
        span = done.agg(F.min(F.to_date("first_at")).alias("a"), F.max(F.date_add("completed_at", 1)).alias("b")).first()
        if span.a is None:
            return
        logs = spark.read.parquet(log_path)
        dates = F.col("event_date").isNull() | F.col("event_date").between(F.lit(span.a), F.lit(span.b))
        wanted = logs.where(dates).join(done.select("job_id"), "job_id", "left_semi")
        docs = G.job_documents(stored_batches(wanted), max_entries)
        ends = done.groupBy("job_id").agg(F.max("completed_at").alias("completed_at"), F.min("complete").alias("complete"))
        docs.join(ends, "job_id").write.mode("overwrite").parquet(f"{folder}/documents")

    return start(ready, each, checkpoint, "append", trigger)


def read_documents(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(f"{out_path}/batch_id=*/documents")


Table = Callable[[SparkSession], DataFrame]


def start_live_list(
    updates: DataFrame, path: str, checkpoint: str, trigger: Trigger, current: Table | None = None, status: str | None = None, n: int = S.MAX_LISTED_JOBS
) -> StreamingQuery:
    """A live list of at most ``n`` jobs kept between micro-batches; read it with ``live_list``.

    Every batch of updates (with ``seq``) is laid over the list that its predecessor left (``lifecycle.upsert_summaries``):
    known jobs keep their place, jobs that no longer match ``status`` leave, and those that come or come back go on top.
    The first batch starts from ``current``. A batch writes its list as one folder and takes away the one before its
    predecessor's, so a replay finds what it began from.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(batch_folder(path, batch_id - 1)) if batch_id else current(spark) if current else None
        if before is None:
            before = batch.select(*[c for c in batch.columns if c != "seq"], F.lit(0).cast("bigint").alias("position")).limit(0)
        merged = L.upsert_summaries(before, batch, status, n).coalesce(1)
        # One partition in order, of n rows at most.
        place = F.row_number().over(Window.orderBy("_at")) - 1
        listed = merged.withColumn("_at", F.monotonically_increasing_id()).withColumn("position", place.cast("bigint")).drop("_at")
        listed.write.mode("overwrite").parquet(batch_folder(path, batch_id))
        if batch_id > 1:
            files.remove(spark, batch_folder(path, batch_id - 2))

    return start(updates, each, checkpoint, "append", trigger)


def live_list(spark: SparkSession, path: str) -> DataFrame:
    """The list that the last finished batch left."""
    done = [int(n[9:]) for n in files.folders(spark, path) if files.committed(spark, f"{path}/{n}")]
    return spark.read.parquet(batch_folder(path, max(done)))


# --- metrics kept as aggregates --------------------------------------------------------------

_JOB = ["status", "at", "reason", "reason_at", "queued_at", "started_at", "finished_at", "updated_at"]


def _told(events: DataFrame) -> DataFrame:
    """What a batch of events says of each job, in a form of which two can be merged."""
    arrival, reason = F.struct(*L.ARRIVAL), F.col("reason") != ""
    first = lambda cond: F.min(F.when(cond, F.col("ts")))
    return L.valid_events(events).groupBy("job_id").agg(
        F.max_by("status", arrival).alias("status"),
        F.max(arrival).alias("at"),
        F.max_by("reason", F.when(reason, arrival)).alias("reason"),
        F.max(F.when(reason, arrival)).alias("reason_at"),
        first(F.col("status") == "Queued").alias("queued_at"),
        first(F.col("status") == "Running").alias("started_at"),
        first(P.is_terminal(F.col("status"))).alias("finished_at"),
        F.max("ts").alias("updated_at"),
    )


def _joined(told: DataFrame) -> DataFrame:
    earliest = [F.min(c).alias(c) for c in ("queued_at", "started_at", "finished_at")]
    return told.groupBy("job_id").agg(
        F.max_by("status", "at").alias("status"),
        F.max("at").alias("at"),
        F.max_by("reason", "reason_at").alias("reason"),
        F.max("reason_at").alias("reason_at"),
        *earliest,
        F.max("updated_at").alias("updated_at"),
    )


def _figures(jobs: DataFrame, retention: int, stale_ttl: int, tick: int) -> DataFrame:
    """What jobs add to the figures, ``n`` times each: kind, dimension, value, gone_at and the tick that lies in.

    A job counts while the clock is not past ``gone_at``, in microseconds.
    """
    ttl = F.when(P.is_terminal(F.col("status")), retention).otherwise(stale_ttl)
    gone = F.unix_micros("updated_at") + ttl.cast("bigint") * 1_000_000
    ms = P.millis_between(F.col("started_at"), F.col("finished_at")).cast("bigint")
    one = lambda kind, dimension, value: F.struct(F.lit(kind).alias("kind"), dimension.alias("dimension"), value.alias("value"))
    nothing = F.lit("")
    parts = F.array(
        one("status", F.col("status"), F.lit(0).cast("bigint")),
        F.when(ms.isNotNull(), one("ms", nothing, ms)),
        F.when(F.col("finished_at").isNotNull(), one("finish", nothing, F.unix_micros("finished_at"))),
    )
    rows = jobs.select("n", gone.alias("gone_at"), F.inline(F.filter(parts, lambda p: p.isNotNull())))
    return rows.withColumn("tick", F.floor(F.col("gone_at") / (tick * 1_000_000)))


def start_metrics(
    events: DataFrame,
    queued: Table,
    dispatched: Table,
    state_path: str,
    out_path: str,
    checkpoint: str,
    trigger: Trigger | None = None,
    retention: int = 3600,
    stale_ttl: int = 86400,
    window: int = 60,
    forget: int | None = None,
    tick: int = 3600,
) -> StreamingQuery:
    """A metrics snapshot after every batch, by default every 5 seconds. The snapshot's time is that of the
    newest event, so a replay gives the same figures.

    A batch is folded by itself, laid over the rows of its own jobs, and what these add to the figures is taken off and
    put on again: jobs per status, per exact duration, and finishes, each by the time at which its job expires. Three
    tables of runs (``sources.runs``) hold the jobs, the figures by tick of that time, and the figures by the exact
    time, of which a snapshot reads the one tick that the clock is in. So what a batch writes grows with the jobs it
    names, not with those that live, and a job expires without being touched.

    ``queued`` and ``dispatched`` are called in every batch, so that files written meanwhile count. A job's row is let
    go ``forget`` seconds after its last event, by default when it has surely expired; an event after that begins anew.
    """
    forget = max(retention, stale_ttl) if forget is None else forget
    if forget < max(retention, stale_ttl):
        raise ValueError("forget must not be less than retention and stale_ttl")
    jobs, ticks, exact = (f"{state_path}/{name}" for name in ("jobs", "ticks", "exact"))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told = _told(batch).withColumn("bucket", U.bucket("job_id")).persist()
        changed = None
        try:
            seen = told.agg(F.max(F.unix_micros("updated_at")), F.collect_set("bucket")).first()
            before = U.read(spark, ticks, batch_id)
            clock = None if before is None else before.where("kind = 'clock'").agg(F.max("value")).first()[0]
            now = max([x for x in (seen[0], clock) if x is not None], default=None)
            if now is None:
                return
            live = lambda rows: rows.where(F.unix_micros("updated_at") + F.lit(forget * 1_000_000) >= F.lit(now))
            U.compact(spark, jobs, batch_id, lambda rows, whole: live(U.newest(rows, "job_id")) if whole else U.newest(rows, "job_id"))
            U.compact(spark, ticks, batch_id, _summed(now, window, tick))
            U.compact(spark, exact, batch_id, _summed(now, window, tick))

            rows = told.select("job_id", "bucket", *_JOB, F.lit(1).alias("n"))
            known = U.read(spark, jobs, batch_id)
            if known is not None:
                own = known.where(F.col("bucket").isin(seen[1])).join(told.select("job_id"), "job_id", "left_semi")
                rows = rows.unionByName(live(U.newest(own, "job_id")).select("job_id", "bucket", *_JOB, F.lit(-1).alias("n")))
            after = _joined(rows).withColumns({"bucket": U.bucket("job_id"), "n": F.lit(1)})
            changed = rows.where("n < 0").unionByName(after).persist()
            now_held = changed.where("n > 0").drop("n").withColumn(U.BATCH, F.lit(batch_id).cast("bigint"))
            U.write(now_held.repartitionByRange("bucket").sortWithinPartitions("bucket", "job_id"), jobs, batch_id)
            added = _figures(changed, retention, stale_ttl, tick)
            stamp = spark.range(1).selectExpr("'clock' AS kind", "'' AS dimension", f"{now}L AS value", f"{1 << 62}L AS tick", "1L AS n")
            by_tick = added.groupBy("kind", "dimension", "value", "tick").agg(F.sum("n").alias("n")).where("n <> 0")
            U.write(by_tick.unionByName(stamp), ticks, batch_id)
            by_time = added.groupBy("kind", "dimension", "value", "tick", "gone_at").agg(F.sum("n").alias("n")).where("n <> 0")
            U.write(by_time.repartitionByRange("tick").sortWithinPartitions("tick"), exact, batch_id)
            _snapshot(spark, ticks, exact, now, batch_id, queued(spark), dispatched(spark), window, tick).write.mode("overwrite").parquet(
                batch_folder(out_path, batch_id)
            )
        finally:
            told.unpersist()
            if changed is not None:
                changed.unpersist()

    return start(events, each, checkpoint, "append", trigger or {"processingTime": "5 seconds"})


def _summed(now: int, window: int, tick: int) -> U.Merge:
    """Figures of merged runs added up, without those that no clock from ``now`` on reads again."""

    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        clock = rows.where("kind = 'clock'").groupBy(*[c for c in rows.columns if c not in ("n", "value")]).agg(F.max("value").alias("value"), F.lit(1).cast("bigint").alias("n"))
        wanted = (F.col("tick") >= now // (tick * 1_000_000)) & ((F.col("kind") != "finish") | (F.col("value") > now - window * 1_000_000))
        left = rows.where((F.col("kind") != "clock") & wanted)
        summed = left.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).where("n <> 0")
        return summed.unionByName(clock.select(*summed.columns))

    return merge


def _snapshot(spark, ticks: str, exact: str, now: int, batch_id: int, queued: DataFrame, dispatched: DataFrame, window: int, tick: int) -> DataFrame:
    at = now // (tick * 1_000_000)
    figures = ["kind", "dimension", "value", "n"]
    later = U.read(spark, ticks, batch_id + 1).where((F.col("tick") > at) & (F.col("kind") != "clock")).select(*figures)
    border = U.read(spark, exact, batch_id + 1).where((F.col("tick") == at) & (F.col("gone_at") >= now)).select(*figures)
    held = later.unionByName(border)
    counts = held.where("kind = 'status'").groupBy(F.col("dimension").alias("status")).agg(F.sum("n").alias("n")).where("n <> 0")
    hist = held.where("kind = 'ms'").groupBy(F.col("value").alias("_ms")).agg(F.sum("n").alias("_timed")).where("_timed <> 0")
    rate = held.where((F.col("kind") == "finish") & (F.col("value") > now - window * 1_000_000)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return M.snapshot_of(counts, hist, rate, queued, dispatched, F.timestamp_micros(F.lit(now)))


def start_split_rejects(
    raw: DataFrame, payloads: Table, ok_path: str, reject_path: str, checkpoint: str, trigger: Trigger
) -> StreamingQuery:
    """Resolve queue rows batch by batch into accepted rows and rejects with their class.

    ``payloads`` is called in every batch, so that payloads written after the query's start resolve. Only those of
    the batch's ids take part in the join.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select(P.canonical_job_id(F.col("raw_id")).alias("job_id")).distinct()
        rows = A.classify_queue(batch, payloads(batch.sparkSession).join(ids, "job_id", "left_semi"))
        good = rows.where(F.col("reject").isNull()).drop("reject")
        bad = rows.where(F.col("reject").isNotNull())
        rows.persist()
        try:
            good.write.mode("overwrite").parquet(batch_folder(ok_path, batch_id))
            bad.write.mode("overwrite").parquet(batch_folder(reject_path, batch_id))
        finally:
            rows.unpersist()

    return start(raw, each, checkpoint, "append", trigger)
