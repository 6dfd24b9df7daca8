"""Readers and writers of the telemetry tables."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail import schemas as S
from jobtrail.functions import scalars as P
from jobtrail.operators import ordered
from jobtrail.operators.admission import undecodable
from jobtrail.operators.lifecycle import seconds, valid_events
from jobtrail.operators.logs import valid_batches
from jobtrail.session import shared_dir
from jobtrail.sources import files

_CORRUPT = "_corrupt"


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


# --- sources -------------------------------------------------------------------------------


def read_jobs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Submissions from JSON lines; unknown fields are ignored, a missing priority is the default one.

    Broken lines keep their text in ``_corrupt`` and NULL everywhere else.
    """
    schema = T.StructType([*S.SUBMISSION.fields, T.StructField(_CORRUPT, T.StringType())])
    jobs = _reader(spark, stream).schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    return jobs.withColumn("priority", F.coalesce("priority", F.lit(S.DEFAULT_PRIORITY)))


def decode_jobs(raw: DataFrame, column: str = "value") -> DataFrame:
    """The same from a text column of a table or stream, next to the columns already there."""
    job = F.from_json(column, S.SUBMISSION, {"mode": "PERMISSIVE"})
    rows = raw.withColumn("_job", job)
    fields = [F.col(f"_job.{f.name}").alias(f.name) for f in S.SUBMISSION.fields if f.name != "priority"]
    keep = [c for c in raw.columns if c != column]
    return rows.select(
        *keep,
        F.coalesce("_job.priority", F.lit(S.DEFAULT_PRIORITY)).alias("priority"),
        *fields,
        undecodable(F.col(column), F.col("_job")).alias("corrupt"),
    )


def read_status_events(raw: DataFrame) -> DataFrame:
    """Messages (topic, value = job id, reason, ts, seq) to status events; invalid ones are dropped."""
    events = raw.select(
        F.col("value").alias("job_id"),
        P.status_from_topic(F.col("topic")).alias("status"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        "ts",
        "seq",
    )
    return valid_events(events)


def read_log_batches(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages (value, seq) to log batches; undecodable ones and those without ids are dropped."""
    batch = F.from_json(column, S.LOG_BATCH, {"mode": "PERMISSIVE"})
    keep = [c for c in raw.columns if c != column]
    # Filtering inside the array decodes each message once; a filter on the rows would be pushed below it.
    valid = F.filter(F.array(batch), lambda b: (b["job_id"] != "") & (b["container_id"] != ""))
    return raw.select(*keep, F.inline(valid))


def read_raw_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Container text laid out as ``<path>/job_id=…/container_id=…/stream=…/file``.

    A batch read numbers the lines of a stream over its files in name order. Large files are read in splits:
    a line's place is its split and its place in there, and ``numbered`` makes line numbers of it. A streaming
    read has no line numbers; there, order comes from the message's own time.
    """
    ids = "job_id string, container_id string, stream string"
    # Only a newline ends a line; a carriage return may be part of one.
    reader = _reader(spark, stream).schema(f"value string, {ids}").option("lineSep", "\n")
    keys = ["job_id", "container_id", "stream"]
    if stream:
        return reader.text(path).select(*keys, F.col("value").alias("line"))
    lines = reader.text(path).select(
        *keys,
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    numbered = ordered.numbered(lines, keys, ["_file", "_split", "_at"], [F.col("_file"), F.col("_split")], "line_no")
    return numbered.select(*keys, (F.col("line_no") - 1).alias("line_no"), "line")


def split_lines(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per line of a text column, numbered from 0. Narrow."""
    return docs.select(*keep, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def tail_logs(spark: SparkSession, path: str, job_id: str | None = None, stream: bool = True) -> DataFrame:
    """Everything retained in a log table, then what is appended to it. ``stream=False`` is the snapshot."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path)
    return rows.where(F.col("job_id") == job_id) if job_id else rows


def snapshot_and_tail(spark: SparkSession, path: str, job_id: str, files_path: str) -> tuple[DataFrame, DataFrame]:
    """What a log table holds of a job now, and as a stream what is appended from now on: every row in one of them.

    The files of the snapshot are listed once and written to ``files_path``; the stream leaves their rows out, so
    nothing is given twice and rows that are equal but were logged twice stay. No row goes through the driver.
    """
    rows = spark.read.parquet(path)
    seen, name = shared(spark, rows.select(F.col("_metadata.file_path").alias("_file")).distinct(), files_path), F.col("_metadata.file_path")
    live = spark.readStream.schema(rows.schema).parquet(path).withColumn("_file", name)
    live = live.where(F.col("job_id") == job_id).join(seen, "_file", "left_anti")
    return rows.where(F.col("job_id") == job_id), live.select(*rows.columns)


def shared(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.parquet(path)


# --- sinks ---------------------------------------------------------------------------------


def _with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("ts"))


def write_status(events: DataFrame, path: str, mode: str = "append") -> None:
    """Valid events as Parquet by date, clustered by job so that a job lookup touches few row groups."""
    _clustered(_with_date(valid_events(events))).write.mode(mode).partitionBy("event_date").parquet(path)


def write_logs(entries: DataFrame, path: str, mode: str = "append") -> None:
    _clustered(_with_date(valid_batches(entries))).write.mode(mode).partitionBy("event_date").parquet(path)


def _clustered(df: DataFrame) -> DataFrame:
    # A range split may cut a large job over several files, which a hash split cannot.
    order = ["event_date", "job_id", "ts", "seq"]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def expire_partitions(spark: SparkSession, path: str, as_of: Column, max_age: int = 86400) -> DataFrame:
    """Rows of a dated table that are not past their age; whole expired dates are never opened."""
    cut = as_of - seconds(max_age)
    rows = spark.read.parquet(path)
    return rows.where((F.col("event_date") >= F.to_date(cut)) & (F.col("ts") >= cut))


def drop_expired(spark: SparkSession, path: str, as_of: date, max_age_days: int = 1) -> list[str]:
    """Delete whole dates of a dated table that are past their age; returns the dates whose folders went.

    First the oldest date to be kept is published, and ``read_kept`` reads from there on. The folders of a date go one
    call after the call that published it as expired, so a reader that began before can finish.
    """
    cut = as_of - timedelta(days=max_age_days)
    marks = f"{path}/_kept"
    before = max((n[5:] for n in files.folders(spark, marks)), default="")
    expired = [n for n in files.folders(spark, path) if n.startswith("event_date=") and n[11:] < min(before, str(cut))]
    if str(cut) > before:
        spark.range(0).write.mode("overwrite").parquet(f"{marks}/from={cut}")
    for name in expired:
        files.remove(spark, f"{path}/{name}")
    return [n[11:] for n in expired]


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dated table from the oldest date that ``drop_expired`` keeps; older folders are not opened."""
    cut = max((n[5:] for n in files.folders(spark, f"{path}/_kept")), default=None)
    rows = spark.read.parquet(path)
    return rows if cut is None else rows.where(F.col("event_date") >= F.lit(cut).cast("date"))


def write_keyed(spark: SparkSession, path: str, new: DataFrame, key: str = "job_id", version: str = "version", buckets: int = 64) -> None:
    """Put rows into a table keyed by id, in buckets of ids; the highest version of a key wins, a repeat changes nothing.

    Only buckets that get a newer row are rewritten, the others keep their files. The new content of a bucket is written
    beside the table first, since a table cannot be overwritten while it is read. One writer at a time.
    """
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rest = [c for c in new.columns if c != key]
    newest = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*").select(*new.columns)
    merged = newest(new)
    if any(n.startswith("bucket=") for n in files.folders(spark, path)):
        held = spark.read.parquet(path)
        known = held.select(key, F.col(version).alias("_known"))
        fresh = merged.join(known, key, "left").where(F.col("_known").isNull() | (F.col(version) > F.col("_known")))
        touched = [r[0] for r in fresh.select(of.alias("b")).distinct().collect()]
        if not touched:
            return
        merged = newest(held.where(F.col("bucket").isin(touched)).select(*new.columns).unionByName(merged.where(of.isin(touched))))
    staged = shared(spark, merged.withColumn("bucket", of), shared_dir(spark, "keyed"))
    writer = staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)


def upsert_jobs(old: DataFrame, new: DataFrame, key: str = "job_id", version: str = "version") -> DataFrame:
    """Job table keyed by id: the row with the highest version wins, a repeated one changes nothing."""
    rest = [c for c in old.columns if c not in (key, version)]
    both = old.unionByName(new.select(*old.columns))
    latest = both.groupBy(key).agg(F.max_by(F.struct(version, *rest), version).alias("_r"))
    return latest.select(key, "_r.*").select(*old.columns)


def export_job_logs(documents: DataFrame, deliveries: DataFrame) -> DataFrame:
    """JSON per deliverable job: target_host, callback_url, job_id, part, parts, body.

    The bodies of a job's parts, put together in order, are one JSON list of its containers; nearly always there is
    one part. A part may end inside a container, where the next goes on.
    """

    def text(c: Column) -> Column:
        head = F.to_json(F.struct(F.col("job_id"), c["container_id"].alias("container_id")))
        opened = F.concat(F.when(c["slot"] == 0, "[").otherwise(","), F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"logs":['))
        logs = F.to_json(c["entries"])
        closed = F.when(c["piece"] == c["pieces"] - 1, "]}").otherwise("")
        return F.concat(F.when(c["piece"] == 0, opened).otherwise(","), F.substring(logs, F.lit(2), F.length(logs) - 2), closed)

    end = F.when(F.col("part") == F.col("parts") - 1, "]").otherwise("")
    body = F.concat(F.array_join(F.transform("containers", text), ""), end)
    rows = documents.join(deliveries.select("job_id", "callback_url"), "job_id")
    return rows.select(P.callback_host(F.col("callback_url")).alias("target_host"), "callback_url", "job_id", "part", "parts", body.alias("body"))


def write_exports(exports: DataFrame, path: str, mode: str = "append") -> None:
    """Documents by target host. The range split spreads a host that receives most of them."""
    order = ["target_host", "job_id", "part"]
    exports.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("target_host").json(path)
