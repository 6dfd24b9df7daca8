"""Table-level redaction and secret scanning."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.functions import redact as R


def redact_jobs(jobs: DataFrame, mode: str = "smart", key_pattern: str | None = None) -> DataFrame:
    """Display-safe jobs: metadata masked by key and content, scripts scrubbed, everything else as it was."""
    return jobs.withColumns(
        {
            "metadata": R.redact_metadata(F.col("metadata"), mode, key_pattern),
            "steps": R.redact_steps(F.col("steps"), mode, key_pattern),
        }
    )


def redact_text_table(docs: DataFrame, column: str) -> DataFrame:
    """Mask secrets in a text column and count the masks added. Narrow, whole texts."""
    out = docs.withColumn("_clean", R.redact_text(F.col(column)))
    spans = R.masked_spans(F.col("_clean")) - R.masked_spans(F.col(column))
    return out.withColumn("masked_spans", spans).withColumn(column, F.col("_clean")).drop("_clean")


def secret_scan(jobs: DataFrame, mode: str = "smart", key_pattern: str | None = None) -> DataFrame:
    """One row per masked entry: job_id, step_id (NULL = job level), key, rule. Narrow."""
    job_level = F.struct(F.lit(None).cast("int").alias("step_id"), F.col("metadata").alias("metadata"))
    step_level = F.transform("steps", lambda s: F.struct(s["id"].alias("step_id"), s["metadata"].alias("metadata")))
    maps = jobs.select(F.col("id").alias("job_id"), F.inline(F.concat(F.array(job_level), step_level)))
    entries = maps.select("job_id", "step_id", F.explode("metadata").alias("key", "value"))
    rule = R.masking_rule(F.col("key"), F.col("value"), mode, key_pattern)
    # A filter on the rule would be pushed down and work it out twice; exploding an array does not.
    fired = F.explode(F.array_compact(F.array(rule)))
    return entries.select("job_id", "step_id", "key", fired.alias("rule"))


def secret_counts(scan: DataFrame) -> DataFrame:
    return scan.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))


def safe_log_export(jobs: DataFrame) -> DataFrame:
    """Metadata-free JSON per job."""
    return jobs.select(F.col("id").alias("job_id"), R.safe_job_json({c: F.col(c) for c in jobs.columns}).alias("json"))


def safe_log_export_text(raw: DataFrame, column: str = "value") -> DataFrame:
    """The same from JSON texts; an undecodable text yields ''."""
    from jobtrail import schemas as S
    from jobtrail.operators.admission import undecodable

    job = F.from_json(column, S.JOB, {"mode": "PERMISSIVE"})
    bad = undecodable(F.col(column), job)
    parsed = raw.withColumn("_job", job)
    return parsed.select(
        F.when(bad, "").otherwise(R.safe_job_json({f.name: F.col(f"_job.{f.name}") for f in S.JOB.fields})).alias("json")
    )
