"""Reports on redaction and secrets."""

from pyspark.sql import functions as F

from jobtrail.functions import redact as R
from jobtrail.operators import secrets as X
from jobtrail.plans import views_sql as Q
from jobtrail.plans.registry import report

_RULE = f"""CASE WHEN value = '' THEN NULL WHEN regexp_matches(key, '{Q.KEY_RE}') THEN 'key' ELSE {Q.secret_rule('value')} END"""


@report(
    "p19_shannon_entropy",
    f"SELECT page_id, {Q.entropy('u')} AS entropy FROM (SELECT page_id, url AS u FROM pages)",
)
def _(v):
    return v.table("pages").select("page_id", R.shannon_entropy(F.col("url")).alias("entropy"))


@report("p20_secret_values", f"SELECT job_id, key, {Q.secret_rule('value')} IS NOT NULL AS secret FROM payload_meta WHERE step_id = 0", "payload_meta")
def _(v):
    rows = v.payloads().select(F.col("id").alias("job_id"), F.explode("metadata").alias("key", "value"))
    return rows.select("job_id", "key", R.looks_like_secret(F.col("value")).alias("secret"))


@report(
    "p22_redact_metadata",
    f"""SELECT job_id, CAST(step_id AS BIGINT) AS step_id, key, CASE WHEN {_RULE} IS NOT NULL THEN '{Q.MASK}' ELSE value END AS value FROM payload_meta""",
    "payload_meta",
)
def _(v):
    jobs = X.redact_jobs(v.payloads())
    top = F.struct(F.lit(0).alias("step_id"), F.col("metadata").alias("m"))
    steps = F.transform("steps", lambda s: F.struct(s["id"].alias("step_id"), s["metadata"].alias("m")))
    maps = jobs.select(F.col("id").alias("job_id"), F.inline(F.concat(F.array(top), steps)))
    return maps.select("job_id", "step_id", F.explode("m").alias("key", "value"))


@report(
    "p24_redact_scripts",
    """SELECT job_id, CAST(id AS BIGINT) AS step_id, CASE WHEN id = 1 THEN 'export DEPLOY_SECRET=••••••; svn checkout https://bot:••••••@code.example/tree' ELSE script END AS script
       FROM payload_steps""",
    "payload_steps",
)
def _(v):
    steps = X.redact_jobs(v.payloads()).select(F.col("id").alias("job_id"), F.inline("steps"))
    return steps.select("job_id", F.col("id").alias("step_id"), "script")


@report(
    "p23_redact_documents",
    f"""WITH r AS (SELECT doc_id, text, {Q.redact_text('text')} AS t FROM documents), m AS (SELECT doc_id, text, {Q.mask_tokens('t')} AS clean FROM r)
        SELECT doc_id, md5(clean) AS digest, length(clean) AS chars,
          CAST((length(clean) - length(replace(clean, '{Q.MASK}', '')) - length(text) + length(replace(text, '{Q.MASK}', ''))) // 6 AS BIGINT) AS masked_spans FROM m""",
)
def _(v):
    clean = X.redact_text_table(v.table("documents").select("doc_id", "text"), "text")
    return clean.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"), "masked_spans")


@report(
    "p23_redact_lines",
    f"""WITH r AS (SELECT job_id, line_no, {Q.redact_text('line')} AS t FROM raw_lines)
        SELECT job_id, line_no, {Q.mask_tokens('t')} AS line FROM r""",
    "raw_lines",
)
def _(v):
    return X.redact_text_table(v.raw_lines().select("job_id", "line_no", "line"), "line").select("job_id", "line_no", "line")


@report(
    "p21_secret_scan",
    f"""SELECT job_id, CAST(nullif(step_id, 0) AS BIGINT) AS step_id, key, rule FROM (SELECT *, {_RULE} AS rule FROM payload_meta) WHERE rule IS NOT NULL""",
    "payload_meta",
)
def _(v):
    return X.secret_scan(v.payloads())


@report(
    "p21_secret_counts",
    f"""SELECT rule, key, count(*) AS n FROM (SELECT *, CASE WHEN value = '' THEN NULL WHEN regexp_matches(key, '(?i)branch|conn') THEN 'key'
          ELSE {Q.secret_rule('value')} END AS rule FROM payload_meta) WHERE rule IS NOT NULL GROUP BY ALL""",
    "payload_meta",
)
def _(v):
    return X.secret_counts(X.secret_scan(v.payloads(), key_pattern="(?i)branch|conn"))


@report("p21_mask_all", "SELECT key, count(*) AS n FROM payload_meta WHERE value <> '' GROUP BY key", "payload_meta")
def _(v):
    return X.secret_scan(v.payloads(), mode="all").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@report(
    "p25_safe_log_export",
    """SELECT p.id AS job_id, p.name, CASE WHEN callback_url = 'https://user:tok@h_x/logs?s=1#f' THEN 'https://h_x/logs' ELSE nullif(callback_url, '') END AS callback_url,
         nullif(timeout_seconds, 0) AS timeout_seconds, s.script AS script1, nullif(s.pids_limit, 0) AS pids1, '{}' AS metadata
       FROM payloads p JOIN payload_steps s ON s.job_id = p.id AND s.id = 1""",
    "payloads",
    "payload_steps",
)
def _(v):
    get = lambda path: F.get_json_object("json", path)
    return X.safe_log_export(v.payloads()).select(
        "job_id",
        get("$.name").alias("name"),
        get("$.callback_url").alias("callback_url"),
        get("$.timeout_seconds").cast("bigint").alias("timeout_seconds"),
        get("$.steps[0].script").alias("script1"),
        get("$.steps[0].pids_limit").cast("bigint").alias("pids1"),
        get("$.metadata").alias("metadata"),
    )


