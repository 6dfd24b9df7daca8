"""The entity views of ``sources.views`` and shared folds in DuckDB's SQL, for the checks only."""

_STATUS = """CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Succeeded'
    WHEN 'error' THEN 'Failed' ELSE 'Stopped' END AS status,
  CASE WHEN event_type = 'error' THEN props ELSE '' END AS reason, ts, event_id AS seq FROM events"""

_DAY = "concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR))"
_ORDER = "CAST(user_id * 30 + day(ts) - 1 AS VARCHAR)"
_USER = "CAST(user_id AS VARCHAR)"

_ENTRY = """event_type AS container_id, event_id AS seq, 0 AS pos, ts, props AS message,
  CASE WHEN event_id % 5 = 0 THEN 'stderr' ELSE 'stdout' END AS output_stream FROM events"""


def _summary(events: str) -> str:
    return f"""SELECT job_id, arg_max(status, row(ts, seq)) AS status,
  coalesce(arg_max(reason, row(ts, seq)) FILTER (reason <> ''), '') AS reason,
  min(ts) FILTER (status = 'Queued') AS queued_at, min(ts) FILTER (status = 'Running') AS started_at,
  min(ts) FILTER (status IN ('Succeeded', 'Failed', 'Stopped')) AS finished_at, max(ts) AS updated_at
  FROM {events} GROUP BY job_id"""


# Batches unnested: sign-ups have no entry, errors two.
def _batch_entry(key: str) -> str:
    return f"""SELECT {key} AS job_id, event_type AS container_id, event_id AS seq, pos, ts, props AS message,
  CASE WHEN pos = 1 THEN 'stderr' ELSE 'stdout' END AS output_stream
  FROM events, (VALUES (0), (1)) p(pos)
  WHERE event_type <> 'signup' AND (pos = 0 OR event_type = 'error')"""


def _slots(key: str) -> str:
    return f"""SELECT job_id, container_id, row_number() OVER (PARTITION BY job_id ORDER BY first_seq, container_id) - 1 AS slot
  FROM (SELECT {key} AS job_id, event_type AS container_id, min(event_id) AS first_seq FROM events GROUP BY ALL)"""


_TERMINAL = "('Succeeded', 'Failed', 'Stopped')"

_URL = """CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'ftp://h.example/x' WHEN 2 THEN 'http:///path'
    WHEN 3 THEN 'https://user:tok@h_x/logs?s=1#f' WHEN 4 THEN '/relative' ELSE 'https://host.example:8443/logs' END AS callback_url,
  CASE WHEN o_orderkey % 11 = 0 THEN -5 ELSE (o_orderkey % 5) * 600 END AS timeout_seconds"""

_PRIORITY = """CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2
    WHEN '5-LOW' THEN 1 END AS priority"""


def mem_bytes(c: str) -> str:
    number, unit = f"left({c}, greatest(length({c}) - 1, 0))", f"upper(right({c}, 1))"
    return f"""CASE WHEN length({c}) >= 2 AND regexp_full_match({number}, '[+-]?[0-9]+') AND CAST({number} AS BIGINT) >= 0
    THEN CAST({number} AS BIGINT) * CASE {unit} WHEN 'G' THEN 1073741824 WHEN 'M' THEN 1048576 END END"""


def mem_error(c: str) -> str:
    number, unit = f"left({c}, greatest(length({c}) - 1, 0))", f"upper(right({c}, 1))"
    return f"""CASE WHEN length({c}) < 2 THEN 'format' WHEN NOT regexp_full_match({number}, '[+-]?[0-9]+') THEN 'value'
    WHEN CAST({number} AS BIGINT) < 0 THEN 'negative' WHEN {unit} NOT IN ('G', 'M') THEN 'unit' END"""


def net_error(c: str) -> str:
    return f"""CASE WHEN {c} NOT IN ('', 'none', 'bridge', 'host', 'default')
    AND NOT regexp_full_match({c}, '[a-zA-Z0-9][a-zA-Z0-9_.-]*')
    THEN 'invalid network mode: must be none, bridge, host, default, or a valid network name' END"""


def url_error(c: str) -> str:
    return f"""CASE WHEN NOT regexp_matches({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'callback URL must be absolute'
    WHEN NOT regexp_matches({c}, '^(?i)https?:') THEN 'callback URL scheme must be http or https'
    WHEN regexp_extract(regexp_extract({c}, '^[a-zA-Z]+://([^/?#]*)', 1), '([^@]*)$', 1) = '' THEN 'callback URL must include a host' END"""


def step_error() -> str:
    return f"""CASE WHEN memory_limit <> '' AND {mem_error('memory_limit')} IS NOT NULL THEN 'Failed to parse RAM limit'
    WHEN memory_swap <> '' AND {mem_error('memory_swap')} IS NOT NULL THEN 'Failed to parse memory_swap limit'
    WHEN memory_swap <> '' AND memory_limit = '' THEN 'memory_swap requires memory_limit to be set'
    WHEN memory_swap <> '' AND {mem_bytes('memory_swap')} < {mem_bytes('memory_limit')}
      THEN 'memory_swap must be greater than or equal to memory_limit'
    WHEN pids_limit < 0 THEN 'pids_limit cannot be negative'
    ELSE {net_error('network')} END"""


def job_error(step: str) -> str:
    return f"""CASE WHEN name = '' THEN 'Invalid request payload: "Name" is required'
    WHEN timeout_seconds < 0 THEN 'timeout_seconds cannot be negative'
    WHEN {step} IS NOT NULL THEN {step}
    WHEN callback_url <> '' THEN 'Invalid callback_url: ' || ({url_error('callback_url')}) END"""


MASK = "••••••"
LONG = "[A-Za-z0-9+/=_\\-]{24,}"
KEY_RE = "(?i)(token|passwd|password|pwd|secret|api[_-]?key|access[_-]?key|credential|auth|private|cert|signing|session)"


def entropy(c: str) -> str:
    return f"""round(list_sum(list_transform(list_distinct(string_split({c}, '')), lambda ch:
    -((length({c}) - length(replace({c}, ch, ''))) / length({c})) * log2((length({c}) - length(replace({c}, ch, ''))) / length({c})))), 12)"""


def secret_rule(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/\\s:@]+:[^/\\s@]+@') THEN 'url_credentials'
    WHEN contains({c}, '-----BEGIN') THEN 'pem'
    WHEN regexp_matches({c}, '^[A-Za-z0-9_-]{{6,}}\\.[A-Za-z0-9_-]{{6,}}\\.[A-Za-z0-9_-]{{6,}}$') THEN 'jwt'
    WHEN length({c}) >= 24 AND regexp_matches({c}, '^[A-Za-z0-9+/=_\\-]+$') AND {entropy(c)} >= 3.5 THEN 'entropy' END"""


def redact_text(c: str) -> str:
    """The text with everything but the token pass masked."""
    words = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|credential|auth|private|signing|session"
    s = f"regexp_replace({c}, '([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/\\s:@]+:)([^/\\s@]+)(@)', '\\1{MASK}\\3', 'g')"
    s = (
        f"regexp_replace({s}, '(?i)((?:^|[\\s;&|(])(?:export\\s+|set\\s+|-e\\s+)?[\\w.\\-]*(?:{words})[\\w.\\-]*\\s*[:=]\\s*)"
        f"([\"'']?)([^\\s\"'';]+)', '\\1\\2{MASK}', 'g')"
    )
    s = f"regexp_replace({s}, '(?s)-----BEGIN[^-]*-----.*?-----END[^-]*-----', '{MASK}', 'g')"
    return f"regexp_replace({s}, '[A-Za-z0-9_-]{{6,}}\\.[A-Za-z0-9_-]{{6,}}\\.[A-Za-z0-9_-]{{6,}}', '{MASK}', 'g')"


def mask_tokens(c: str) -> str:
    """The token pass over a column: gaps and tokens side by side, high-entropy tokens masked."""
    return f"""CASE WHEN regexp_matches({c}, '{LONG}') THEN
    list_aggregate(list_transform(list_zip(regexp_split_to_array({c}, '{LONG}'), regexp_extract_all({c}, '{LONG}')), lambda z:
      concat(z[1], CASE WHEN z[2] IS NULL THEN '' WHEN {entropy('z[2]')} >= 3.5 THEN '{MASK}' ELSE z[2] END)), 'string_agg', '')
    ELSE {c} END"""


_STEP_COLUMNS = """CAST(l_orderkey AS VARCHAR) AS job_id, concat('img-', CAST(l_partkey % 20 AS VARCHAR)) AS image,
  l_linenumber % 3 = 0 AS continue_on_error,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS exit_code,
  CAST(l_quantity AS BIGINT) % 5 AS cpu_limit,
  CASE l_partkey % 8 WHEN 0 THEN '512M' WHEN 1 THEN '2G' WHEN 2 THEN '1g' WHEN 3 THEN '' WHEN 4 THEN '1K'
    WHEN 5 THEN 'abcM' WHEN 6 THEN '-5G' ELSE '256m' END AS memory_limit,
  CASE l_suppkey % 4 WHEN 0 THEN '1G' WHEN 1 THEN '4G' ELSE '' END AS memory_swap,
  CASE l_partkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'bad net' WHEN 2 THEN 'my-net' ELSE '' END AS network,
  CAST(l_linenumber AS BIGINT) - 2 AS pids_limit,
  CASE l_returnflag WHEN 'N' THEN 'waiting' WHEN 'R' THEN 'running' ELSE 'terminated' END AS raw_state,
  CASE WHEN l_returnflag = 'N' THEN CASE l_partkey % 4 WHEN 0 THEN 'ImagePullBackOff' WHEN 1 THEN 'ErrImagePull'
    WHEN 2 THEN 'CrashLoopBackOff' ELSE 'PodInitializing' END END AS waiting_reason,
  l_suppkey % 2 = 0 AS logs_published"""

# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "status_events": ((), f"SELECT {_DAY} AS job_id, {_STATUS}"),
    "order_events": ((), f"SELECT {_ORDER} AS job_id, {_STATUS}"),
    "user_events": ((), f"SELECT {_USER} AS job_id, {_STATUS}"),
    "summary": (("status_events",), _summary("status_events")),
    "order_summary": (("order_events",), _summary("order_events")),
    "enqueues": (
        (),
        f"""SELECT CASE WHEN event_id % 3 = 0 THEN concat('new-', CAST(event_id AS VARCHAR)) ELSE {_DAY} END AS job_id,
  concat('job-', CAST(event_id AS VARCHAR)) AS name,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
  event_id % 6 AS step_count, ts - INTERVAL 1 HOUR AS ts, event_id AS seq FROM events WHERE event_type = 'signup'""",
    ),
    "enq_summary": (
        ("status_events", "enqueues"),
        """SELECT job_id,
  coalesce(arg_max(status, row(ts, seq)) FILTER (status IS NOT NULL), 'Queued') AS status,
  coalesce(arg_max(reason, row(ts, seq)) FILTER (reason <> ''), '') AS reason,
  min(ts) FILTER (status = 'Queued' OR status IS NULL) AS queued_at, min(ts) FILTER (status = 'Running') AS started_at,
  min(ts) FILTER (status IN ('Succeeded', 'Failed', 'Stopped')) AS finished_at, max(ts) AS updated_at,
  coalesce(arg_max(name, row(ts, seq)) FILTER (status IS NULL), '') AS name,
  coalesce(arg_max(priority, row(ts, seq)) FILTER (status IS NULL), '') AS priority,
  coalesce(arg_max(step_count, row(ts, seq)) FILTER (status IS NULL), 0) AS step_count
  FROM (SELECT job_id, status, reason, ts, seq, NULL AS name, NULL AS priority, NULL AS step_count FROM status_events
        UNION ALL SELECT job_id, NULL, NULL, ts, seq, name, priority, step_count FROM enqueues) GROUP BY job_id""",
    ),
    "job_facts": (
        ("status_events",),
        """SELECT job_id, concat('pay-', CAST(min(seq) AS VARCHAR)) AS name, count(*) AS step_count
  FROM status_events WHERE status = 'Stopped' GROUP BY job_id""",
    ),
    "log_entries": ((), f"SELECT {_USER} AS job_id, {_ENTRY}"),
    "day_entries": ((), f"SELECT {_DAY} AS job_id, {_ENTRY}"),
    "batch_entries": ((), _batch_entry(_USER)),
    "day_batch_entries": ((), _batch_entry(_DAY)),
    "slots": ((), _slots(_USER)),
    "day_slots": ((), _slots(_DAY)),
    # A completion is a terminal event whose last Running or terminal predecessor is Running.
    "completions": (
        ("status_events",),
        f"""SELECT job_id, max(ts) AS completed_at FROM (
    SELECT job_id, status, ts, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before
    FROM status_events WHERE status <> 'Queued') WHERE status IN {_TERMINAL} AND before = 'Running' GROUP BY job_id""",
    ),
    "order_completions": (
        ("order_events",),
        f"""SELECT job_id, max(ts) AS completed_at FROM (
    SELECT job_id, status, ts, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before
    FROM order_events WHERE status <> 'Queued') WHERE status IN {_TERMINAL} AND before = 'Running' GROUP BY job_id""",
    ),
    "attempts": (
        (),
        f"SELECT {_USER} AS key, ts, event_id AS seq, event_type = 'signup' AS ok FROM events WHERE event_type IN ('signup', 'error')",
    ),
    "jobs": (
        (),
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
  CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('job-', CAST(o_orderkey AS VARCHAR)) END AS name,
  {_PRIORITY}, concat('ns-', CAST(o_custkey % 8 AS VARCHAR)) AS namespace, o_orderdate AS submitted_at,
  o_orderstatus = 'P' AS suspended, o_orderstatus = 'F' AS finished, {_URL}, o_orderkey AS seq FROM orders""",
    ),
    "payloads": (
        (),
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_custkey,
  CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('job-', CAST(o_orderkey AS VARCHAR)) END AS name,
  o_orderdate AS timestamp, {_URL}, {_PRIORITY} FROM orders""",
    ),
    "payload_steps": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 1 AS id, 'clone' AS name, concat('img-', CAST(o_custkey % 20 AS VARCHAR)) AS image,
    concat('export DEPLOY_SECRET=v-', CAST(o_orderkey AS VARCHAR), '; svn checkout https://bot:p', CAST(o_custkey AS VARCHAR), '@code.example/tree') AS script,
    o_custkey % 2 = 0 AS continue_on_error, o_custkey % 5 AS cpu_limit,
    CASE o_custkey % 8 WHEN 0 THEN '512M' WHEN 1 THEN '2G' WHEN 2 THEN '1g' WHEN 3 THEN '' WHEN 4 THEN '3G' WHEN 5 THEN '1G'
      WHEN 6 THEN '640M' ELSE '256m' END AS memory_limit,
    CASE o_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'bad net' WHEN 2 THEN 'my-net' ELSE '' END AS network,
    '' AS memory_swap, o_custkey % 9 - 1 AS pids_limit FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'test', concat('img-', CAST(o_orderkey % 20 AS VARCHAR)),
    CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'make build' END, o_orderkey % 4 = 0, o_orderkey % 3,
    CASE o_orderkey % 5 WHEN 0 THEN '1K' WHEN 1 THEN '' ELSE '1G' END, '',
    CASE o_custkey % 4 WHEN 0 THEN '1G' WHEN 1 THEN '4G' WHEN 2 THEN '512M' ELSE '' END, 0 FROM orders""",
    ),
    # Metadata in long form: step 0 is the job level.
    "payload_meta": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 0 AS step_id, 'GIT_PASSWORD' AS key,
    CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('pw', CAST(o_custkey AS VARCHAR)) END AS value FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 'BRANCH', concat('b', CAST(o_custkey % 3 AS VARCHAR)) FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 'CONN', CASE o_custkey % 3 WHEN 0 THEN concat('amqp://svc:q', CAST(o_custkey AS VARCHAR), '@bus.local:5671')
    ELSE 'amqp://bus.local:5671' END FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 0, 'BLOB', CASE o_orderkey % 4 WHEN 0 THEN md5(CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN repeat('ab', 20)
    WHEN 2 THEN '-----BEGIN SAMPLE-----' ELSE 'aGVhZGVy.cGF5bG9h.c2lnbmF0' END FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'BRANCH', concat('s', CAST(o_custkey % 2 AS VARCHAR)) FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'JOB_NAME', 'mine' FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'TOKEN', 't' FROM orders WHERE o_orderkey % 2 = 0""",
    ),
    "executions": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, concat('ns-', CAST(o_custkey % 8 AS VARCHAR)) AS namespace,
  concat('cust-', CAST(o_custkey % 50 AS VARCHAR)) AS parent, o_orderpriority, o_custkey, o_orderkey, o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 ELSE 1 END AS own,
  o_orderdate AS created_at, o_orderstatus = 'P' AS suspended, o_orderstatus = 'F' AS finished FROM orders""",
    ),
    "parents": (
        (),
        """SELECT concat('ns-', CAST(k % 8 AS VARCHAR)) AS namespace, concat('cust-', CAST(k % 50 AS VARCHAR)) AS name,
  greatest(k % 7, 1) AS up FROM (SELECT DISTINCT c_custkey % 200 AS k FROM customer) WHERE k % 50 < 40""",
    ),
    "prioritized": (
        ("executions", "parents"),
        """SELECT e.*, CASE WHEN own <> 1 THEN own ELSE coalesce(up, 1) END AS priority
  FROM executions e LEFT JOIN parents p ON e.namespace = p.namespace AND e.parent = p.name""",
    ),
    "queue": (
        (),
        """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, concat('q-', CAST(o_custkey % 4 AS VARCHAR)) AS queue,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  o_orderkey AS seq, o_orderdate AS enqueued_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_seconds(o_custkey) END AS dispatched_at FROM orders""",
    ),
    "step_rows": ((), f"SELECT {_STEP_COLUMNS} FROM lineitem"),
    "steps": (
        (),
        f"""SELECT {_STEP_COLUMNS}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS step_id FROM lineitem""",
    ),
    "containers": (
        ("steps",),
        """SELECT job_id, concat('step-', CAST(step_id AS VARCHAR)) AS name, step_id, image, raw_state, exit_code,
  CASE raw_state WHEN 'waiting' THEN 'Pending' WHEN 'running' THEN 'Running' ELSE CASE WHEN exit_code = 0 THEN 'Succeeded' ELSE 'Failed' END END AS state,
  waiting_reason, logs_published, step_id > 6 AS is_app, CASE WHEN step_id > 6 THEN step_id - 7 ELSE step_id - 1 END AS idx FROM steps""",
    ),
    "lines": (
        (),
        """SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents""",
    ),
    "raw_lines": (
        ("lines",),
        """SELECT CAST(doc_id AS VARCHAR) AS job_id, 'step-1' AS container_id,
  CASE WHEN line_no % 5 = 0 THEN 'stderr' ELSE 'stdout' END AS stream, line_no,
  CASE line_no % 4 WHEN 0 THEN line WHEN 1 THEN concat('2024-01-01T00:00:01Z ', line)
    WHEN 2 THEN concat('2024-01-01T00:00:02Z time="2024-01-01T00:01:00.5Z" level="info" msg="', line, '"')
    ELSE concat('set MAIL_PASSWORD=mp-', CAST(doc_id AS VARCHAR), '; fetch sftp://bob:open1@files/app ', line) END AS line FROM lines""",
    ),
}
