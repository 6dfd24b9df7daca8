"""Entity views over the driver's tables (see FIXTURES.md). Every view reads its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtrail.session import configure
from jobtrail.sources.tables import split_lines


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def as_of(self):
        return F.lit("2024-01-31 00:00:00").cast("timestamp")

    # --- events ----------------------------------------------------------------------------

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    # Job ids of event rows: one job per user and day, the same as a number (these are order keys too), or
    # one job per user.
    _EVENT_KEYS = {
        "day": "concat(user_id, '-', CAST(ts AS DATE))",
        "order": "CAST(user_id * 30 + day(ts) - 1 AS STRING)",
        "user": "CAST(user_id AS STRING)",
    }

    def status_events(self, key: str = "day") -> DataFrame:
        return self.spark.sql(
            f"""
            SELECT {self._EVENT_KEYS[key]} AS job_id,
              CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Succeeded'
                              WHEN 'error' THEN 'Failed' ELSE 'Stopped' END AS status,
              CASE WHEN event_type = 'error' THEN props ELSE '' END AS reason, ts, event_id AS seq
            FROM {{events}}
            """,
            events=self.events(),
        )

    def enqueues(self) -> DataFrame:
        """Submissions of jobs, some of which never send an event."""
        return self.spark.sql(
            """
            SELECT CASE WHEN event_id % 3 = 0 THEN concat('new-', event_id)
                        ELSE concat(user_id, '-', CAST(ts AS DATE)) END AS job_id,
              concat('job-', event_id) AS name,
              CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority,
              event_id % 6 AS step_count, ts - INTERVAL 1 HOUR AS ts, event_id AS seq
            FROM {events} WHERE event_type = 'signup'
            """,
            events=self.events(),
        )

    def log_entries(self, key: str = "user") -> DataFrame:
        return self.spark.sql(
            f"""
            SELECT {self._EVENT_KEYS[key]} AS job_id, event_type AS container_id, event_id AS seq, 0 AS pos, ts,
              props AS message, CASE WHEN event_id % 5 = 0 THEN 'stderr' ELSE 'stdout' END AS output_stream
            FROM {{events}}
            """,
            events=self.events(),
        )

    def log_batches(self, key: str = "user") -> DataFrame:
        """One batch per event: errors repeat their line on stderr, sign-ups only register the container."""
        return self.spark.sql(
            f"""
            SELECT {self._EVENT_KEYS[key]} AS job_id, event_type AS container_id, event_id AS seq, ts,
              CASE event_type
                WHEN 'signup' THEN NULL
                WHEN 'error' THEN array(
                  named_struct('timestamp', ts, 'message', props, 'output_stream', 'stdout'),
                  named_struct('timestamp', ts, 'message', props, 'output_stream', 'stderr'))
                ELSE array(named_struct('timestamp', ts, 'message', props, 'output_stream', 'stdout')) END AS logs
            FROM {{events}}
            """,
            events=self.events(),
        )

    def attempts(self) -> DataFrame:
        return self.spark.sql(
            """
            SELECT CAST(user_id AS STRING) AS key, ts, event_id AS seq, event_type = 'signup' AS ok
            FROM {events} WHERE event_type IN ('signup', 'error')
            """,
            events=self.events(),
        )

    def job_facts(self) -> DataFrame:
        """Name and step count of some of the jobs seen in events."""
        bought = self.status_events().where(F.col("status") == "Stopped")
        return bought.groupBy("job_id").agg(
            F.concat(F.lit("pay-"), F.min("seq").cast("string")).alias("name"), F.count(F.lit(1)).alias("step_count")
        )

    # --- orders ----------------------------------------------------------------------------

    def jobs(self) -> DataFrame:
        return self.spark.sql(
            """
            SELECT CAST(o_orderkey AS STRING) AS job_id,
              CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('job-', o_orderkey) END AS name,
              CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2
                WHEN '5-LOW' THEN 1 END AS priority,
              concat('ns-', o_custkey % 8) AS namespace, CAST(o_orderdate AS TIMESTAMP) AS submitted_at,
              o_orderstatus = 'P' AS suspended, o_orderstatus = 'F' AS finished,
              CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'ftp://h.example/x' WHEN 2 THEN 'http:///path'
                WHEN 3 THEN 'https://user:tok@h_x/logs?s=1#f' WHEN 4 THEN '/relative'
                ELSE 'https://host.example:8443/logs' END AS callback_url,
              CASE WHEN o_orderkey % 11 = 0 THEN CAST(-5 AS BIGINT)
                ELSE CAST((o_orderkey % 5) * 600 AS BIGINT) END AS timeout_seconds,
              o_orderkey AS seq
            FROM {orders}
            """,
            orders=self.table("orders"),
        )

    def payloads(self) -> DataFrame:
        """Nested job rows, two steps each, built from one order row without grouping."""
        return self.spark.sql(
            """
            SELECT CAST(o_orderkey AS STRING) AS id,
              CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('job-', o_orderkey) END AS name,
              CAST(o_orderdate AS TIMESTAMP) AS timestamp,
              CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE map(
                'GIT_PASSWORD', CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('pw', o_custkey) END,
                'BRANCH', concat('b', o_custkey % 3),
                'CONN', CASE o_custkey % 3 WHEN 0 THEN concat('amqp://svc:q', o_custkey, '@bus.local:5671') ELSE 'amqp://bus.local:5671' END,
                'BLOB', CASE o_orderkey % 4 WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) WHEN 1 THEN repeat('ab', 20)
                        WHEN 2 THEN '-----BEGIN SAMPLE-----' ELSE 'aGVhZGVy.cGF5bG9h.c2lnbmF0' END) END AS metadata,
              array(
                named_struct('id', 1, 'name', 'clone', 'image', concat('img-', o_custkey % 20),
                  'script', concat('export DEPLOY_SECRET=v-', o_orderkey, '; svn checkout https://bot:p', o_custkey, '@code.example/tree'),
                  'continue_on_error', o_custkey % 2 = 0, 'metadata', map('BRANCH', concat('s', o_custkey % 2), 'JOB_NAME', 'mine'),
                  'cpu_limit', o_custkey % 5,
                  'memory_limit', CASE o_custkey % 8 WHEN 0 THEN '512M' WHEN 1 THEN '2G' WHEN 2 THEN '1g' WHEN 3 THEN ''
                    WHEN 4 THEN '3G' WHEN 5 THEN '1G' WHEN 6 THEN '640M' ELSE '256m' END,
                  'network', CASE o_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'bad net' WHEN 2 THEN 'my-net' ELSE '' END,
                  'memory_swap', '', 'pids_limit', o_custkey % 9 - 1),
                named_struct('id', 2, 'name', 'test', 'image', concat('img-', o_orderkey % 20),
                  'script', CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'make build' END,
                  'continue_on_error', o_orderkey % 4 = 0,
                  'metadata', CASE WHEN o_orderkey % 2 = 0 THEN map('TOKEN', 't') END,
                  'cpu_limit', o_orderkey % 3,
                  'memory_limit', CASE o_orderkey % 5 WHEN 0 THEN '1K' WHEN 1 THEN '' ELSE '1G' END,
                  'network', '',
                  'memory_swap', CASE o_custkey % 4 WHEN 0 THEN '1G' WHEN 1 THEN '4G' WHEN 2 THEN '512M' ELSE '' END,
                  'pids_limit', CAST(0 AS BIGINT))) AS steps,
              CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'ftp://h.example/x' WHEN 2 THEN 'http:///path'
                WHEN 3 THEN 'https://user:tok@h_x/logs?s=1#f' WHEN 4 THEN '/relative'
                ELSE 'https://host.example:8443/logs' END AS callback_url,
              CASE WHEN o_orderkey % 11 = 0 THEN CAST(-5 AS BIGINT)
                ELSE CAST((o_orderkey % 5) * 600 AS BIGINT) END AS timeout_seconds,
              CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2
                WHEN '5-LOW' THEN 1 END AS priority
            FROM {orders}
            """,
            orders=self.table("orders"),
        )

    def executions(self) -> DataFrame:
        """Executor records with conditions, one per order."""
        return self.spark.sql(
            """
            SELECT CAST(o_orderkey AS STRING) AS job_id, concat('ns-', o_custkey % 8) AS namespace,
              concat('cust-', o_custkey % 50) AS parent,
              CASE o_orderpriority WHEN '1-URGENT' THEN map('priority', ' 5 ') WHEN '2-HIGH' THEN map('priority', '3')
                WHEN '3-MEDIUM' THEN map('priority', 'two') WHEN '5-LOW' THEN map('team', 'x') END AS labels,
              CAST(o_orderdate AS TIMESTAMP) AS created_at,
              o_orderstatus = 'P' AS suspended, o_orderstatus = 'F' AS finished,
              CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 HOUR END AS completed_at,
              CASE o_orderstatus WHEN 'F' THEN array(
                  named_struct('type', 'Suspended', 'status', 'True', 'message', 's', 'transition_at', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR),
                  named_struct('type', 'Complete', 'status', CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END,
                    'message', 'ok', 'transition_at', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR),
                  named_struct('type', 'Failed', 'status', 'True',
                    'message', 'bad', 'transition_at', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 HOUR)) END AS conditions
            FROM {orders}
            """,
            orders=self.table("orders"),
        )

    def parents(self) -> DataFrame:
        """Parent records of executions with their own priority labels; some executions have no parent."""
        return self.spark.sql(
            """
            SELECT concat('ns-', k % 8) AS namespace, concat('cust-', k % 50) AS name,
              map('priority', CAST(k % 7 AS STRING)) AS labels
            FROM (SELECT DISTINCT c_custkey % 200 AS k FROM {customer}) t
            WHERE k % 50 < 40
            """,
            customer=self.table("customer"),
        )

    def queue(self) -> DataFrame:
        """Queue rows; every order that is still open waits."""
        return self.spark.sql(
            """
            SELECT CAST(o_orderkey AS STRING) AS job_id, concat('q-', o_custkey % 4) AS queue,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
                ELSE 'low' END AS priority,
              o_orderkey AS seq, CAST(o_orderdate AS TIMESTAMP) AS enqueued_at,
              CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, 0, 0, CAST(o_custkey AS DECIMAL(18, 6))) END AS dispatched_at
            FROM {orders}
            """,
            orders=self.table("orders"),
        )

    def dispatched(self) -> DataFrame:
        return self.queue().where(F.col("dispatched_at").isNotNull()).select("job_id")

    # --- lineitem --------------------------------------------------------------------------

    def step_rows(self) -> DataFrame:
        """Steps without a number: nothing is shuffled."""
        return self.spark.sql(
            """
            SELECT CAST(l_orderkey AS STRING) AS job_id, concat('img-', l_partkey % 20) AS image,
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
              l_suppkey % 2 = 0 AS logs_published,
              l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax
            FROM {lineitem}
            """,
            lineitem=self.table("lineitem"),
        ).drop("l_orderkey")

    _STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"]

    def steps(self) -> DataFrame:
        """Steps numbered from 1 inside their job. An order has a handful of lines, so a plain window will do."""
        number = F.row_number().over(W.partitionBy("job_id").orderBy(*self._STEP_ORDER))
        return self.step_rows().withColumn("step_id", number).drop(*self._STEP_ORDER)

    def containers(self) -> DataFrame:
        """Container states: the last two line numbers act as app containers."""
        app = F.col("step_id") > 6
        state = (
            F.when(F.col("raw_state") == "waiting", "Pending")
            .when(F.col("raw_state") == "running", "Running")
            .when(F.col("exit_code") == 0, "Succeeded")
            .otherwise("Failed")
        )
        return self.steps().select(
            "job_id",
            F.concat(F.lit("step-"), F.col("step_id").cast("string")).alias("name"),
            "step_id",
            "image",
            "raw_state",
            "exit_code",
            state.alias("state"),
            "waiting_reason",
            "logs_published",
            app.alias("is_app"),
            F.when(app, F.col("step_id") - 7).otherwise(F.col("step_id") - 1).alias("idx"),
        )

    # --- documents -------------------------------------------------------------------------

    def raw_lines(self) -> DataFrame:
        docs = split_lines(self.table("documents"), "text", "doc_id")
        return self.spark.sql(
            """
            SELECT CAST(doc_id AS STRING) AS job_id, 'step-1' AS container_id,
              CASE WHEN line_no % 5 = 0 THEN 'stderr' ELSE 'stdout' END AS stream, line_no,
              CASE line_no % 4 WHEN 0 THEN line
                WHEN 1 THEN concat('2024-01-01T00:00:01Z ', line)
                WHEN 2 THEN concat('2024-01-01T00:00:02Z time="2024-01-01T00:01:00.5Z" level="info" msg="', line, '"')
                ELSE concat('set MAIL_PASSWORD=mp-', doc_id, '; fetch sftp://bob:open1@files/app ', line) END AS line
            FROM {lines}
            """,
            lines=docs,
        )
