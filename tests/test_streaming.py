"""Streams on small fixtures: restarts, replays and clocks."""

import time
from datetime import datetime, timedelta, timezone

from jobtrail.operators import logs as G
from jobtrail.streaming import jobs as J
from jobtrail.streaming import state as K

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT = "job_id string, status string, reason string, ts timestamp, seq long"
NOW = {"availableNow": True}


def put(spark, path, *rows, schema=EVENT):
    """Append one file of rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def ev(job, status, second, seq=None, reason=""):
    return (job, status, reason, T0 + timedelta(seconds=second), seq if seq is not None else second)


def stream(spark, path, schema=EVENT):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_a_restarted_query_goes_on_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, ev("a", "Queued", 0), ev("a", "Running", 1))
    run(J.start_updates(J.stream_lifecycle(stream(spark, src)), out, cp, NOW))
    put(spark, src, ev("a", "Failed", 5, reason="x"), ev("b", "Running", 6))
    run(J.start_updates(J.stream_lifecycle(stream(spark, src)), out, cp, NOW))
    got = {r.job_id: (r.status, r.reason, r.started_at, r.finished_at) for r in J.latest(spark, out).collect()}
    naive = lambda s: (T0 + timedelta(seconds=s)).replace(tzinfo=None)
    assert got == {"a": ("Failed", "x", naive(1), naive(5)), "b": ("Running", "", naive(6), None)}


def test_completion_is_emitted_once_and_only_after_running(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, ev("a", "Running", 0), ev("b", "Queued", 1))
    put(spark, src, ev("a", "Succeeded", 10), ev("b", "Failed", 11))
    put(spark, src, ev("late", "Queued", 100))
    put(spark, src, ev("a", "Failed", 120), ev("late", "Running", 200))
    put(spark, src, ev("late", "Queued", 400))
    run(J.start_append(K.stream_completions(stream(spark, src)), out, cp, NOW))
    rows = spark.read.parquet(out).collect()
    assert [(r.job_id, r.completed_at) for r in rows] == [("a", (T0 + timedelta(seconds=10)).replace(tzinfo=None))]


def test_a_slow_log_stream_holds_completion_back(spark, tmp_path):
    src, logs, out, cp = (str(tmp_path / x) for x in ("src", "logs", "out", "cp"))
    put(spark, src, ev("a", "Running", 0), ev("a", "Succeeded", 10), ev("b", "Queued", 500))
    put(spark, logs, (T0 + timedelta(seconds=5),), schema="ts timestamp")
    ready = lambda: K.stream_completions(stream(spark, src), stream(spark, logs, "ts timestamp"))
    run(J.start_append(ready(), out, cp, NOW))
    assert spark.read.schema("job_id string").parquet(out).count() == 0
    # A restarted query knows an input's time only once that input has brought a row.
    put(spark, src, ev("c", "Queued", 600))
    put(spark, logs, (T0 + timedelta(seconds=300),), schema="ts timestamp")
    run(J.start_append(ready(), out, cp, NOW))
    assert [r.job_id for r in spark.read.parquet(out).collect()] == ["a"]


def test_timeouts_fire_for_running_jobs_only(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, ev("a", "Running", 0), ev("b", "Running", 0), ev("c", "Running", 0))
    put(spark, src, ev("b", "Succeeded", 1))
    put(spark, src, ev("z", "Queued", 100))
    jobs = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0), ("z", 5)], "job_id string, timeout_seconds long")
    run(J.start_append(K.stream_timeouts(stream(spark, src), jobs), out, cp, NOW))
    assert [(r.job_id, r.reason) for r in spark.read.parquet(out).collect()] == [("a", "job timed out after 2 seconds")]


def test_expiry(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, ev("done", "Succeeded", 0), ev("open", "Running", 0))
    put(spark, src, ev("x", "Queued", 5000))
    summaries = K.stream_lifecycle_expiring(stream(spark, src), retention=3600, stale_ttl=86400)
    run(J.start_updates(summaries, out, cp, NOW))
    assert {r.job_id: r.is_expired for r in J.latest(spark, out).collect()} == {"done": True, "open": False, "x": False}


def test_thinning_keeps_the_fold(spark, views):
    from jobtrail.operators.lifecycle import lifecycle

    events = views.status_events("user")
    fold = lambda df: sorted(lifecycle(df).collect(), key=lambda r: r.job_id)
    thin = K.combine_events(events)
    assert thin.count() < events.count() / 5
    assert fold(thin) == fold(events)


def test_throughput_window_is_open_at_its_start(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [(T0 + timedelta(seconds=s),) for s in (0, 60, 61)]
    put(spark, src, *rows, schema="ts timestamp")
    put(spark, src, (T0 + timedelta(seconds=600),), schema="ts timestamp")
    run(J.start_append(J.stream_throughput(stream(spark, src, "ts timestamp"), "0 seconds", "1 minute", "1 minute"), out, cp, NOW))
    got = {int(r.window_end.replace(tzinfo=timezone.utc).timestamp() - T0.timestamp()): r.n for r in spark.read.parquet(out).collect()}
    assert got == {0: 1, 60: 1, 120: 1}


def test_repeats_are_dropped_within_the_gap_and_only_there(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    put(spark, src, ev("a", "Queued", 0), ev("a", "Queued", 30), ev("a", "Queued", 59))
    put(spark, src, ev("a", "Queued", 60), ev("b", "Queued", 300))
    put(spark, src, ev("a", "Queued", 310), ev("a", "Queued", 310, 999), ev("a", "Queued", 340))
    run(J.start_append(K.stream_dedup(stream(spark, src)), out, cp, NOW))
    rows = spark.read.parquet(out).where("job_id = 'a'").orderBy("ts").collect()
    assert [r.seq for r in rows] == [0, 60, 310]


# Results must not hang on where files are cut or in which order rows come within the watermark.

DAY = "1 day"
END = ("~end", "Queued", "", T0 + timedelta(days=400), 10**6)


def cuts(rows):
    """The same rows in one file, in one file each, and in shuffled files."""
    import random

    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    return [[rows], [[r] for r in rows], [mixed[i::3] for i in range(3)]]


def each_cut(spark, tmp_path, rows, build, schema=EVENT, end=END):
    """Output rows of a query for every way to cut its input; a last row closes the stream."""
    out = []
    for i, files in enumerate(cuts(rows)):
        src, dst, cp = (str(tmp_path / f"{x}{i}") for x in ("src", "out", "cp"))
        for file in files:
            put(spark, src, *file, schema=schema)
        put(spark, src, end, schema=schema)
        run(J.start_append(build(stream(spark, src, schema)), dst, cp, NOW))
        out.append(sorted(tuple(r) for r in spark.read.parquet(dst).where("job_id <> '~end'").collect()))
    return out


def test_dedup_is_in_the_order_of_time(spark, tmp_path):
    rows = [ev("a", "Queued", s) for s in (0, 300, 100, 130, 159, 160, 330, 365)]
    got = each_cut(spark, tmp_path, rows, lambda s: K.stream_dedup(s, watermark=DAY))
    assert got[0] == got[1] == got[2] and [r[4] for r in got[0]] == [0, 100, 160, 300, 365]


def test_completions_are_in_the_order_of_time(spark, tmp_path):
    rows = [ev("a", "Succeeded", 10), ev("a", "Running", 5), ev("b", "Failed", 3), ev("b", "Running", 4), ev("a", "Failed", 12)]
    rows += [ev("a", "Queued", 1), ev("a", "Running", 20), ev("a", "Running", 21), ev("a", "Stopped", 30)]
    got = each_cut(spark, tmp_path, rows, lambda s: K.stream_completions(s, watermark=DAY))
    naive = lambda s: (T0 + timedelta(seconds=s)).replace(tzinfo=None)
    assert got[0] == got[1] == got[2] == [("a", naive(1), naive(10), False), ("a", naive(1), naive(30), False)]


def test_limits_count_ends_at_or_before_them_only(spark, tmp_path):
    rows = [ev("late end", "Running", 0), ev("late end", "Succeeded", 100), ev("in time", "Running", 0), ev("in time", "Failed", 2)]
    rows += [ev("early end", "Failed", 0), ev("early end", "Running", 1), ev("none", "Running", 0), ev("open", "Running", 50)]
    rows += [ev("again", "Running", 0), ev("again", "Failed", 1), ev("again", "Running", 7), ev("again", "Running", 8)]
    jobs = [("late end", 2), ("in time", 2), ("early end", 2), ("none", 0), ("open", 2), ("again", 5)]
    static = spark.createDataFrame(jobs, "job_id string, timeout_seconds long")
    want = [("again", 12), ("early end", 3), ("late end", 2), ("open", 52)]
    for got in each_cut(spark, tmp_path, rows, lambda s: K.stream_timeouts(s, static, watermark=DAY)):
        assert [(r[0], (r[3] - T0.replace(tzinfo=None)).seconds) for r in got] == want
    # The same with the jobs as a stream, told after the runs have begun.
    src = str(tmp_path / "jobs")
    put(spark, src, *[(j, t, T0 + timedelta(seconds=9)) for j, t in jobs], ("~end", 0, END[3]), schema="job_id string, timeout_seconds long, ts timestamp")
    live = lambda: stream(spark, src, "job_id string, timeout_seconds long, ts timestamp")
    for got in each_cut(spark, tmp_path / "live", rows, lambda s: K.stream_timeouts(s, live(), watermark=DAY)):
        assert [(r[0], (r[3] - T0.replace(tzinfo=None)).seconds) for r in got] == want


def test_payloads_written_after_the_start_resolve(spark, tmp_path):
    src, payloads, ok, bad, cp = (str(tmp_path / x) for x in ("src", "payloads", "ok", "bad", "cp"))
    row = lambda n: (f"00000000-0000-0000-0000-00000000000{n}", n, T0)
    text = lambda n: (f"00000000-0000-0000-0000-00000000000{n}", '{"id": "x", "name": "n"}')
    put(spark, payloads, text(1), schema="job_id string, value string")
    put(spark, src, row(1), row(2), schema="raw_id string, seq long, ts timestamp")
    start = lambda: J.start_split_rejects(stream(spark, src, "raw_id string, seq long, ts timestamp"), table, ok, bad, cp, NOW)
    table = lambda s: s.read.parquet(payloads)
    run(start())
    put(spark, payloads, text(3), schema="job_id string, value string")
    put(spark, src, row(3), ("no id", 4, T0), schema="raw_id string, seq long, ts timestamp")
    run(start())
    assert sorted(r.seq for r in spark.read.parquet(ok).collect()) == [1, 3]
    assert sorted((r.seq, r.reject) for r in spark.read.parquet(bad).collect()) == [(2, "missing_payload"), (4, "bad_id")]


def test_queue_depth_follows_the_tables(spark, tmp_path):
    src, queue, state, out, cp = (str(tmp_path / x) for x in ("src", "queue", "state", "out", "cp"))
    schema = "job_id string, priority string"
    put(spark, queue, ("a", "high"), schema=schema)
    none = lambda s: s.createDataFrame([], schema)
    go = lambda: run(J.start_metrics(stream(spark, src), lambda s: s.read.parquet(queue), none, state, out, cp, NOW))
    put(spark, src, ev("a", "Queued", 0))
    go()
    put(spark, queue, ("b", "low"), ("c", "low"), schema=schema)
    put(spark, src, ev("b", "Running", 5))
    go()
    rows = spark.read.parquet(out).where("metric = 'queue_depth'")
    last = rows.agg({"batch_id": "max"}).first()[0]
    got = {r.dimension: r.value for r in rows.where(rows.batch_id == last).collect()}
    assert got == {"high": 1, "medium": 0, "low": 2, "total": 3}


def test_logs_are_in_the_table_however_late(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "job_id string, container_id string, seq long, ts timestamp, logs array<struct<timestamp: timestamp, message: string, output_stream: string>>"
    batch = lambda n, day: ("j", "c", n, T0 + timedelta(days=day), [(T0 + timedelta(days=day), f"m{n}", "stdout"), (T0, f"e{n}", "stderr")])
    put(spark, src, batch(1, 30), schema=schema)
    put(spark, src, batch(2, 0), batch(1, 30), schema=schema)
    run(J.start_logs(stream(spark, src, schema), out, cp, NOW))
    assert sorted(r.message for r in J.read_logs(spark, out).collect()) == ["e1", "e2", "m1", "m2"]
    stored = sorted(J.stored_batches(spark.read.parquet(out)).collect(), key=lambda r: r.seq)
    assert [[e.message for e in r.logs] for r in stored] == [["m1", "e1"], ["m2", "e2"]]


ENTRY = "job_id string, container_id string, seq long, pos int, ts timestamp, message string"


def test_batches_of_a_stream_equal_the_batch_form(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    entry = lambda i, second, box="c": ("j", box, i, i % 3, T0 + timedelta(seconds=second), f"m{i}")
    ready = lambda: J.start_append(K.stream_batches(stream(spark, src, ENTRY), 3, 2, "1 second", 4), out, cp, NOW)
    # Out of order inside a file, ticks of two seconds that lie across files, a restart in an open tick.
    put(spark, src, *[entry(i, s) for i, s in enumerate([1.9, 0.1, 0.2, 0.3, 1, 0.5, 2.5])], entry(7, 0.4, "d"), schema=ENTRY)
    put(spark, src, *[entry(10 + i, 2 + i / 10) for i in range(15)], schema=ENTRY)
    run(ready())
    assert {r.batch_tick - T0.timestamp() // 2 for r in spark.read.schema("batch_tick long").parquet(out).collect()} <= {0}
    put(spark, src, *[entry(40 + i, 3.9) for i in range(4)], entry(50, 5, None), schema=ENTRY)
    put(spark, src, entry(99, 1000), schema=ENTRY)
    run(ready())
    fields = ["container_id", "seq", "batch_tick", "batch_id"]
    want = G.assign_batches(spark.read.schema(ENTRY).parquet(src).where("seq < 99"), 3, 2)
    listed = lambda df: sorted(map(str, df.select(*fields).collect()))
    assert listed(spark.read.parquet(out)) == listed(want) and want.count() == 28


def test_expiry_of_many_jobs(spark, tmp_path):
    """Jobs share calls and timers: thousands are folded over three batches as the batch form folds them, and let go
    each at its own time."""
    from jobtrail.operators.lifecycle import lifecycle

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    n = 4000
    phases = [("Queued", 0, ""), ("Running", 100, "r"), ("Failed", 200, "")]
    for at, (status, second, reason) in enumerate(phases):
        put(spark, src, *[ev(f"j{i}", status, second + i % 50, at, reason) for i in range(n) if at < 2 or i % 2])
    put(spark, src, ev("end", "Queued", 5000))
    summaries = K.stream_lifecycle_expiring(stream(spark, src), "300 seconds", retention=3600, stale_ttl=86400, buckets=4)
    t0 = time.time()
    query = J.start_updates(summaries, out, cp, NOW)
    run(query)
    assert time.time() - t0 < 60
    # One state per bucket, not per job.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4
    got = J.latest(spark, out).collect()
    columns = ["job_id", "status", "reason", "queued_at", "started_at", "finished_at", "updated_at"]
    want = {tuple(r) for r in lifecycle(spark.read.parquet(src)).select(*columns).collect()}
    assert {tuple(r[c] for c in columns) for r in got} == want
    assert {r.job_id for r in got if r.is_expired} == {f"j{i}" for i in range(n) if i % 2}
