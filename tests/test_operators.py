"""Operators on small fixtures: reference behaviour, block borders, and invariances."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from jobtrail import schemas as S
from jobtrail.operators import admission as A
from jobtrail.operators import execution as E
from jobtrail.operators import lifecycle as L
from jobtrail.operators import logs as G
from jobtrail.operators import metrics as M
from jobtrail.operators import ordered
from jobtrail.sources import tables as T

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT = "job_id string, status string, reason string, ts timestamp, seq long"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def naive(seconds):
    return at(seconds).replace(tzinfo=None)


def events(spark, *rows):
    """rows: (job, status, reason) one second apart."""
    return spark.createDataFrame([(j, s, r, at(i), i) for i, (j, s, r) in enumerate(rows)], EVENT)


# --- lifecycle -----------------------------------------------------------------------------


def test_last_status_wins_and_the_reason_sticks(spark):
    df = events(spark, ("a", "Queued", ""), ("a", "Running", ""), ("a", "Failed", "ImagePullBackOff"), ("a", "Running", ""), ("a", "Failed", ""), ("", "Queued", ""), ("b", "nope", ""))
    (row,) = L.lifecycle(df).collect()
    assert (row.job_id, row.status, row.reason) == ("a", "Failed", "ImagePullBackOff")
    assert (row.queued_at, row.started_at, row.finished_at, row.updated_at) == (naive(0), naive(1), naive(2), naive(4))


def test_enqueue_without_events_is_queued(spark):
    enq = spark.createDataFrame([("a", "n", "high", 2, at(5), 1)], "job_id string, name string, priority string, step_count long, ts timestamp, seq long")
    (row,) = L.lifecycle_with_enqueue(spark.createDataFrame([], EVENT), enq).collect()
    assert (row.status, row.name, row.priority, row.step_count, row.queued_at) == ("Queued", "n", "high", 2, naive(5))


def test_fold_does_not_depend_on_row_order(views):
    ev = views.status_events()
    a = {r.job_id: r for r in L.lifecycle(ev).collect()}
    b = {r.job_id: r for r in L.lifecycle(ev.repartition(7, "reason").orderBy(F.rand(3))).collect()}
    assert a == b


@pytest.mark.parametrize("n,want", [(1, 1), (19, 19), (20, 19), (21, 20), (100, 95), (1001, 951)])
@pytest.mark.parametrize("width", [7, 60000])
def test_p95_is_nearest_rank(spark, n, want, width):
    values = list(range(1, n + 1))
    random.Random(n).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert ordered.nearest_rank(df, [], "x", 0.95, "p", width).collect()[0].p == want


def test_durations(spark):
    done = [(f"j{i}", at(0), at((i + 1) / 1000)) for i in range(20)] + [("open", at(0), None), ("never", None, at(9))]
    df = spark.createDataFrame(done, "job_id string, started_at timestamp, finished_at timestamp")
    (row,) = M.duration_summary(df).collect()
    assert (row.avg_ms, row.p95_ms, row.n) == (10, 19, 20)
    (none,) = M.duration_summary(df.where("job_id = 'open'")).collect()
    assert (none.avg_ms, none.p95_ms, none.n) == (0, 0, 0)


def test_mean_truncates_toward_zero(spark):
    df = spark.createDataFrame([("a", at(0.007), at(0)), ("b", at(0), at(0))], "job_id string, started_at timestamp, finished_at timestamp")
    assert M.duration_summary(df).collect()[0].avg_ms == -3


def test_sweep(spark):
    rows = [("done-old", "Succeeded", at(0)), ("done-new", "Failed", at(3600)), ("open", "Running", at(0)), ("edge", "Stopped", at(100))]
    df = spark.createDataFrame(rows, "job_id string, status string, updated_at timestamp")
    kept = lambda as_of, **kw: sorted(r.job_id for r in L.sweep(df, F.lit(at(as_of)), **kw).collect())
    assert kept(3700) == ["done-new", "edge", "open"]
    assert kept(3700, retention=0) == ["done-new", "edge", "open"]
    assert kept(86401) == []


def test_list_cut_comes_first_and_missing_time_is_last(spark):
    rows = [("a", "Queued", "", 0, None, None, at(1)), ("b", "Running", "", 0, None, at(5), at(1)), ("c", "Failed", "named", 3, at(2), at(9), None), ("d", "Queued", "", 0, None, None, None)]
    df = spark.createDataFrame(rows, "job_id string, status string, name string, step_count long, finished_at timestamp, started_at timestamp, queued_at timestamp")
    jobs = spark.createDataFrame([("b", "bee", 2), ("c", "cee", 9)], "job_id string, name string, step_count long")
    got = [(r.job_id, r.name, r.step_count) for r in L.job_list(df, jobs, n=3).collect()]
    assert got == [("b", "bee", 2), ("c", "named", 3), ("a", "", 0)]
    assert [r.job_id for r in L.job_list(df, jobs, "queued").collect()] == ["a", "d"]


def list_of(spark, *rows):
    return spark.createDataFrame([(j, s, n, i) for i, (j, s, n) in enumerate(rows)], "job_id string, status string, name string, position long")


def feed(spark, *rows):
    return spark.createDataFrame([(j, s, n, i) for i, (j, s, n) in enumerate(rows)], "job_id string, status string, name string, seq long")


def test_live_list(spark):
    one = list_of(spark, ("a", "Running", "a"))
    ids = lambda df: [r.job_id for r in df.collect()]
    assert ids(L.upsert_summaries(one, feed(spark, ("b", "Queued", "b")))) == ["b", "a"]
    assert ids(L.upsert_summaries(one, feed(spark, ("a", "Succeeded", None)), "Running")) == []
    assert ids(L.upsert_summaries(one, feed(spark, ("c", "Running", "c"), ("x", "Failed", "x")), "Running")) == ["c", "a"]
    (merged,) = L.upsert_summaries(one, feed(spark, ("a", "Failed", None))).collect()
    assert (merged.status, merged.name) == ("Failed", "a")
    # Out of the filter and back in one batch: on top, with what came since.
    two = list_of(spark, ("a", "Running", "old"), ("b", "Running", "b"))
    back = L.upsert_summaries(two, feed(spark, ("b", "Failed", "x"), ("b", "Running", "again"), ("b", "Running", None), ("a", "Failed", None)), "Running").collect()
    assert [(r.job_id, r.name) for r in back] == [("b", "again")]
    fields = L.upsert_summaries(two, feed(spark, ("a", "Running", "new"), ("a", "Running", None))).collect()
    assert [(r.job_id, r.name) for r in fields] == [("a", "new"), ("b", "b")]
    many = list_of(spark, *[(f"j{i}", "Queued", "") for i in range(500)])
    full = ids(L.upsert_summaries(many, feed(spark, ("new", "Queued", ""))))
    assert len(full) == 500 and full[0] == "new" and "j499" not in full


def test_topics(spark):
    df = spark.createDataFrame([("logs.a",), ("logs.a.b",), ("logs.",), ("xlogs.a",), ("logsxa",)], "topic string")
    assert [r.topic for r in L.filter_topic(df, "logs.*").collect()] == ["logs.a"]
    assert [r.topic for r in L.filter_topic(df, "logs.a.b").collect()] == ["logs.a.b"]


# --- blocks --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows belong to one key."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.66 else f"k{rng.randrange(40)}", i, rng.randrange(1000)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, seq long, v long")


@pytest.mark.parametrize("block", [1, 37, 500, 10**6])
def test_numbering_across_blocks(skewed, block):
    rows, df = skewed
    want, seen = {}, {}
    for k, seq, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        want[seq] = seen[k]
    got = ordered.numbered(df, ["k"], ["seq"], [ordered.seq_block("seq", block)]).collect()
    assert {r.seq: r.rn for r in got} == want
    tail = ordered.numbered(df, ["k"], ["seq"], [ordered.seq_block("seq", block)], desc=True, upto=9).collect()
    assert {r.seq: r.rn for r in tail} == {s: seen[k] - want[s] + 1 for k, s, _ in rows if seen[k] - want[s] < 9}


@pytest.mark.parametrize("block", [1, 37, 10**6])
def test_previous_row_and_running_sum_across_blocks(skewed, block):
    rows, df = skewed
    blocks = [ordered.seq_block("seq", block)]
    last, want = {}, {}
    for k, seq, v in rows:
        want[seq] = last.get(k)
        last[k] = v
    assert {r.seq: r.p for r in ordered.lagged(df, ["k"], ["seq"], {"p": "v"}, blocks).collect()} == want
    total, sums, top, tops = {}, {}, {}, {}
    for k, seq, v in rows:
        sums[seq] = total[k] = total.get(k, 0) + v
        tops[seq] = top[k] = max(top.get(k, -1), v)
    got = ordered.running(df, ["k"], ["seq"], "v", blocks, "s", F.sum, lambda a, b: a + b).collect()
    assert {r.seq: r.s for r in got} == sums
    assert {r.seq: r.s for r in ordered.running(df, ["k"], ["seq"], "v", blocks, "s").collect()} == tops


@pytest.mark.parametrize("block", [1, 37, 10**6])
def test_newest_rows(skewed, block):
    rows, df = skewed
    assert [r.seq for r in ordered.newest(df, ["seq"], 100, ordered.seq_block("seq", block)).collect()] == list(range(2999, 2899, -1))


def test_hot_key_is_spread_over_tasks(skewed):
    """The window runs inside (key, block): its partitioning must hold the block, not the key alone."""
    _, df = skewed
    plan = ordered.numbered(df, ["k"], ["seq"], [ordered.seq_block("seq", 500)])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("_b0" in line and "k#" in line for line in exchanges)


# --- logs ----------------------------------------------------------------------------------

BATCH = "job_id string, container_id string, seq long, logs array<struct<timestamp: timestamp, message: string, output_stream: string>>"


def batches(spark, *rows):
    return spark.createDataFrame(
        [("j", c, i, None if texts is None else [(at(i), t, "stdout") for t in texts]) for i, (c, texts) in enumerate(rows)], BATCH
    )


def messages(df):
    return [(r.container_id, [e.message for e in r.entries]) for r in df.orderBy("slot").collect()]


def test_interleaved_containers_coalesce_in_first_seen_order(spark):
    df = batches(spark, ("c1", ["a"]), ("c2", ["b"]), ("c1", ["c", "d"]), ("c3", ["e"]), ("c2", ["f"]), ("", ["lost"]))
    assert messages(G.coalesce_logs(df)) == [("c1", ["a", "c", "d"]), ("c2", ["b", "f"]), ("c3", ["e"])]


@pytest.mark.parametrize("empty", [None, []])
def test_an_empty_batch_keeps_its_slot(spark, empty):
    df = batches(spark, ("c1", empty), ("c2", ["b"]))
    boxes = G.coalesce_logs(df)
    assert messages(boxes) == [("c1", []), ("c2", ["b"])]
    (step,) = G.step_log_at(G.job_documents(df), 1).collect()
    assert step.container_id == "c2"


def test_trim_keeps_the_last_entries(spark):
    df = batches(spark, *[("c", [f"l{i}"]) for i in range(13)])
    assert messages(G.coalesce_logs(df, 2)) == [("c", ["l11", "l12"])]
    lines = G.ordered_lines(df, 2).orderBy("line_no").collect()
    assert [(r.line_no, r.message) for r in lines] == [(0, "l11"), (1, "l12")]
    assert messages(G.coalesce_logs(df, 0)) == [("c", [f"l{i}" for i in range(13)])]
    pieces = G.coalesce_logs(df, 0, piece_lines=5).orderBy("piece").collect()
    assert [(r.piece, r.pieces, len(r.entries), r.n_entries) for r in pieces] == [(0, 3, 5, 13), (1, 3, 5, 13), (2, 3, 3, 13)]
    assert G.ordered_lines(df, 0).count() == 13


def test_coalescing_does_not_depend_on_batch_splits(spark):
    texts = [f"m{i}" for i in range(12)]
    whole = batches(spark, ("c", texts))
    split = batches(spark, *[("c", texts[i : i + 5]) for i in range(0, 12, 5)])
    assert messages(G.coalesce_logs(whole, 7)) == messages(G.coalesce_logs(split, 7)) == [("c", texts[-7:])]


def test_long_documents_come_in_parts(spark):
    df = batches(spark, *[(f"c{i:03d}", [str(i)]) for i in range(10)])
    docs = G.job_documents(df, part_lines=8).orderBy("part").collect()
    assert [len(d.containers) for d in docs] == [4, 4, 2] and [(d.part, d.parts) for d in docs] == [(0, 3), (1, 3), (2, 3)]
    assert [c.container_id for d in docs for c in d.containers] == [f"c{i:03d}" for i in range(10)]


def test_log_tail(spark):
    df = batches(spark, ("c1", ["a", "b"]), ("c2", ["c"]), ("c1", ["d"]), ("c3", None))
    got = G.log_tail(df, 2).orderBy("slot", "line_no").collect()
    assert [(r.container, r.line_no, r.message, r.total) for r in got] == [("c1", 2, "d", 4), ("c2", 0, "c", 4)]


def test_replayed_entries_count_once(spark):
    rows = [("j", "c", s, 0, at(t), m, o) for s, t, m, o in [(0, 1, "a", "stdout"), (1, 2, "b", "stdout"), (2, 1, "a", "stdout"), (3, 3, "c", "stdout"), (4, 1, "a", "stderr")]]
    df = spark.createDataFrame(rows, "job_id string, container_id string, seq long, pos int, ts timestamp, message string, output_stream string")
    assert [(r.seq, r.message) for r in G.dedup_replay(df).orderBy("seq").collect()] == [(0, "a"), (1, "b"), (3, "c"), (4, "a")]


def test_completions_need_a_running_before_the_end(spark):
    df = events(
        spark, ("a", "Running", ""), ("a", "Succeeded", ""), ("b", "Failed", ""), ("c", "Running", ""), ("c", "Queued", ""), ("c", "Stopped", ""),
        ("c", "Failed", ""), ("d", "Running", ""),
    )
    got = {r.job_id: r.completed_at for r in G.completions(df).collect()}
    assert got == {"a": naive(1), "c": naive(5)}


def test_flush_is_inclusive(spark):
    ev = events(spark, ("a", "Running", ""), ("a", "Succeeded", ""))
    entries = spark.createDataFrame([("a",), ("b",)], "job_id string")
    left = lambda as_of: sorted(r.job_id for r in G.flush_expired(entries, ev, F.lit(at(as_of)), 100).collect())
    assert (left(100), left(101)) == (["a", "b"], ["b"])


def test_delivery_skips_unusable_urls(spark):
    ev = events(spark, *[(j, s, "") for j in "abcd" for s in ("Running", "Succeeded")])
    jobs = spark.createDataFrame([("a", "https://h/x"), ("b", ""), ("c", "ftp://h"), ("e", "https://h")], "job_id string, callback_url string")
    assert [r.job_id for r in G.delivery_set(ev, jobs).collect()] == ["a"]


# --- execution -----------------------------------------------------------------------------


def test_outcome(spark):
    rows = [("a", 1, 0, False), ("a", 2, 3, False), ("a", 3, 0, False), ("b", 1, 1, True), ("b", 2, 0, False), ("c", 1, 2, True), ("c", 2, 7, False), ("c", 3, 1, True)]
    df = spark.createDataFrame(rows, "job_id string, step_id int, exit_code int, continue_on_error boolean")
    got = {r.job_id: (r.outcome, r.failed_step, r.tolerated, r.skipped, r.reason) for r in E.outcome_report(df).collect()}
    assert got == {
        "a": ("Failed", 2, 0, 1, "container exited with status 3"),
        "b": ("Succeeded", None, 1, 0, ""),
        "c": ("Failed", 2, 1, 1, "container exited with status 7"),
    }


def test_stuck(spark):
    rows = [
        ("a", False, 0, "ImagePullBackOff", "reg.example/tool:7"), ("b", True, 0, "CrashLoopBackOff", "runner:9"), ("c", False, 0, "ErrImagePull", "i"),
        ("d", False, 0, "ContainerCreating", "i"), ("e", True, 0, "CrashLoopBackOff", "app"), ("e", False, 1, "InvalidImageName", "init"), ("f", False, 0, None, "i"),
    ]
    df = spark.createDataFrame(rows, "job_id string, is_app boolean, idx int, waiting_reason string, image string")
    assert {r.job_id: r.reason for r in E.stuck_report(df).collect()} == {
        "a": "ImagePullBackOff (step 1): reg.example/tool:7",
        "b": "CrashLoopBackOff (container 1): runner:9",
        "e": "InvalidImageName (step 2): init",
    }


def test_drain_gate(spark):
    seen = [("a", "s1", "Succeeded"), ("a", "s2", "Pending"), ("b", "s1", "Failed"), ("c", "s1", "Succeeded"), ("d", "s1", "Running")]
    known = [("a", "s1", True), ("a", "s2", False), ("b", "s1", False)]
    c = spark.createDataFrame(seen, "job_id string, name string, state string")
    p = spark.createDataFrame(known, "job_id string, name string, logs_published boolean")
    assert {r.job_id: r.drained for r in E.drain_status(c, p).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_priorities_and_admission(spark):
    ex = spark.createDataFrame(
        [("x", "n", "p", {"priority": "4"}, at(3), True, False), ("y", "n", "p", {}, at(1), True, False), ("z", "n", "none", {}, at(0), True, False),
         ("w", "n", "p", {"priority": "9"}, at(0), True, True), ("v", "n", "p", {"priority": "9"}, at(0), False, False)],
        "job_id string, namespace string, parent string, labels map<string,string>, created_at timestamp, suspended boolean, finished boolean",
    )
    parents = spark.createDataFrame([("n", "p", {"priority": "4"})], "namespace string, name string, labels map<string,string>")
    resolved = E.resolve_priority(ex, parents)
    assert {r.job_id: r.priority for r in resolved.collect()} == {"x": 4, "y": 4, "z": 1, "w": 9, "v": 9}
    (row,) = E.capacity_report(resolved).collect()
    assert (row.active, row.job_id, row.priority) == (1, "y", 4)


def test_timeouts(spark):
    summaries = spark.createDataFrame([("a", at(0), None), ("b", at(0), at(5)), ("c", at(99), None), ("d", None, None), ("e", at(0), None)], "job_id string, started_at timestamp, finished_at timestamp")
    jobs = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2), ("e", 2**62)], "job_id string, timeout_seconds long")
    (row,) = E.timeouts(summaries, jobs, F.lit(at(100))).collect()
    assert (row.job_id, row.reason, row.deadline) == ("a", "job timed out after 2 seconds", naive(2))


def test_expected_containers(spark):
    steps = spark.createDataFrame([("a", 1), ("a", 2)], "job_id string, step_id int")
    assert sorted((r.name, r.step_id) for r in E.expected_containers(steps).collect()) == [("buildjob-finalizer", 0), ("step-1", 1), ("step-2", 2)]


# --- admission and sources -----------------------------------------------------------------

STEP = {"id": 1, "name": "s", "image": "i", "script": "", "continue_on_error": False, "metadata": {}, "cpu_limit": 0, "memory_limit": "", "network": "", "memory_swap": "", "pids_limit": 0}


def job(**over):
    step = {k: over.pop(k) for k in list(over) if k in STEP and k != "name"}
    return {"priority": 3, "id": "1", "name": "n", "steps": [{**STEP, **step}], "callback_url": "", "timeout_seconds": 0, **over}


@pytest.mark.parametrize(
    "payload,error",
    [
        (job(), None),
        (job(name=""), 'Invalid request payload: "Name" is required'),
        (job(timeout_seconds=-1), "timeout_seconds cannot be negative"),
        (job(timeout_seconds=9223372037), "timeout_seconds must not exceed 9223372036"),
        (job(memory_limit="1XXXX"), "Failed to parse RAM limit"),
        (job(memory_limit="1G", memory_swap="x"), "Failed to parse memory_swap limit"),
        (job(memory_swap="1G"), "memory_swap requires memory_limit to be set"),
        (job(memory_limit="2G", memory_swap="1G"), "memory_swap must be greater than or equal to memory_limit"),
        (job(memory_limit="1G", memory_swap="1G"), None),
        (job(pids_limit=-1), "pids_limit cannot be negative"),
        (job(network="bad net"), "invalid network mode: must be none, bridge, host, default, or a valid network name"),
        (job(callback_url="ftp://x"), "Invalid callback_url: callback URL scheme must be http or https"),
        (job(network="bad net", callback_url="ftp://x", timeout_seconds=-1), "timeout_seconds cannot be negative"),
        (job(steps=[]), None),
    ],
)
def test_admission(spark, payload, error):
    (row,) = A.admission_report(spark.createDataFrame([payload], S.SUBMISSION)).collect()
    assert row.error == error


def test_json_sources(spark, tmp_path):
    (tmp_path / "jobs.json").write_text('{"id":"1","name":"a","unknown":1,"steps":[{"id":1}]}\n{"id":"2","priority":1}\n{broken\n')
    rows = T.read_jobs(spark, str(tmp_path)).select("id", "priority", "_corrupt", F.size("steps").alias("n")).collect()
    assert [(r.id, r.priority, r._corrupt is None, r.n) for r in rows] == [("1", 3, True, 1), ("2", 1, True, None), (None, 3, False, None)]


def test_container_text(spark, tmp_path):
    for stream, text in (("stdout", "2023-01-01T00:00:00Z first line\n\n2023-01-01T00:00:01Z second line\n   \n"), ("stderr", "2023-01-01T00:00:02Z third\n")):
        folder = tmp_path / "job_id=007" / "container_id=step-1" / f"stream={stream}"
        folder.mkdir(parents=True)
        (folder / "log.txt").write_text(text)
    lines = T.read_raw_lines(spark, str(tmp_path))
    entries = G.parse_logs(lines, F.lit(T0)).orderBy("seq", "pos").collect()
    assert [(e.message, e.output_stream) for e in entries] == [("first line", "stdout"), ("second line", "stdout"), ("third", "stderr")]


def test_large_container_text_is_read_in_splits(spark, tmp_path):
    folder = tmp_path / "job_id=1" / "container_id=c" / "stream=stdout"
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("".join(f"line {i}\rsame line\n" for i in range(5000)))
    (folder / "b.log").write_text("after a\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = T.read_raw_lines(spark, str(tmp_path))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        got = [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [(i, f"line {i}\rsame line") for i in range(5000)] + [(5000, "after a")]


def test_unknown_job_has_no_logs(spark):
    boxes = G.coalesce_logs(batches(spark, ("c1", ["a"])))
    assert G.job_logs(boxes, "nobody").count() == 0
    asked = G.requested_logs(boxes, spark.createDataFrame([("j",), ("nobody",)], "job_id string"))
    assert {(r.job_id, r.container_id) for r in asked.collect()} == {("j", "c1"), ("nobody", None)}


def test_upsert_is_idempotent(spark):
    schema = "job_id string, version long, name string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema)
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], schema)
    once = T.upsert_jobs(old, new)
    twice = T.upsert_jobs(once, new)
    want = [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_tail_logs_and_exports(spark, tmp_path, views):
    path = str(tmp_path / "logs")
    T.write_logs(views.log_entries(), path)
    assert T.tail_logs(spark, path, "7", stream=False).count() == views.log_entries().where("job_id = '7'").count()
    live = T.tail_logs(spark, path, "7")
    assert live.isStreaming
    deliveries = spark.createDataFrame([("j", "https://u:p@host:1/x")], "job_id string, callback_url string")
    exports = T.export_job_logs(G.job_documents(batches(spark, ("c1", ["a"]), ("c2", None))), deliveries)
    T.write_exports(exports, str(tmp_path / "out"))
    (row,) = spark.read.json(str(tmp_path / "out")).collect()
    assert row.target_host == "host:1" and '"container_id":"c1"' in row.body and '"logs":[]' in row.body
