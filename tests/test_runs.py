"""Tables of merged runs, and the stream of metrics kept in them."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import EVENT, NOW, T0, ev, put, run, stream

from jobtrail.operators import lifecycle as L
from jobtrail.operators import metrics as M
from jobtrail.sources import files
from jobtrail.sources import runs as U
from jobtrail.streaming import jobs as J


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(U, "FANOUT", 2)


def test_runs_are_merged_and_read_once(spark, tmp_path, small):
    path = str(tmp_path / "t")
    newest = lambda rows, whole: U.newest(rows, "k")
    want, seen = {}, 0
    for n in range(11):
        U.compact(spark, path, n, newest)
        rows = [(n % 3, f"v{n}", n), (n + 100, f"w{n}", n)]
        U.write(spark.createDataFrame(rows, "k long, v string, batch_id long"), path, n)
        want |= {k: v for k, v, _ in rows}
        assert {r.k: r.v for r in U.newest(U.read(spark, path), "k").collect()} == want
        seen = max(seen, len(U.cover(spark, path)))
    assert seen <= 4 and (0, 7) in U.cover(spark, path)
    # What was merged a generation ago is gone; a batch that is replayed sees the table as before it.
    assert not files.exists(spark, f"{path}/run=0-0") and not files.exists(spark, f"{path}/run=2-3")
    before = U.read(spark, path, 10).agg(F.max("batch_id")).first()[0]
    assert before == 9 and U.read(spark, str(tmp_path / "none")) is None


def test_an_unfinished_run_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    U.write(spark.range(2).withColumn("batch_id", F.lit(0)), path, 0)
    U.write(spark.range(5).withColumn("batch_id", F.lit(1)), path, 1)
    files.remove(spark, f"{path}/run=1-1/_SUCCESS")
    assert U.cover(spark, path) == [(0, 0)] and U.read(spark, path).count() == 2


def test_expired_summaries_leave_the_table(spark, tmp_path, small):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for n in range(6):
        put(spark, src, ev(f"job{n}", "Succeeded", n * 4000))
    keep = lambda rows: L.sweep(rows, F.lit(rows.agg(F.max("updated_at")).first()[0]), 3600)
    run(J.start_updates(J.stream_lifecycle(stream(spark, src)), out, cp, NOW, keep=keep))
    assert len(U.cover(spark, out)) <= 3
    assert sorted(r.job_id for r in J.latest(spark, out).collect()) == ["job3", "job4", "job5"]


def test_figures_equal_the_batch_form_after_every_batch(spark, tmp_path, small):
    src, state, out, cp = (str(tmp_path / x) for x in ("src", "state", "out", "cp"))
    rng, files_of = random.Random(8), []
    for n in range(9):
        rows = []
        for _ in range(40):
            status = rng.choice(["Queued", "Running", "Running", "Succeeded", "Failed", "Stopped"])
            rows.append(ev(f"j{rng.randrange(60)}", status, n * 900 + rng.randrange(-500, 900), rng.randrange(10**6), rng.choice(["", "r1", "r2"])))
        files_of.append(rows)
        put(spark, src, *rows)
    none = lambda s: s.createDataFrame([], "job_id string, priority string")
    args = dict(retention=1800, stale_ttl=2700, window=600, forget=10**6, tick=300)
    run(J.start_metrics(stream(spark, src), none, none, state, out, cp, NOW, **args))
    got = spark.read.parquet(out).collect()
    for n in range(9):
        events = spark.createDataFrame([r for rows in files_of[: n + 1] for r in rows], EVENT)
        as_of = F.lit(max(r[3] for rows in files_of[: n + 1] for r in rows))
        kept = L.sweep(L.lifecycle(events), as_of, 1800, 2700)
        want = M.metrics_snapshot(kept, none(spark), none(spark), as_of, 600).collect()
        assert sorted((r.metric, r.dimension, r.value) for r in got if r.batch_id == n) == sorted((r.metric, r.dimension, r.value) for r in want)


def test_a_batch_writes_what_it_names_and_no_more(spark, tmp_path):
    src, state, out, cp = (str(tmp_path / x) for x in ("src", "state", "out", "cp"))
    put(spark, src, *[ev(f"j{i}", "Running", i % 50) for i in range(5000)])
    put(spark, src, ev("j7", "Succeeded", 90), ev("new", "Queued", 91))
    none = lambda s: s.createDataFrame([], "job_id string, priority string")
    run(J.start_metrics(stream(spark, src), none, none, state, out, cp, NOW))
    written = [[spark.read.parquet(f"{state}/{t}/run={n}-{n}").count() for t in ("jobs", "ticks", "exact")] for n in (0, 1)]
    assert written[0][0] == 5000 and written[1][0] == 2 and max(written[1]) <= 8


def test_a_job_begins_anew_once_it_is_forgotten(spark, tmp_path):
    src, state, out, cp = (str(tmp_path / x) for x in ("src", "state", "out", "cp"))
    put(spark, src, ev("a", "Running", 0), ev("a", "Succeeded", 5))
    put(spark, src, ev("b", "Queued", 5000))
    put(spark, src, ev("a", "Queued", 5001))
    none = lambda s: s.createDataFrame([], "job_id string, priority string")
    run(J.start_metrics(stream(spark, src), none, none, state, out, cp, NOW, retention=60, stale_ttl=60))
    last = {(r.metric, r.dimension): r.value for r in spark.read.parquet(out).where("batch_id = 2").collect()}
    assert last["status_count", "Queued"] == 2 and last["duration_count", ""] == 0
    with pytest.raises(ValueError):
        J.start_metrics(stream(spark, src), none, none, state, out, cp, NOW, retention=60, stale_ttl=60, forget=1)
