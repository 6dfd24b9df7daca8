"""Tables on disk that change: keyed buckets, dated folders, hand-over to a stream, and the live list."""

import random
from datetime import date, datetime, timedelta

from test_streaming import NOW, put, run, stream

from jobtrail.operators import lifecycle as L
from jobtrail.sources import files
from jobtrail.sources import tables as T
from jobtrail.streaming import jobs as J

JOB = "job_id string, version long, name string"


def held(spark, path):
    return sorted((r.job_id, r.version, r.name) for r in spark.read.parquet(path).collect())


def names(spark, path):
    return {f.split("/bucket=")[1] for f in spark.read.parquet(path).inputFiles()}


def test_only_buckets_with_newer_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "jobs")
    write = lambda *rows: T.write_keyed(spark, path, spark.createDataFrame(rows, JOB), buckets=8)
    write(*[(f"j{i}", 1, "x") for i in range(100)])
    before = names(spark, path)
    write(("j3", 1, "repeated"), ("j4", 0, "older"))
    assert names(spark, path) == before and len(held(spark, path)) == 100
    write(("j3", 2, "new"), ("j3", 3, "newer"), ("j4", 0, "older"))
    after = names(spark, path)
    assert len({f.split("/")[0] for f in before ^ after}) == 1 and len(before & after) >= 7
    assert ("j3", 3, "newer") in held(spark, path) and ("j4", 1, "x") in held(spark, path) and len(held(spark, path)) == 100
    write(("fresh", 1, "y"))
    assert len(held(spark, path)) == 101


def test_expired_dates_are_deleted_one_call_late(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [("j", "c", i, datetime(2024, 1, 1) + timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "job_id string, container_id string, seq long, ts timestamp")
    df.withColumn("event_date", df.ts.cast("date")).write.partitionBy("event_date").parquet(path)
    reader = spark.read.parquet(path)
    assert T.drop_expired(spark, path, date(2024, 1, 8), 3) == []
    assert sorted(r.seq for r in T.read_kept(spark, path).collect()) == [4, 5, 6, 7, 8, 9] and reader.count() == 10
    reader = T.read_kept(spark, path)
    gone = T.drop_expired(spark, path, date(2024, 1, 9), 3)
    assert gone == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    # What began before the second call reads on; its folders are there until the third.
    assert reader.count() == 6 and not files.exists(spark, f"{path}/event_date=2024-01-01")
    assert sorted(r.seq for r in T.read_kept(spark, path).collect()) == [5, 6, 7, 8, 9]
    assert T.drop_expired(spark, path, date(2024, 1, 2), 3) == []  # a clock that goes back deletes nothing more
    assert T.drop_expired(spark, path, date(2024, 1, 9), 3) == ["2024-01-05"]


def test_no_row_is_in_the_snapshot_and_in_the_stream(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "job_id string, message string"
    put(spark, path, ("a", "one"), ("a", "one"), ("b", "other"), schema=schema)
    first, live = T.snapshot_and_tail(spark, path, "a", str(tmp_path / "files"))
    put(spark, path, ("a", "one"), ("a", "two"), schema=schema)
    run(J.start_append(live, str(tmp_path / "out"), str(tmp_path / "cp"), NOW))
    assert sorted(r.message for r in first.collect()) == ["one", "one"]
    assert sorted(r.message for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_the_live_list_is_that_of_updates_one_by_one(spark, tmp_path):
    src, path, cp = (str(tmp_path / x) for x in ("src", "list", "cp"))
    schema, rng, seq, batches = "job_id string, status string, reason string, seq long", random.Random(6), 0, []
    for _ in range(5):
        rows = []
        for _ in range(12):
            seq += 1
            rows.append((f"j{rng.randrange(14)}", rng.choice(["Failed", "Failed", "Running", None]), rng.choice([None, "r1", "r2"]), seq))
        batches.append(rows)
        put(spark, src, *rows, schema=schema)
    run(J.start_live_list(stream(spark, src, schema), path, cp, NOW, status="Failed", n=6))
    wanted = []
    for rows in batches:
        for job, status, reason, _ in rows:
            at = next((i for i, r in enumerate(wanted) if r[0] == job), None)
            if at is not None and status not in (None, "Failed"):
                del wanted[at]
            elif at is not None:
                wanted[at] = (job, "Failed", reason or wanted[at][2])
            elif status == "Failed":
                wanted.insert(0, (job, status, reason))
        wanted = wanted[:6]
    got = sorted(J.live_list(spark, path).collect(), key=lambda r: r.position)
    assert [(r.job_id, r.status, r.reason) for r in got] == wanted and [r.position for r in got] == list(range(len(got)))
    assert files.folders(spark, path) == ["batch_id=3", "batch_id=4"]
