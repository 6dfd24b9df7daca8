"""Keyed state with event-time timers: expiry, completion, time limits and duplicate windows.

Times are epoch microseconds; timers run on watermark milliseconds.
"""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobtrail import schemas as S
from jobtrail.operators.lifecycle import valid_events

_EVENT = "job_id string, status string, reason string, ts timestamp, seq long"


def _micros(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


def combine_events(events: DataFrame) -> DataFrame:
    """Drop, before the shuffle, events that cannot change a fold: of each Arrow batch a job keeps its last
    event, its last reason and the first event of each phase. A job flooding the stream thus sends few rows."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "seq"], kind="stable")
            phase = pdf["status"].where(~pdf["status"].isin(S.TERMINAL), "done")
            first = ~pdf.assign(p=phase).duplicated(["job_id", "p"], keep="first")
            last = ~pdf.duplicated(["job_id"], keep="last")
            reasoned = pdf["reason"] != ""
            told = reasoned & ~pdf.assign(r=reasoned).duplicated(["job_id", "r"], keep="last")
            yield pdf[first | last | told]

    return valid_events(events).select("job_id", "status", "reason", "ts", "seq").mapInPandas(thin, _EVENT)


def _times(micros) -> np.ndarray:
    return np.asarray(micros).astype("int64").astype("datetime64[us]")


# --- events in order -----------------------------------------------------------------------
#
# Rows reach a key in the order of files, not of time. The folds below keep what the watermark has not passed and
# walk the rest in the order of time, so that their results do not hang on where files are cut.
#
# State is kept per bucket of keys, not per key: one call walks the waiting rows of all its keys as sorted arrays, and
# one timer serves them. A bucket holds the rows of its keys that the watermark has not passed, and a few numbers per
# key. The number of buckets is fixed by the query's checkpoint; take as many as give each task a few.

BUCKETS = 32
_BUCKET = "_bucket"
_HELD = "held binary"
#: What a walk returns: tables to keep, rows to emit, and the time in microseconds to be called again at (None: not).
Walk = Callable[[dict[str, pd.DataFrame], pd.DataFrame | None, int], tuple[dict[str, pd.DataFrame], pd.DataFrame | None, int | None]]


def _bucketed(rows: DataFrame, key: str, walk: Walk, out: str | T.StructType, buckets: int, mode: str = "append") -> DataFrame:
    """Run ``walk`` per bucket of keys, on the tables that it kept, the new rows and the watermark in microseconds."""

    def fold(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpack(state.get[0]) if state.exists else {}
        new = None if state.hasTimedOut else pd.concat(list(batches), ignore_index=True).drop(columns=_BUCKET)
        held, found, wake = walk(held, new, state.getCurrentWatermarkMs() * 1000)
        if wake is not None:
            state.update((_pack(held),))
            # Call again once the watermark has passed that time.
            state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if found is not None and len(found):
            yield found

    keyed = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy(_BUCKET)
    return keyed.applyInPandasWithState(fold, out, _HELD, mode, GroupStateTimeout.EventTimeTimeout)


def _pack(tables: dict[str, pd.DataFrame]) -> bytes:
    return pickle.dumps({name: pa.Table.from_pandas(t, preserve_index=False) for name, t in tables.items()})


def _unpack(held: bytes) -> dict[str, pd.DataFrame]:
    return {name: t.to_pandas() for name, t in pickle.loads(held).items()}


def _together(held: pd.DataFrame | None, new: pd.DataFrame | None) -> pd.DataFrame | None:
    some = [t for t in (held, new) if t is not None and len(t)]
    return pd.concat(some, ignore_index=True) if len(some) > 1 else some[0] if some else held if held is not None else new


def _first_rows(keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by key, the place of the first row of the same key."""
    fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)


def _walked(waiting: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The waiting rows that the watermark has passed, by job and time, and the rest. No earlier row can follow those."""
    due = waiting["t"] <= now
    return waiting[due].sort_values(["job_id", "t", "seq", "status"], ignore_index=True), waiting[~due]


# --- lifecycle with expiry -----------------------------------------------------------------

_SUMMARY = (
    "job_id string, status string, reason string, queued_at timestamp, started_at timestamp, "
    "finished_at timestamp, updated_at timestamp, is_expired boolean"
)
_NEVER = np.iinfo("int64").max
# Of a job: its last event and last reason with their time and number, the first time of each phase, the last time of
# all, and the watermark in milliseconds that lets it go.
_FRESH = {"status": "", "st": -1, "sq": -1, "reason": "", "rt": -1, "rq": -1, "queued": _NEVER, "started": _NEVER, "finished": _NEVER, "updated": -1, "timer": 0}


def _fresh_jobs(ids: pd.Index) -> pd.DataFrame:
    columns = {c: pd.Series(value, index=ids, dtype=object if isinstance(value, str) else "int64") for c, value in _FRESH.items()}
    return pd.DataFrame(columns, index=ids)


def stream_lifecycle_expiring(
    events: DataFrame, watermark: str = "0 seconds", retention: int = 3600, stale_ttl: int = 86400, buckets: int = BUCKETS
) -> DataFrame:
    """The lifecycle fold with bounded state: a finished job is let go ``retention`` seconds after its last
    event, any other after ``stale_ttl``. Emits the summary on every change and once more on expiry."""

    def walk(held, new, now):
        jobs = held["jobs"].set_index("job_id") if "jobs" in held else _fresh_jobs(pd.Index([], dtype=object))
        own = jobs.iloc[:0]
        if new is not None:
            new = new.assign(t=_micros(new["ts"]), seq=new["seq"].fillna(-1).astype("int64"))
            ids = pd.Index(new["job_id"].unique(), dtype=object)
            known = jobs.index.isin(ids)
            own = pd.concat([jobs[known], _fresh_jobs(ids.difference(jobs.index))])
            own = _folded(own, new)
            ttl = np.where(own["status"].isin(S.TERMINAL), retention, stale_ttl) * 1000
            # A timer must lie beyond the watermark.
            own["timer"] = np.maximum(own["updated"] // 1000 + ttl, now // 1000 + 1)
            jobs = jobs[~known]
        over = jobs["timer"] < now // 1000
        found = pd.concat([own.assign(is_expired=False), jobs[over].assign(is_expired=True)])
        jobs = pd.concat([jobs[~over], own])
        times = {f"{c}_at": _times(found[c].where(found[c] != _NEVER, np.iinfo("int64").min)) for c in ("queued", "started", "finished", "updated")}
        rows = pd.DataFrame({"job_id": found.index, "status": found["status"].array, "reason": found["reason"].array, **times, "is_expired": found["is_expired"].to_numpy(bool)})
        return {"jobs": jobs.rename_axis("job_id").reset_index()}, rows, int(jobs["timer"].min()) * 1000 if len(jobs) else None

    rows = combine_events(events).withWatermark("ts", watermark)
    return _bucketed(rows, "job_id", walk, _SUMMARY, buckets, "update")


def _folded(jobs: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """Jobs, all of which have events, after those."""

    def last(column: str, t: str, seq: str, told: pd.DataFrame) -> pd.DataFrame:
        # What is held goes first: of equal events the later arrival counts.
        old = pd.DataFrame({"job_id": jobs.index, "t": jobs[t].array, "seq": jobs[seq].array, column: jobs[column].array})
        rows = pd.concat([old, told[["job_id", "t", "seq", column]]], ignore_index=True)
        top = rows.iloc[np.lexsort((rows["seq"], rows["t"]))].drop_duplicates("job_id", keep="last").set_index("job_id")
        return top.reindex(jobs.index).rename(columns={"t": t, "seq": seq})

    status = last("status", "st", "sq", events)
    reason = last("reason", "rt", "rq", events[events["reason"] != ""])
    phases = {"queued": events["status"] == "Queued", "started": events["status"] == "Running", "finished": events["status"].isin(S.TERMINAL)}
    firsts = {c: events[of].groupby("job_id")["t"].min().reindex(jobs.index, fill_value=_NEVER) for c, of in phases.items()}
    return jobs.assign(
        **{c: status[c] for c in ("status", "st", "sq")},
        **{c: reason[c] for c in ("reason", "rt", "rq")},
        **{c: np.minimum(jobs[c], t) for c, t in firsts.items()},
        updated=np.maximum(jobs["updated"], events.groupby("job_id")["t"].max().reindex(jobs.index)),
    )


# --- completions ---------------------------------------------------------------------------

_READY = "job_id string, first_at timestamp, completed_at timestamp, complete boolean"


def stream_completions(
    events: DataFrame, progress: DataFrame | None = None, watermark: str = "0 seconds", drain: int = 30, forget: int = 86400, buckets: int = BUCKETS
) -> DataFrame:
    """Each run of a job that ended, ``drain`` seconds of event time after its end: job_id, first_at (earliest
    event), completed_at, complete.

    A run starts at Running and ends at the next terminal status, so a job that runs again completes again.
    ``progress`` is a second stream with a ``ts``, as a rule the committed log table (``jobs.committed_logs``): it
    only holds the clock back until it has come as far, none of its rows is shuffled. ``complete`` says that there
    was such a clock, so that all logs up to the end are there. A job is let go ``forget`` seconds after its last event.
    """
    followed = progress is not None
    wait, keep = drain * 1_000_000, forget * 1_000_000

    def walk(held, new, now):
        if new is not None:
            new = pd.DataFrame({"job_id": new["job_id"], "t": _micros(new["ts"]), "seq": new["seq"], "status": new["status"]})
        waiting = _together(held.get("waiting"), new)
        jobs = held.get("jobs")
        if jobs is None:
            jobs = pd.DataFrame({"job_id": [], "first": [], "seen": [], "running": []}).astype({"job_id": object, "first": "int64", "seen": "int64", "running": bool})
            held = {"ends": pd.DataFrame({"job_id": [], "t": []}).astype({"job_id": object, "t": "int64"})}
        due, waiting = _walked(waiting, now)
        times = due.groupby("job_id")["t"].agg(["min", "max"])
        jobs = jobs.set_index("job_id")
        jobs = jobs.reindex(jobs.index.union(times.index))
        jobs["first"] = jobs["first"].combine(times["min"].reindex(jobs.index), np.fmin).astype("int64")
        jobs["seen"] = jobs["seen"].combine(times["max"].reindex(jobs.index), np.fmax).astype("int64")
        was = jobs["running"].fillna(False).astype(bool)
        # A run is open after Running and over after a terminal status; nothing else matters to it.
        steps = due[due["status"].isin(["Running", *S.TERMINAL])]
        runs, key = (steps["status"] == "Running").to_numpy(), steps["job_id"].to_numpy()
        start = _first_rows(key)
        before = np.where(start == np.arange(len(key)), was.reindex(key).to_numpy(), np.append(False, runs[:-1]) if len(runs) else runs)
        ended = ~runs & before.astype(bool)
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        was.loc[key[last]] = runs[last]
        jobs["running"] = was
        ends = _together(held["ends"], pd.DataFrame({"job_id": key[ended], "t": steps["t"].to_numpy()[ended]}))
        over = ends["t"] + wait <= now
        ready, ends = ends[over], ends[~over]
        open_jobs = set(waiting["job_id"]) | set(ends["job_id"])
        found = pd.DataFrame(
            {"job_id": ready["job_id"], "first_at": _times(jobs["first"].reindex(ready["job_id"])), "completed_at": _times(ready["t"]), "complete": followed}
        )
        jobs = jobs.reset_index()
        jobs = jobs[(jobs["seen"] + keep > now) | jobs["job_id"].isin(open_jobs)]
        idle = jobs[~jobs["job_id"].isin(open_jobs)]
        wakes = [*waiting["t"].nsmallest(1), *(ends["t"].nsmallest(1) + wait), *(idle["seen"].nsmallest(1) + keep)]
        return {"jobs": jobs, "waiting": waiting, "ends": ends}, found, int(min(wakes)) if wakes else None

    rows = valid_events(events).select("job_id", "status", "ts", "seq").withWatermark("ts", watermark)
    if followed:
        # No row passes this test, yet every row has moved the clock by then.
        clock = progress.select("ts").withWatermark("ts", watermark).where(F.col("ts").isNull())
        rows = rows.unionByName(clock.select(F.lit("").alias("job_id"), F.lit("").alias("status"), "ts", F.lit(0).cast("bigint").alias("seq")))
    return _bucketed(rows, "job_id", walk, _READY, buckets)


# --- time limits ---------------------------------------------------------------------------

_LATE = "job_id string, status string, reason string, deadline timestamp"
_LIMIT = "limit"


def stream_timeouts(events: DataFrame, jobs: DataFrame, watermark: str = "0 seconds", forget: int = 86400, buckets: int = BUCKETS) -> DataFrame:
    """A Failed row for every run that is not over at its job's limit: job_id, status, reason, deadline.

    A run starts at Running; it is over at the next terminal status, and no row is due if that comes at the limit or
    before. ``jobs`` has job_id and timeout_seconds. As a stream it also has ts, and jobs that come after the query
    has started count; a table is read once, when the query starts. Jobs without a limit give no rows. A job is let
    go ``forget`` seconds after its last event, unless a run is open and its limit has not passed.
    """
    from jobtrail.functions import scalars as P

    limit = P.clamp_timeout(F.col("timeout_seconds")).alias("limit")
    rows = valid_events(events).select("job_id", "status", "ts", "seq").withWatermark("ts", watermark)
    # A test that names the time stays above the watermark, so that every event moves the clock.
    rows = rows.where(F.col("status").isin("Running", *S.TERMINAL) | F.col("ts").isNull())
    if jobs.isStreaming:
        told = jobs.select("job_id", F.lit(_LIMIT).alias("status"), "ts", F.lit(-1).cast("bigint").alias("seq"), limit, "timeout_seconds")
        nothing = F.lit(None).cast("bigint")
        rows = rows.withColumns({"limit": nothing, "timeout_seconds": nothing}).unionByName(told.withWatermark("ts", watermark))
    else:
        rows = rows.join(jobs.select("job_id", limit, "timeout_seconds").where(F.col("limit").isNotNull()), "job_id")
    keep = forget * 1_000_000
    # Of a job: the start of its open run or -1, whether that run's row is out, the limit (-1 not known, 0 none) and how it was told.
    fresh = {"run": -1, "out": 0, "limit": -1, "told": 0, "seen": -1}

    def walk(held, new, now):
        known = held.get("jobs")
        known = pd.DataFrame({c: pd.Series(dtype="int64") for c in fresh}) if known is None else known.set_index("job_id")
        waiting = held.get("waiting", pd.DataFrame({"job_id": [], "t": [], "seq": [], "status": []}).astype({"job_id": object, "t": "int64", "seq": "int64", "status": object}))
        if new is not None:
            new = new.assign(t=_micros(new["ts"]))
            known = known.reindex(known.index.union(new["job_id"].unique()))
            for c, value in fresh.items():
                known[c] = known[c].fillna(value).astype("int64")
            said = new[(new["status"] == _LIMIT) | new["limit"].notna()].drop_duplicates("job_id", keep="last").set_index("job_id")
            none = said["limit"].isna()
            known.loc[said.index, "limit"] = said["limit"].fillna(0).astype("int64")
            known.loc[said.index, "told"] = said["timeout_seconds"].where(~none, 0).astype("int64")
            seen = new.groupby("job_id")["t"].max()
            known.loc[seen.index, "seen"] = np.maximum(known.loc[seen.index, "seen"], seen)
            waiting = _together(waiting, new.loc[new["status"] != _LIMIT, ["job_id", "t", "seq", "status"]])
        limits = known["limit"].reindex(waiting["job_id"]).to_numpy()
        idle, waiting = waiting[limits < 0], waiting[limits > 0]
        due, waiting = _walked(waiting, now)
        # An open run goes before the rows of its job, as the Running that began it.
        open_runs = known[(known["run"] >= 0) & (known["limit"] > 0)]
        begun = pd.DataFrame({"job_id": open_runs.index, "t": open_runs["run"].to_numpy(), "status": "Running", "out": open_runs["out"].to_numpy(), "old": 0})
        steps = _together(begun, due[["job_id", "t", "status"]].assign(out=0, old=1)).sort_values(["job_id", "old"], kind="stable", ignore_index=True)
        key, t, runs = steps["job_id"].to_numpy(), steps["t"].to_numpy().astype("int64"), (steps["status"] == "Running").to_numpy()
        start = _first_rows(key)
        starts = runs & ~np.append(False, (runs[:-1] & (key[1:] == key[:-1])) if len(runs) else runs)
        # A run ends at the next terminal status of its job; one without is open, and late if the watermark is past its limit.
        begin = np.flatnonzero(starts)
        stops = np.append(np.flatnonzero(~runs), len(key))
        stop = stops[np.searchsorted(stops, begin)]
        closed = (stop < len(key)) & (start[np.minimum(stop, len(key) - 1)] == start[begin]) if len(key) else np.zeros(0, bool)
        until = np.where(closed, t[np.minimum(stop, len(key) - 1)], now + 1) if len(key) else np.zeros(0, "int64")
        deadline = t[begin] + known["limit"].reindex(key[begin]).to_numpy() * 1_000_000
        out = steps["out"].to_numpy()[begin] > 0
        late = ~out & (deadline < until)
        known.loc[np.unique(key), ["run", "out"]] = -1, 0
        open_at = begin[~closed]
        known.loc[key[open_at], "run"] = t[open_at]
        known.loc[key[open_at], "out"] = (out | late)[~closed].astype("int64")
        told = known["told"].reindex(key[begin[late]]).to_numpy()
        found = pd.DataFrame({"job_id": key[begin[late]], "status": "Failed", "reason": [f"job timed out after {n} seconds" for n in told], "deadline": _times(deadline[late])})
        due_at = known["run"] + known["limit"] * 1_000_000
        running = (known["run"] >= 0) & (known["out"] == 0) & (known["limit"] > 0)
        stay = running | (known["seen"] + keep > now) | known.index.isin(waiting["job_id"])
        idle = idle[idle["job_id"].isin(known.index[stay])]
        known = known[stay]
        quiet = known[~(running & stay)[stay]]
        wakes = [*waiting["t"].nsmallest(1), *due_at[running].nsmallest(1), *(quiet["seen"].nsmallest(1) + keep)]
        tables = {"jobs": known.rename_axis("job_id").reset_index(), "waiting": pd.concat([waiting, idle], ignore_index=True)}
        return tables, found, int(min(wakes)) if wakes else None

    return _bucketed(rows, "job_id", walk, _LATE, buckets)


# --- duplicate window ----------------------------------------------------------------------


def stream_dedup(queue: DataFrame, gap: int = 60, key: str = "job_id", watermark: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Drop a row that comes less than ``gap`` seconds after the last accepted row of its key.

    Rows come out once the watermark has passed them. Spark's own ``dropDuplicatesWithinWatermark`` keeps a key until
    the end of the batch that lets it go and so also drops some rows that come after the window; here the times
    decide. Queue rows carry ts and seq. A key keeps one row per instant that the watermark has not passed.
    """
    span = gap * 1_000_000

    def one_per_instant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # All that is certain before the shuffle: of rows at one instant only the first can be accepted.
        for pdf in batches:
            yield pdf.sort_values(["ts", "seq"], kind="stable").drop_duplicates([key, "ts"], keep="first")

    def walk(held, new, now):
        waiting = _together(held.get("waiting"), new)
        last = held["last"].set_index(key)["t"] if "last" in held else pd.Series(dtype="int64")
        t = _micros(waiting["ts"])
        due = waiting[t <= now].sort_values([key, "ts", "seq"], kind="stable")
        keys, at = due[key].to_numpy(), _micros(due["ts"]).to_numpy()
        start = _first_rows(keys)
        free = (last.reindex(keys[start] if len(keys) else keys) + span).fillna(np.iinfo("int64").min // 2).to_numpy().astype("int64")
        taken, open_from, own = np.zeros(len(at), bool), 0, -1
        for i, (first, x) in enumerate(zip(start.tolist(), at.tolist())):
            if first != own:
                own, open_from = first, free[i]
            if x >= open_from:
                taken[i], open_from = True, x + span
        accepted = pd.Series(at[taken], index=keys[taken])
        accepted = accepted[~accepted.index.duplicated(keep="last")]
        last = pd.concat([last[~last.index.isin(accepted.index)], accepted]).astype("int64")
        waiting = waiting[t > now]
        last = last[last + span > now]
        wakes = [*t[t > now].nsmallest(1), *(last.nsmallest(1) + span)]
        tables = {"waiting": waiting, "last": last.rename("t").rename_axis(key).reset_index()}
        return tables, due[taken], int(min(wakes)) if wakes else None

    rows = queue.mapInPandas(one_per_instant, queue.schema).withWatermark("ts", watermark)
    return _bucketed(rows, key, walk, queue.schema, buckets)


# --- micro-batches -------------------------------------------------------------------------

_PART = "_part"


def stream_batches(
    entries: DataFrame, size: int = 50, interval_seconds: int = 1, watermark: str = "0 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """Log entries with batch_tick and batch_id as ``logs.assign_batches`` gives them, each tick flushed by a timer
    once the watermark has passed its end; what a tick holds beyond ``size`` entries makes further batches.

    Entries carry job_id, container_id, ts, seq and pos. Only open ticks are held, spread over buckets by container
    and tick, so a container that logs much is in many of them. A row later than the watermark is in no batch.
    """
    width, box = interval_seconds * 1_000_000, ["job_id", "container_id", "batch_tick"]
    out = T.StructType([*entries.schema.fields, T.StructField("batch_tick", T.LongType()), T.StructField("batch_id", T.LongType())])
    names = out.fieldNames()

    def walk(held, new, now):
        waiting = _together(held.get("waiting"), new)
        ends = (waiting["batch_tick"] + 1) * width - 1
        due = waiting[ends <= now].sort_values([*box, "seq", "pos"], kind="stable")
        due = due.assign(batch_id=due.groupby(box, dropna=False).cumcount() // size)
        open_ends = ends[ends > now]
        return {"waiting": waiting[ends > now]}, due[names], int(open_ends.min()) if len(open_ends) else None

    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(width))
    rows = entries.withWatermark("ts", watermark).withColumn("batch_tick", tick)
    return _bucketed(rows.withColumn(_PART, F.xxhash64(*box)), _PART, walk, out, buckets)
