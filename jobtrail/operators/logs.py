"""Log lines and batches: parsing, ordering, trimming, coalescing and job documents.

Batches are (job_id, container_id, seq, logs), entries are (job_id, container_id, seq, pos, ts, message,
output_stream); ``seq`` is the arrival number of the batch, ``pos`` the place inside it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail import schemas as S
from jobtrail.functions import scalars as P
from jobtrail.functions import text as X
from jobtrail.operators import ordered
from jobtrail.operators.lifecycle import seconds, valid_events

CONTAINER = ["job_id", "container_id"]
#: Entries of a container or job that one row holds.
PIECE_LINES = 10_000


# --- raw lines -----------------------------------------------------------------------------


def non_blank(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn(column, X.trim_space(F.col(column))).where(F.col(column) != "")


def stream_rank(stream: Column) -> Column:
    return F.when(stream == "stdout", 0).otherwise(1)


def parse_logs(lines: DataFrame, fallback_ts: Column, parser: Callable[[Column, Column], Column] = X.parse_line) -> DataFrame:
    """Raw lines to entries. A buffered container is read stdout first, then stderr: seq is the stream's rank.

    ``parser`` maps (line, fallback time) to struct(ts, message, kind). Narrow: no shuffle.
    """
    entry = non_blank(lines).withColumn("_e", parser(F.col("line"), fallback_ts))
    return entry.select(
        *CONTAINER,
        stream_rank(F.col("stream")).cast("bigint").alias("seq"),
        F.col("line_no").alias("pos"),
        "_e.ts",
        "_e.message",
        F.col("stream").alias("output_stream"),
        "_e.kind",
    )


def parse_counts(entries: DataFrame) -> DataFrame:
    count = lambda kind: F.count(F.when(F.col("kind") == kind, True)).alias(kind)
    return entries.groupBy("job_id").agg(count("structured"), count("simple"), count("fallback"))


def union_streams(stdout: DataFrame, stderr: DataFrame) -> DataFrame:
    """All stdout lines, then all stderr lines, as (stream, seq) order columns."""
    tag = lambda df, name: df.withColumns({"stream": F.lit(name), "seq": stream_rank(F.lit(name)).cast("bigint")})
    return tag(stdout, "stdout").unionByName(tag(stderr, "stderr"))


def union_backlog(backlog: DataFrame, live: DataFrame) -> DataFrame:
    """Retained entries followed by live ones; what the live feed replays is kept once."""
    return dedup_replay(backlog.unionByName(live))


# --- batches and entries -------------------------------------------------------------------


def valid_batches(batches: DataFrame) -> DataFrame:
    return batches.where((F.col("job_id") != "") & (F.col("container_id") != ""))


def batch_entries(batches: DataFrame) -> DataFrame:
    """One row per entry; a batch without entries only registers its container and yields no row."""
    rows = valid_batches(batches).select(*CONTAINER, "seq", F.posexplode("logs").alias("pos", "e"))
    return rows.select(*CONTAINER, "seq", "pos", F.col("e.timestamp").alias("ts"), "e.message", "e.output_stream")


def containers(batches: DataFrame, max_entries: int = S.MAX_LOG_ENTRIES, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """One row per container: 0-based first-seen slot inside its job, entry count and how many a cap keeps."""
    size = F.greatest(F.coalesce(F.size("logs"), F.lit(0)), F.lit(0))
    first = valid_batches(batches).groupBy(*CONTAINER).agg(F.min("seq").alias("first_seq"), F.sum(size).alias("n"))
    order = ["first_seq", "container_id"]
    ranked = ordered.numbered(first, ["job_id"], order, [ordered.seq_block("first_seq", block)], "slot")
    kept = F.least("n", F.lit(max_entries)) if max_entries > 0 else F.col("n")
    return ranked.select(*CONTAINER, (F.col("slot") - 1).alias("slot"), "n", kept.alias("kept"))


def container_slots(batches: DataFrame, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """0-based first-seen position of each container inside its job, slot registrations included."""
    return containers(batches, 0, block).select(*CONTAINER, "slot")


def number_lines(entries: DataFrame, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """0-based entry index inside its container."""
    out = ordered.numbered(entries, CONTAINER, ["seq", "pos"], [ordered.seq_block("seq", block)], "line_no")
    return out.withColumn("line_no", F.col("line_no") - 1)


def tail_trim(entries: DataFrame, n: int = S.MAX_LOG_ENTRIES, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """The last ``n`` entries of every container; ``n`` <= 0 keeps all."""
    if n <= 0:
        return entries
    blocks = [ordered.seq_block("seq", block)]
    kept = ordered.numbered(entries, CONTAINER, ["seq", "pos"], blocks, "_rn", desc=True, upto=n)
    return kept.drop("_rn")


def retain_batches(
    batches: DataFrame,
    as_of: Column,
    max_age: int = 86400,
    per_job: int = S.MAX_BATCHES_PER_JOB,
    total: int = S.MAX_BATCHES_TOTAL,
    block: int = ordered.SEQ_BLOCK,
) -> DataFrame:
    """Stream retention: age (seconds), then newest ``per_job`` of each job, then newest ``total`` of all."""
    blocks = [ordered.seq_block("seq", block)]
    fresh = batches.where(F.col("ts") >= as_of - seconds(max_age))
    capped = ordered.numbered(fresh, ["job_id"], ["seq"], blocks, "_rn", desc=True, upto=per_job).drop("_rn")
    return ordered.newest(capped, ["seq"], total, blocks[0])


def dedup_replay(entries: DataFrame) -> DataFrame:
    """Identical (time, stream, message) inside a container once, at its first place. Combines before the shuffle."""
    key = [*CONTAINER, "ts", "output_stream", "message"]
    rest = [c for c in entries.columns if c not in key]
    first = entries.groupBy(*key).agg(F.min(F.struct("seq", "pos", *[c for c in rest if c not in ("seq", "pos")])).alias("_f"))
    return first.select(*key, "_f.*").select(*entries.columns)


def assign_batches(entries: DataFrame, size: int = 50, interval_seconds: int = 1, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """Deterministic micro-batches: per container and time slice, ``size`` entries each, in order."""
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(interval_seconds * 1_000_000))
    ticked = entries.withColumn("batch_tick", tick)
    rows = ordered.numbered(ticked, [*CONTAINER, "batch_tick"], ["seq", "pos"], [ordered.seq_block("seq", block)], "_rn")
    return rows.withColumn("batch_id", F.floor((F.col("_rn") - 1) / F.lit(size))).drop("_rn")


# --- coalesced logs and job documents ------------------------------------------------------


def ordered_lines(batches: DataFrame, max_entries: int = S.MAX_LOG_ENTRIES, block: int = ordered.SEQ_BLOCK) -> DataFrame:
    """Coalesced logs in long form: one row per kept entry with its slot and line number. Any ``max_entries``.

    Entries are numbered from the end, so one shuffle trims them and yields their line numbers.
    """
    boxes = containers(batches, max_entries, block).select(*CONTAINER, "slot", "kept")
    return _from_end(batches, boxes, max_entries, block).drop("kept", "_rn")


def _from_end(batches: DataFrame, boxes: DataFrame, max_entries: int, block: int) -> DataFrame:
    lines = ordered.numbered(
        batch_entries(batches),
        CONTAINER,
        ["seq", "pos"],
        [ordered.seq_block("seq", block)],
        "_rn",
        desc=True,
        upto=max_entries if max_entries > 0 else None,
        per_key=boxes,
    )
    return lines.withColumn("line_no", F.col("kept") - F.col("_rn"))


def _pieces(batches: DataFrame, boxes: DataFrame, max_entries: int, block: int, piece_lines: int) -> DataFrame:
    """``boxes`` (CONTAINER, slot, kept and others) with their entries, cut into pieces of ``piece_lines``."""
    lines = _from_end(batches, boxes.select(*CONTAINER, "kept"), max_entries, block)
    entry = F.struct("line_no", "ts", "message", "output_stream")
    piece = F.floor(F.col("line_no") / F.lit(piece_lines)).alias("piece")
    grouped = lines.groupBy(*CONTAINER, piece).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    # A container without entries is one empty piece.
    cut = boxes.withColumn("pieces", F.greatest(F.ceil(F.col("kept") / F.lit(piece_lines)), F.lit(1)))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    entries = F.transform(
        F.coalesce("_all", F.array()),
        lambda e: F.struct(e["ts"].alias("timestamp"), e["message"].alias("message"), e["output_stream"].alias("output_stream")),
    )
    return cut.join(grouped, [*CONTAINER, "piece"], "left").withColumn("entries", entries).drop("_all")


def coalesce_logs(
    batches: DataFrame, max_entries: int = S.MAX_LOG_ENTRIES, block: int = ordered.SEQ_BLOCK, piece_lines: int = PIECE_LINES
) -> DataFrame:
    """The last ``max_entries`` entries of each container in arrival order; ``max_entries`` <= 0 keeps all.

    One row per container, and for a longer one a row per ``piece_lines`` entries: ``piece`` of ``pieces``.
    ``n_entries`` counts the whole container.
    """
    boxes = containers(batches, max_entries, block).select(*CONTAINER, "slot", "kept")
    rows = _pieces(batches, boxes, max_entries, block, piece_lines)
    return rows.select("job_id", "slot", "container_id", "piece", "pieces", "entries", F.col("kept").alias("n_entries"))


def job_documents(
    batches: DataFrame,
    max_entries: int = S.MAX_LOG_ENTRIES,
    block: int = ordered.SEQ_BLOCK,
    piece_lines: int = PIECE_LINES,
    part_lines: int = PIECE_LINES,
) -> DataFrame:
    """The ordered container logs of each job: job_id, part, parts, containers.

    Nearly every job is one part. A longer document is cut after about ``part_lines`` entries and containers, inside
    a container too, so that no row grows with a job; its parts in order are the whole document.
    """
    boxes = containers(batches, max_entries, block).select(*CONTAINER, "slot", "kept")
    # A piece takes a place for itself and one for each entry; places are counted on the small table.
    size = F.col("kept") + F.greatest(F.ceil(F.col("kept") / F.lit(piece_lines)), F.lit(1))
    sized = boxes.withColumn("_size", size)
    upto = ordered.running(sized, ["job_id"], ["slot"], "_size", [ordered.seq_block("slot", block)], "_upto", F.sum, lambda x, y: x + y)
    last_piece = (F.greatest(F.ceil(F.col("kept") / F.lit(piece_lines)), F.lit(1)) - 1) * F.lit(piece_lines + 1)
    upto = upto.withColumn("_before", F.col("_upto") - F.col("_size"))
    ends = upto.groupBy("job_id").agg((F.floor(F.max(F.col("_before") + last_piece) / F.lit(part_lines)) + 1).alias("parts"))
    placed = upto.join(ends, "job_id").select(*CONTAINER, "slot", "kept", "_before", "parts")
    rows = _pieces(batches, placed, max_entries, block, piece_lines)
    part = F.floor((F.col("_before") + F.col("piece") * F.lit(piece_lines + 1)) / F.lit(part_lines)).alias("part")
    box = F.struct("slot", "piece", "pieces", "container_id", "entries")
    return rows.groupBy("job_id", part, "parts").agg(F.sort_array(F.collect_list(box)).alias("containers"))


def step_log_at(documents: DataFrame, index: int) -> DataFrame:
    """The container at a 0-based position of each job's document, piece by piece."""
    hit = documents.select("job_id", F.explode(F.filter("containers", lambda c: c["slot"] == index)).alias("c"))
    return hit.select("job_id", "c.slot", "c.container_id", "c.piece", "c.pieces", "c.entries")


def log_tail(
    batches: DataFrame, n: int = S.MAX_LOG_LINES_SHOWN, max_entries: int = S.MAX_LOG_ENTRIES, block: int = ordered.SEQ_BLOCK
) -> DataFrame:
    """The last ``n`` lines of each job across its containers in slot order, with the job's line total.

    How many lines follow a container is known from the container table, so the lines need no second window.
    """
    boxes = containers(batches, max_entries, block)
    sums = ordered.running(
        boxes, ["job_id"], ["slot"], "kept", [ordered.seq_block("slot", block)], "_upto", F.sum, lambda x, y: x + y, desc=True
    )
    totals = boxes.groupBy("job_id").agg(F.sum("kept").alias("total"))
    boxes = sums.join(totals, "job_id").select(*CONTAINER, "slot", "kept", (F.col("_upto") - F.col("kept")).alias("_after"), "total")
    lines = _from_end(batches, boxes, max_entries, block)
    return lines.where(F.col("_after") + F.col("_rn") <= n).select(
        "job_id",
        "slot",
        P.truncate_id(F.col("container_id"), 12).alias("container"),
        "line_no",
        "ts",
        "message",
        (F.col("output_stream") == "stderr").alias("is_stderr"),
        "total",
    )


# --- logs and lifecycle --------------------------------------------------------------------


def watched_jobs(events: DataFrame) -> DataFrame:
    return valid_events(events).where(F.col("status") == "Running").select("job_id").distinct()


def watched_logs(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries of jobs that were ever running, earlier entries included."""
    return entries.join(watched_jobs(events), "job_id", "left_semi")


def completions(events: DataFrame) -> DataFrame:
    """Jobs that reached a terminal status after they ran: job_id, completed_at.

    A watch starts at each Running and ends at the next terminal status, so the last completion is the last
    terminal event that is the first one after some Running.
    """
    ev = valid_events(events)
    ran = ev.where((F.col("status") == "Running") | P.is_terminal(F.col("status")))
    prev = ordered.lagged(ran, ["job_id"], ["ts", "seq"], {"_before": "status"}, [ordered.time_block("ts", 86400)])
    ends = prev.where(P.is_terminal(F.col("status")) & (F.col("_before") == "Running"))
    return ends.groupBy("job_id").agg(F.max("ts").alias("completed_at"))


def delivery_set(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Completed jobs whose callback URL is usable: job_id, callback_url, completed_at."""
    url = F.col("callback_url")
    usable = jobs.where((url != "") & P.callback_url_error(url).isNull()).select("job_id", "callback_url")
    return completions(events).join(usable, "job_id").select("job_id", "callback_url", "completed_at")


def logs_in_run(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Mark entries inside their job's run. An open end does not bound."""
    bounds = summaries.select("job_id", "started_at", "finished_at")
    inside = (F.col("ts") >= F.col("started_at")) & (F.col("finished_at").isNull() | (F.col("ts") <= F.col("finished_at")))
    out = entries.join(bounds, "job_id", "left")
    return out.select(*entries.columns, F.coalesce(inside, F.lit(False)).alias("in_run"))


def flush_expired(entries: DataFrame, events: DataFrame, as_of: Column, retention: int = 3600) -> DataFrame:
    """Drop the logs of jobs completed at least ``retention`` seconds ago; other jobs keep theirs."""
    gone = completions(events).where(F.col("completed_at") <= as_of - seconds(retention))
    return entries.join(gone, "job_id", "left_anti")


def job_logs(coalesced: DataFrame, job_id: str) -> DataFrame:
    """The containers of one job; none for an unknown job."""
    return coalesced.where(F.col("job_id") == job_id)


def requested_logs(coalesced: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for a table of job ids. An unknown job answers with one row without a container."""
    return requests.select("job_id").distinct().join(coalesced, "job_id", "left")


def since(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Entries at or after their container's saved offset; all of them where none is saved."""
    saved = offsets.select(*CONTAINER, F.col("offset_ts"))
    out = entries.join(saved, CONTAINER, "left")
    return out.where(F.col("offset_ts").isNull() | (F.col("ts") >= F.col("offset_ts"))).select(*entries.columns)


