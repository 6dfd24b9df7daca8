"""Interleaved container output: frames of two streams in one file, taken apart wherever the file is split.

A frame is a byte that names its stream (0 and 1 standard output, 2 standard error), three zero bytes, the length of
its payload as four bytes (big end first), and the payload. Where a frame begins is known only from the frame before
it, and a payload may hold bytes that look like a header. So each block of a file is followed from every place where a
header could begin, and gives the places where those chains leave it. The true chain of a file enters a block where
one of these leaves an earlier block. A walk over such entries, about one per block, finds the true ones.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtrail.session import shared_dir

BLOCK_BYTES = 1 << 20
#: Blocks that a task holds while it writes or reads them.
BLOCKS_AT_ONCE = 16
HEADER = 8
_STREAMS = ["stdout", "stdout", "stderr"]

_BLOCK = "file string, job_id string, container_id string, size long, split long, n long, data binary"
_CHAIN = "file string, pos long, last long, exit long, type int, leaves boolean"
_PIECES = "file string, job_id string, container_id string, stream string, at long, k long, pieces array<binary>"


def _written(df: DataFrame, name: str, rows_at_once: int | None = None) -> DataFrame:
    """``rows_at_once``: long rows that a task writes and reads back in one go."""
    path = shared_dir(df.sparkSession, name)
    limit = {"parquet.block.row.count.limit": rows_at_once} if rows_at_once else {}
    df.write.options(**limit).parquet(path)
    return df.sparkSession.read.parquet(path)


def _blocks(spark: SparkSession, path: str, block_bytes: int) -> DataFrame:
    """The bytes of all files in rows of about ``block_bytes``. Files are split by Spark, at newlines."""
    reader = spark.read.schema("value string, job_id string, container_id string").option("lineSep", "\n")
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        "job_id",
        "container_id",
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, parts, held = None, 0, [], 0

        def block() -> pa.RecordBatch:
            names = ["file", "job_id", "container_id", "size", "split", "n", "data"]
            return pa.RecordBatch.from_pylist([dict(zip(names, (*key, n, b"".join(parts))))])

        for batch in batches:
            for *of, value in zip(*(c.to_pylist() for c in batch.columns)):
                if of != key or held >= block_bytes:
                    if parts:
                        yield block()
                    n = n + 1 if of == key else 0
                    key, parts, held = of, [], 0
                parts += [value, b"\n"]
                held += len(value) + 1
        if parts:
            yield block()

    return _written(lines.mapInArrow(cut, _BLOCK), "frame-blocks", BLOCKS_AT_ONCE)


def _chains(data: bytes, ahead: bytes, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place in a block where a header could begin: the place, the last header of its chain inside the
    block, where that frame ends, and its stream. ``ahead`` are the bytes after the block, ``left`` the rest of the file."""
    b = np.frombuffer(data + ahead, dtype=np.uint8)[:left]
    n = max(0, min(len(data), len(b) - HEADER + 1))
    at = np.flatnonzero((b[:n] <= 2) & (b[1 : n + 1] == 0) & (b[2 : n + 2] == 0) & (b[3 : n + 3] == 0)) if n else np.zeros(0, np.int64)
    size = sum(b[at + 4 + i].astype(np.int64) << (24 - 8 * i) for i in range(4))
    to = at + HEADER + size
    slot = np.minimum(np.searchsorted(at, to), max(len(at) - 1, 0))
    chain = np.where(at[slot] == to, slot, np.arange(len(at))) if len(at) else slot
    while len(chain) and (chain[chain] != chain).any():
        chain = chain[chain]
    return at, at[chain], to[chain], b[at[chain]]


def _payloads(data: bytes, ahead: bytes, left: int, entry: int, carry_from: int, carry_type: int) -> dict[str, bytes]:
    """Payload bytes of a block by stream. The first frame begins at ``entry``; what comes before, from
    ``carry_from`` on, belongs to a frame of an earlier block. A frame that the file ends within is left out."""
    parts = {"stdout": [], "stderr": []}
    if entry <= left and carry_type >= 0:
        parts[_STREAMS[carry_type]].append(data[carry_from : min(entry, left)])
    b, p = (data + ahead)[:left], entry
    while p < len(data) and p + HEADER <= len(b) and b[p] <= 2 and b[p + 1 : p + 4] == b"\0\0\0":
        to = p + HEADER + int.from_bytes(b[p + 4 : p + HEADER], "big")
        if to > left:
            break
        parts[_STREAMS[b[p]]].append(data[p + HEADER : to])
        p = to
    return {stream: b"".join(found) for stream, found in parts.items()}


def read_frames(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines of container output laid out as ``<path>/job_id=…/container_id=…/file``, each file a run of frames:
    job_id, container_id, stream, line_no (from 0), line.

    Lines are put together across frames and numbered per stream over a container's files in name order; the end of a
    file ends a line. A file is read up to the first place that should be a header and is none; a last frame that is
    cut short is left out. Files must not be compressed. No task holds a file: rows per file are one or two for each
    block, and one line is the most that is ever put together.
    """
    blocks = _blocks(spark, path, block_bytes)
    place = ["file", "split", "n"]
    order = Window.partitionBy("file").orderBy("split", "n")
    slim = blocks.select(*place, F.length("data").cast("long").alias("len"), F.hex(F.substring("data", 1, HEADER - 1)).alias("head"))
    heads = F.collect_list("head").over(order.rowsBetween(1, HEADER - 1))
    placed = slim.select(
        *place,
        (F.sum("len").over(order) - F.col("len")).alias("at"),
        F.unhex(F.substring(F.array_join(heads, ""), 1, 2 * HEADER - 2)).alias("ahead"),
    )
    placed = _written(placed, "frame-places")

    def follow(block: pa.Table) -> pa.Table:
        found = []
        for file, at, left, data, ahead in _each(block, "file", "at", "left", "data", "ahead"):
            pos, last, to, kind = _chains(data, ahead, left)
            # Of chains that leave a block at one place one row names that; past the last header that fits nothing begins.
            leaves = np.zeros(len(pos), bool)
            leaves[np.unique(to, return_index=True)[1]] = True
            leaves &= (to >= min(len(data), left)) & (to <= left - HEADER)
            found.append(pa.table([[file] * len(pos), pos + at, last + at, to + at, kind.astype(np.int32), leaves], schema=chain))
        return pa.concat_tables(found)

    # A call gets one block: an Arrow batch of rows would hold thousands.
    chain = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("last", pa.int64()), ("exit", pa.int64()), ("type", pa.int32()), ("leaves", pa.bool_())])
    data = blocks.join(placed, place).withColumn("left", F.col("size") - F.col("at"))
    chains = _written(data.select(*place, "at", "left", "data", "ahead").groupBy(*place).applyInArrow(follow, _CHAIN), "frame-chains")
    entries = chains.where("leaves").select("file", F.col("exit").alias("pos"))
    entries = entries.unionByName(placed.select("file", F.lit(0).cast("long").alias("pos"))).distinct()

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        row = {p: i for i, p in enumerate(edges["pos"].tolist())}
        exits, at, taken = edges["exit"].tolist(), 0, []
        while at in row:
            taken.append(row[at])
            at = exits[taken[-1]]
        return edges.iloc[taken]

    # Entries are few beside the chains, which need not be sorted to be looked up.
    edges = chains.join(entries.hint("shuffle_hash"), ["file", "pos"], "left_semi")
    true = edges.groupBy("file").applyInPandas(walk, chains.schema)

    # Each block gets the last true chain that began before it: its last frame reaches into the block, or up to it.
    none = F.lit(None).cast("struct<last:long,exit:long,type:int>")
    marks = true.select("file", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.struct("last", "exit", "type").alias("c"), *[F.lit(None).cast("long").alias(x) for x in place[1:]])
    marks = marks.unionByName(placed.select("file", "at", F.lit(0).alias("kind"), none.alias("c"), *place[1:]))
    before = Window.partitionBy("file").orderBy("at", "kind", "split", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marks.withColumn("c", F.last("c", ignorenulls=True).over(before)).where("kind = 0").select(*place, "c")

    def take(block: pa.Table) -> pa.Table:
        rows = []
        for file, job, box, at, left, data, ahead, last, exit_, kind in _each(block, *shown):
            # A chain that broke off before this block tells nothing about it.
            if at and (exit_ is None or exit_ < at):
                continue
            carry = max(last + HEADER - at, 0) if at else 0
            found = _payloads(data, ahead, left, exit_ - at if at else 0, carry, kind if at else -1)
            for stream, payload in found.items():
                if payload:
                    pieces = payload.split(b"\n")
                    rows.append({"file": file, "job_id": job, "container_id": box, "stream": stream, "at": at, "k": len(pieces) - 1, "pieces": pieces})
        return pa.Table.from_pylist(rows, piece)

    piece = pa.schema([*[(c, pa.string()) for c in ("file", "job_id", "container_id", "stream")], ("at", pa.int64()), ("k", pa.int64()), ("pieces", pa.list_(pa.binary()))])
    shown = ["file", "job_id", "container_id", "at", "left", "data", "ahead", "last", "exit", "type"]
    full = data.join(carried, place).select("split", "n", *shown[:-3], "c.*")
    pieces = _written(full.groupBy(*place).applyInArrow(take, _PIECES), "frame-pieces", BLOCKS_AT_ONCE)
    return _lines(pieces)


def _each(block: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(block.column(name).to_pylist() for name in names))


def _lines(pieces: DataFrame) -> DataFrame:
    """Lines from pieces: those inside a block are whole, those at its ends are put together by their number."""
    key = ["file", "stream"]
    slim = pieces.select(*key, "job_id", "container_id", "at", "k", F.length(F.element_at("pieces", -1)).alias("open"))
    first = slim.select(*key, "at", (F.sum("k").over(Window.partitionBy(*key).orderBy("at")) - F.col("k")).alias("first"))
    files = slim.groupBy(*key, "job_id", "container_id").agg(F.sum("k").alias("ends"), F.max_by("open", "at").alias("open"))
    n_lines = F.col("ends") + (F.col("open") > 0).cast("long")
    earlier = Window.partitionBy("job_id", "container_id", "stream").orderBy("file")
    files = files.select(*key, n_lines.alias("n_lines"), (F.sum(n_lines).over(earlier) - n_lines).alias("before"))

    rows = pieces.join(first, [*key, "at"]).join(files, key)
    rows = rows.select(*key, "job_id", "container_id", "at", "k", "first", "n_lines", "before", F.posexplode("pieces").alias("i", "piece"))
    rows = rows.withColumn("no", F.col("first") + F.col("i")).where(F.col("no") < F.col("n_lines"))
    rows = rows.withColumn("line_no", F.col("before") + F.col("no"))
    container = ["job_id", "container_id", "stream", "line_no"]
    inside = (F.col("i") > 0) & (F.col("i") < F.col("k"))
    whole = rows.where(inside).select(*container, F.col("piece").alias("line"))
    parts = rows.where(~inside).groupBy(*container).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    lines = whole.unionByName(parts.select(*container, joined.alias("line")))
    return lines.withColumn("line", F.col("line").cast("string"))
