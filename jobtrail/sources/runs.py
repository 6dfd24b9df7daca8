"""A table that takes one folder per micro-batch and merges folders as it grows.

Batch n writes the run n-n. Before it does, runs of earlier batches are merged where ``FANOUT`` of one size stand side
by side, so a row is written again once per level, and a reader opens fewer than ``FANOUT`` runs per level, whatever the
number of batches. Runs are never changed. A merged run counts from its success file on, and what it replaces stays
until the next merge of that size, so a reader that has listed the folders can finish. Only earlier batches are merged:
a batch that is replayed finds the table as it was.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.sources import files

FANOUT = 8
BATCH = "batch_id"
Merge = Callable[[DataFrame, bool], DataFrame]


def _folder(path: str, run: tuple[int, int]) -> str:
    return f"{path}/run={run[0]}-{run[1]}"


def _all(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    names = [n[4:].split("-") for n in files.folders(spark, path) if n.startswith("run=")]
    return [r for a, b in names if files.committed(spark, _folder(path, r := (int(a), int(b))))]


def cover(spark: SparkSession, path: str, before: int | None = None, since: int = 0) -> list[tuple[int, int]]:
    """The fewest runs that hold all batches from ``since`` on and before ``before``, in order."""
    held = [r for r in _all(spark, path) if r[0] >= since and (before is None or r[1] < before)]
    out, upto = [], since - 1
    for run in sorted(held, key=lambda r: (r[0], -r[1])):
        if run[0] > upto:
            out.append(run)
            upto = run[1]
    return out


def read(spark: SparkSession, path: str, before: int | None = None, since: int = 0) -> DataFrame | None:
    """Rows of all batches before ``before``, or None where there are none."""
    found = [_folder(path, r) for r in cover(spark, path, before, since)]
    return spark.read.parquet(*found) if found else None


def write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_folder(path, (batch_id, batch_id)))


def compact(spark: SparkSession, path: str, batch_id: int, merge: Merge) -> None:
    """Merge runs that are due before batch ``batch_id``. ``merge`` is told whether the rows go back to the first batch."""
    size = FANOUT
    while batch_id and batch_id % size == 0:
        run = batch_id - size, batch_id - 1
        rows = read(spark, path, batch_id, run[0])
        if rows is not None and not files.committed(spark, _folder(path, run)):
            merge(rows, run[0] == 0).write.mode("overwrite").parquet(_folder(path, run))
        # What runs of this size have replaced a generation ago.
        for old in _all(spark, path):
            if old[1] < run[0] and any(a <= old[0] and old[1] <= b and (a, b) != old for a, b in _all(spark, path)):
                files.remove(spark, _folder(path, old))
        size *= FANOUT


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of its latest batch."""
    rest = [F.col(c) for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), BATCH).alias("_r")).select(key, "_r.*").select(*rows.columns)


def bucket(key: Column | str, n: int = 64) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
