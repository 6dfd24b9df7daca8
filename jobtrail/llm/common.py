"""Helpers shared by the training-data operators."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.session import shared_dir

#: The white space that parts words: space and U+0009 to U+000D. Everything else belongs to a word.
GAPS = " \t\n\x0b\x0c\r"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]"

#: Pre-filters are tables of at most so many hash values, whatever the size of the corpus.
FILTER = 1 << 20
#: Keys that hold at least this part of all rows are joined apart from the others; there are at most so many.
HEAVY = 10_000
#: Rows of a few numbers that fill a task, and tasks that share them at least.
PACKED, LEAST_TASKS = 100_000, 8
U64 = np.uint64


def mixed64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame) -> DataFrame:
    """The rows written to the folder all executors share, with the lineage cut: a lost executor loses nothing.

    For slim tables that later steps read more than once. The folder is the one ``spark.checkpoint.dir`` names.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: smaller than a checkpoint where columns repeat or go unread."""
    folder = shared_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def packed(df: DataFrame, rows: int, per_task: int = PACKED) -> DataFrame:
    """The same rows in as many partitions as ``rows`` fill, if there are more: a shuffle writes files for each."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // per_task)))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN))


def n_words(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words(text)).cast("long")


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def parts_for(df: DataFrame, weight: Column, per_part: int, least: int = 1) -> int:
    """So many parts that each holds about ``per_part`` of the summed weight. One number comes to the driver."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return max(least, -(-int(total) // per_part))


def in_filter(rows: DataFrame, column: str, wanted: DataFrame, flag: str) -> DataFrame:
    """Rows with a boolean: false where ``column`` is surely not among ``wanted``'s.

    Only hash values are sent to all executors, ``FILTER`` of them at most; over very large inputs all are true.
    """
    cell = F.pmod(F.xxhash64(column), F.lit(FILTER)).cast("int")
    cells = F.broadcast(wanted.select(cell.alias("__cell")).distinct().withColumn(flag, F.lit(True)))
    return rows.withColumn("__cell", cell).join(cells, "__cell", "left").drop("__cell").withColumn(flag, F.coalesce(flag, F.lit(False)))


def prefiltered(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among ``wanted``'s: less to shuffle for the exact join that has to follow."""
    return in_filter(rows, column, wanted, "__may").where("__may").drop("__may")


def attached(rows: DataFrame, found: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``found``, which has one row per ``key`` and in ``count`` how many rows have it.

    A key that holds a ten-thousandth of all rows or more would put them into one task. There are at most ``HEAVY``
    such keys, whatever the input, so what is found of them is broadcast; rows of the others are shuffled. Both
    tables are read more than once: pass materialised ones. The count is not kept; no key is null.
    """
    total = F.lit(rows.count())
    heavy = F.broadcast(found.where(F.col(count) * HEAVY >= total).drop(count).withColumn("__heavy", F.lit(True)))
    light = found.where(F.col(count) * HEAVY < total).drop(count)
    marked = rows.join(heavy, key, "left")
    direct = marked.where("__heavy").drop("__heavy")
    return direct.unionByName(marked.where("__heavy is null").select(*rows.columns).join(light, key, "left"))
