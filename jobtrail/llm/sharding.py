"""Two-pass external shuffle into shards whose row counts differ by one at most.

Pass 1 scatters rows by a seeded hash into buckets that fit in memory. Pass 2 shuffles each bucket (Spark's
``shuffle`` is a seeded Fisher-Yates shuffle) and deals the rows out in the order of buckets: row number p of the
whole order goes to shard p mod n, slot p div n.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import parts_for, text_bytes

BUCKET_BYTES = 16 << 20


def shuffled_shards(
    rows: DataFrame, n_shards: int, size: str, by: Sequence[str], seed: int = 0, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The input with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    ``size`` names the column with the bytes of a row; buckets hold about ``bucket_bytes`` of them. ``by`` names the
    columns that the hash scatters by and that order a bucket before it is shuffled: with the same rows and seed, a
    rerun gives the same places. Rows equal in ``by`` get places among themselves in any order. Columns named
    ``shard`` or ``slot`` are replaced. Nulls hash like other values; an empty table gives an empty table.

    Rows are scattered evenly whatever they hold, so no bucket is hot unless single rows repeat in all of ``by``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    rows = rows.drop("shard", "slot")
    n_buckets = parts_for(rows, F.col(size), bucket_bytes)
    keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in by]), F.lit(n_buckets)))
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # One row per bucket, not per document: this is the only total order.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    columns = [*by, *[c for c in rows.columns if c not in by]]
    row = F.struct(*[F.col(c) for c in columns])
    # A fixed number of partitions, and buckets in order inside each: the seed of ``shuffle`` meets the same buckets in every run and retry.
    buckets = keyed.repartition(n_buckets, "__bucket").groupBy("__bucket").agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    mixed = buckets.sortWithinPartitions("__bucket").select("__bucket", F.shuffle("__rows", seed).alias("__rows"))
    placed = mixed.join(offsets, "__bucket").select("__before", F.posexplode("__rows").alias("__at", "__row"))
    place = F.col("__before") + F.col("__at")
    return placed.select("__row.*", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot")).select(
        *rows.columns, "shard", "slot"
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` of documents: UTF-8 bytes plus 8, and the checksum of the text (null: of none)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (text_bytes(F.col("text")) + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Write placed rows as Parquet, one folder per shard, rows in slot order in each file.

    Large shards are cut into files by ranges of slots, so no task writes more than a part of a shard.
    """
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
