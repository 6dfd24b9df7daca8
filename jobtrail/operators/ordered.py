"""Order-based building blocks that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, which fails when one key holds a
large share of the table. These helpers window inside (key, block) instead, where a block is a coarse step of
the sort order (an hour, a range of sequence numbers), and carry what must cross a border through a table of
one row per block. The big side is shuffled once.

Keys and sort columns must not be NULL (the validity filters see to that).
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEQ_BLOCK = 1_000_000


def seq_block(c: Column | str, size: int = SEQ_BLOCK) -> Column:
    """Block of a sequence number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size))


def time_block(c: Column | str, seconds: int = 3600) -> Column:
    """Block of a timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))


def _blocked(df: DataFrame, blocks: Sequence[Column]):
    names = [f"_b{i}" for i in range(len(blocks))]
    return df.withColumns(dict(zip(names, blocks))), names


def _sorted(cols, desc: bool):
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return [c.desc() if desc else c.asc() for c in cols]


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    blocks: Sequence[Column],
    name: str = "rn",
    desc: bool = False,
    upto: int | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as column ``name``, from 1.

    ``blocks`` coarsen ``order``: sorting by them first must not change the order. With ``upto`` only rows
    numbered up to it are kept; each task then drops the rest of its rows before the shuffle. ``per_key`` is a
    table of one row per key whose other columns are attached on the way.
    """
    d, b = _blocked(df, blocks)
    local = d.withColumn(name, F.row_number().over(W.partitionBy(*keys, *b).orderBy(*_sorted(order, desc))))
    if upto is not None:
        local = local.where(F.col(name) <= upto)
    sizes = d.groupBy(*keys, *b).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(*_sorted(b, desc)).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *b, F.sum("_n").over(before).alias("_before"))
    extra = []
    if per_key is not None:
        extra = [c for c in per_key.columns if c not in keys]
        offsets = offsets.join(per_key, list(keys), "left")
    out = local.join(offsets, [*keys, *b], "left")
    out = out.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col(name))
    if upto is not None:
        out = out.where(F.col(name) <= upto)
    return out.select(*df.columns, name, *extra)


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: dict[str, str],
    blocks: Sequence[Column],
) -> DataFrame:
    """Add the previous row's values: ``cols`` maps new column names to source columns."""
    d, b = _blocked(df, blocks)
    row = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    inside = W.partitionBy(*keys, *b).orderBy(*order)
    local = d.withColumn("_prev", F.lag(row).over(inside))
    last = d.groupBy(*keys, *b).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, *b, F.lag("_last").over(W.partitionBy(*keys).orderBy(*b)).alias("_carried"))
    out = local.join(carried, [*keys, *b], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carried"))
    return out.select(*df.columns, *[prev[new].alias(new) for new in cols])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    blocks: Sequence[Column],
    name: str,
    agg: Callable = F.max,
    merge: Callable = F.greatest,
    desc: bool = False,
) -> DataFrame:
    """Running ``agg`` of ``value`` per key up to and including the row; ``merge`` joins two partial results."""
    d, b = _blocked(df, blocks)
    inside = W.partitionBy(*keys, *b).orderBy(*_sorted(order, desc)).rowsBetween(W.unboundedPreceding, 0)
    local = d.withColumn("_run", agg(value).over(inside))
    tops = d.groupBy(*keys, *b).agg(agg(value).alias("_top"))
    before = W.partitionBy(*keys).orderBy(*_sorted(b, desc)).rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, *b, agg("_top").over(before).alias("_carried"))
    out = local.join(carried, [*keys, *b], "left")
    merged = F.when(F.col("_carried").isNull(), F.col("_run")).otherwise(merge(F.col("_run"), F.col("_carried")))
    return out.select(*df.columns, merged.alias(name))


def newest(df: DataFrame, order: Sequence[str], n: int, block: Column) -> DataFrame:
    """The last ``n`` rows in ``order`` over the whole table.

    Counting per block first finds the block the n-th row lies in; only rows from there on are sorted.
    """
    d, (b,) = _blocked(df, [block])
    sizes = d.groupBy(b).agg(F.count(F.lit(1)).alias("_n"))
    after = W.orderBy(F.col(b).desc()).rowsBetween(W.unboundedPreceding, -1)
    # One row per block, so this unpartitioned window stays small.
    cut = sizes.withColumn("_after", F.coalesce(F.sum("_n").over(after), F.lit(0))).where(F.col("_after") < n)
    first = cut.agg(F.min(b)).scalar()
    return d.where(F.col(b) >= first).orderBy(*_sorted(order, True)).limit(n).select(*df.columns)


def nearest_rank(
    df: DataFrame, by: Sequence[str], value: str, q: float, name: str, width: int = 60_000, weight: str | None = None
) -> DataFrame:
    """Exact nearest-rank quantile of an integer column per group: the ceil(q*n)-th smallest value.

    Counts per value range find the range that holds the rank; only that range is counted value by value, so
    no task ever holds all values of a group. ``weight`` is a column of counts, 0 for rows to leave out.
    """
    keys = list(by)
    count = F.sum(weight) if weight else F.count(value)
    block = F.coalesce(F.floor(F.col(value) / F.lit(width)), F.lit(0))
    d = df.withColumn("_b", block)
    group = W.partitionBy(*keys)
    total = F.sum("_n").over(group)
    cum = F.sum("_n").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    rank = F.greatest(F.ceil(F.lit(q) * total.cast("double")), F.lit(1))
    hit = (
        d.groupBy(*keys, "_b")
        .agg(count.alias("_n"))
        .select(*keys, "_b", "_n", cum.alias("_cum"), rank.alias("_rank"))
        .where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_n") < F.col("_rank")))
        .select(*keys, "_b", (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_within"))
    )
    fine = d.join(hit, [*keys, "_b"]).groupBy(*keys, "_within", value).agg(count.alias("_n"))
    seen = F.sum("_n").over(group.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    reached = fine.withColumn("_seen", seen).where((F.col("_n") > 0) & (F.col("_seen") >= F.col("_within")))
    return reached.groupBy(*keys).agg(F.min(value).alias(name))
