"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Of all rates between 0 and ``max_copies`` that give
every source its target of words, entropy balancing takes those nearest to 1 (least Kullback-Leibler divergence).
They are exponential tilts, ``min(max_copies, exp(tilt * size / mean size))``, with one tilt per source, the
solution of a convex dual that Newton's method finds. Spark sums value and slope over all sources in each step.
Documents of a source with the same size have the same rate, so the sums run over one row per source and size.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import materialised, n_words

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
MAX_STEPS = 60
TOLERANCE = 1e-6
#: Documents of one source and size that are ranked together; more are ranked in several pieces.
RANKED = 1000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: shares by weight of all words, capped and reshared.

    Sources in the order of code points, null last, get the weights in turn. A target stops at ``max_copies`` times
    the size of its source; what is cut off goes to the others by weight until no target is above its limit. In
    closed form: sources ordered by limit / weight are capped up to the first that its share does not fill.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    w = by_source.withColumn("__w", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn))
    w = w.withColumn("__limit", F.col("source_size").cast("double") * max_copies)
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("__limit") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns(
        {
            "__total": F.sum("source_size").over(everything).cast("double"),
            "__weights": F.sum("__w").over(everything),
            "__capped": F.coalesce(F.sum("__limit").over(ranked), F.lit(0.0)),
            "__gone": F.coalesce(F.sum("__w").over(ranked), F.lit(0.0)),
        }
    )
    level = (F.col("__total") - F.col("__capped")) / (F.col("__weights") - F.col("__gone"))
    w = w.withColumn("__level", level)
    full = F.col("__limit") <= F.col("__w") * F.col("__level")
    final = F.max(F.when(~full, F.struct(-F.col("__limit") / F.col("__w"), F.col("__level")))).over(everything)["__level"]
    w = w.withColumns({"__full": full, "__final": final})
    target = F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__w") * F.col("__final"))
    return w.select("source", "source_size", F.least(target, F.col("__limit")).alias("target"))


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def solve_tilts(cells: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, tilt`` by Newton steps on the dual, all sources at once, kept inside a shrinking bracket.

    ``cells`` has ``source, size, n``. The words a tilt yields rise with it, so each step also narrows the bracket
    and a step that would leave it bisects instead. Only the number of unfinished sources comes to the driver.
    """
    top = math.log(max_copies)
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("__mean"))
    mean = mean.withColumnRenamed("source", "__s")
    base = targets.join(mean, _same("source", "__s")).drop("__s").where("source_size > 0")
    state = base.withColumns(
        {
            "tilt": F.lit(0.0),
            "__low": F.lit(-700.0) * F.col("__mean"),
            # At these ends the rate of a document of one word is next to 0, or at its limit.
            "__high": F.lit(top) * F.col("__mean"),
            "__done": F.col("target") >= F.col("source_size") * F.lit(float(max_copies)) * (1 - TOLERANCE),
        }
    ).withColumn("tilt", F.when(F.col("__done"), F.col("__high")).otherwise(F.col("tilt")))
    state = materialised(state)
    sized = cells.where("size > 0").withColumnRenamed("source", "__s")
    for _ in range(MAX_STEPS):
        if not state.where(~F.col("__done")).limit(1).count():
            break
        z = F.col("size") / F.col("__mean")
        power = F.col("tilt") * z
        rate = F.exp(F.least(power, F.lit(top)))
        got = F.sum(F.col("n") * F.col("size") * rate)
        slope = F.sum(F.when(power < top, F.col("n") * F.col("size") * rate * z).otherwise(0.0))
        sums = sized.join(state, _same("__s", "source")).groupBy(F.col("source").alias("__k")).agg(got.alias("__got"), slope.alias("__slope"))
        s = state.join(sums, _same("source", "__k")).drop("__k")
        miss = F.col("target") - F.col("__got")
        close = F.col("__done") | (F.abs(miss) <= TOLERANCE * F.col("target"))
        s = s.withColumns(
            {
                "__low": F.when(miss > 0, F.col("tilt")).otherwise(F.col("__low")),
                "__high": F.when(miss < 0, F.col("tilt")).otherwise(F.col("__high")),
                "__newton": F.col("tilt") + F.when(F.col("__slope") > 0, miss / F.col("__slope")),
                "__done": close,
            }
        )
        inside = (F.col("__newton") > F.col("__low")) & (F.col("__newton") < F.col("__high"))
        middle = (F.col("__low") + F.col("__high")) / 2
        state = materialised(
            s.withColumn("tilt", F.when(F.col("__done"), F.col("tilt")).when(inside, F.col("__newton")).otherwise(middle)).select(*state.columns)
        )
    return state.select("source", "tilt", "__mean")


def _round_cells(max_copies: int):
    """Copies of each cell of a source, largest size first; what rounding leaves over goes into the next cell."""

    def rounded(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, ignore_index=True)
        copies, owed = np.zeros(len(cells), dtype="int64"), 0.0
        for i, (size, n, rate) in enumerate(zip(cells["size"].to_numpy(), cells["n"].to_numpy(), cells["rate"].to_numpy())):
            words = rate * n * size + owed
            copies[i] = min(max(round(words / size), 0), max_copies * n)
            owed = words - float(copies[i]) * size
        return cells.assign(copies=copies)[["source", "size", "copies"]]

    return rounded


def mix(rows: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """Rows with ``source``, ``size`` (words) and ``row_hash`` get ``source_size, target, rate, copies``.

    ``copies`` is the whole number of times (0 to ``max_copies``) the mix takes the row. Null sources form a source
    of their own. Rows without words have rate 1 and one copy; a source without words has target 0. Columns with
    the names of results are replaced. ``row_hash`` must tell rows apart for the mix to agree between runs; rows
    equal in it and in source and size share copies in any order. An empty table gives an empty table.

    Rounding goes over one row per source and size: its work grows with the number of different sizes, not of rows.
    Rows of one source and size are ranked by hash in pieces, so neither a hot source nor a hot size meets in one task.
    """
    rows = rows.drop("source_size", "target", "rate", "copies")
    cells = materialised(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = materialised(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, max_copies))
    tilts = solve_tilts(cells, targets, max_copies).withColumnRenamed("source", "__s")
    top = math.log(max_copies)
    rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("__mean"), F.lit(top)))
    rated = cells.join(tilts, _same("source", "__s"), "left").select("source", "size", "n", F.when(F.col("size") > 0, rate).otherwise(1.0).alias("rate"))
    schema = rated.select("source", "size").schema.add("copies", "long")
    whole = rated.where("size > 0").groupBy("source").applyInPandas(_round_cells(max_copies), schema)
    whole = whole.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").alias("__copies"))
    plan = rated.join(whole, _same("source", "__s") & (F.col("size") == F.col("__z")), "left").drop("__s", "__z")
    goals = targets.withColumnRenamed("source", "__s")
    plan = plan.join(goals, _same("source", "__s"), "left").drop("__s")
    plan = materialised(plan.withColumn("__copies", F.coalesce("__copies", "n")))
    plan = plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("n").alias("__n"), "__copies", "rate", "source_size", "target")
    joined = rows.join(plan, _same("source", "__s") & (F.col("size") == F.col("__z"))).drop("__s", "__z")
    # floor(copies / n) for everyone, one more for the first by hash.
    joined = joined.withColumns(
        {
            "__turn": F.xxhash64(F.lit(seed), "row_hash"),
            "__each": F.floor(F.col("__copies") / F.col("__n")).cast("long"),
        }
    )
    pieces = F.ceil(F.col("__n") / RANKED)
    joined = joined.withColumn("__piece", F.floor((F.shiftrightunsigned("__turn", 1).cast("double") / 2.0**63) * pieces).cast("long"))
    joined = joined.withColumn("__extra", F.col("__copies") - F.col("__each") * F.col("__n"))
    per_piece = rows.join(plan.select("__s", "__z", "__n"), _same("source", "__s") & (F.col("size") == F.col("__z")) & (F.col("__n") > RANKED))
    per_piece = per_piece.withColumn("__turn", F.xxhash64(F.lit(seed), "row_hash"))
    per_piece = per_piece.withColumn("__piece", F.floor((F.shiftrightunsigned("__turn", 1).cast("double") / 2.0**63) * pieces).cast("long"))
    per_piece = per_piece.groupBy("__s", "__z", "__piece").agg(F.count(F.lit(1)).alias("__m"))
    earlier = Window.partitionBy("__s", "__z").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_piece.select(
        F.col("__s").alias("__s2"), F.col("__z").alias("__z2"), F.col("__piece").alias("__p2"), F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before")
    )
    joined = joined.join(earlier, _same("source", "__s2") & (F.col("size") == F.col("__z2")) & (F.col("__piece") == F.col("__p2")), "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "__piece").orderBy(F.shiftrightunsigned("__turn", 1), "row_hash"))
    joined = joined.withColumn("__rank", rank + F.coalesce("__before", F.lit(0)))
    copies = F.col("__each") + (F.col("__rank") <= F.col("__extra")).cast("long")
    return joined.withColumn("copies", copies).select(*rows.columns, "source_size", "target", "rate", "copies")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The input's rows, each as often as the mix takes it, in no order. ``docs`` has a ``doc_id``.

    The mix is worked out on slim rows; whole rows are shuffled once, to meet their number of copies. Rows equal in
    doc_id and text share their copies out among themselves.
    """
    key = F.xxhash64("doc_id", text)
    slim = materialised(docs.select(F.col("doc_id").alias("__d"), key.alias("row_hash"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")))
    copies = mix(slim, weights, max_copies).groupBy("__d", "row_hash").agg(F.sum("copies").alias("__c"), F.count(F.lit(1)).alias("__m"))
    copies = copies.where("__c > 0").withColumnRenamed("row_hash", "__h")
    joined = docs.withColumn("__key", key).join(copies, _same("doc_id", "__d") & (F.col("__key") == F.col("__h")))
    turn = F.row_number().over(Window.partitionBy("__d", "__h").orderBy("__h"))
    own = F.floor(F.col("__c") / F.col("__m")) + (F.col("__turn") <= F.col("__c") % F.col("__m")).cast("long")
    times = joined.withColumn("__turn", turn).withColumn("__times", F.explode(F.array_repeat(F.lit(1), own.cast("int"))))
    return times.select(*docs.columns)
