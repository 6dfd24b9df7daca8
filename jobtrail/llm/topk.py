"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

The vectors are dealt into blocks. Inside a block each dimension is a list sorted by value. A query reads the lists
of its dimensions from the end where its contribution is largest. At any depth a vector's score lies between bounds:
what has been read of it plus, for each list where it has not come up, the list's last contribution (lower bound) or
the contribution at the present depth (upper bound). Vectors whose upper bound is below the k-th best lower bound
cannot qualify and drop out; reading stops when no more than k are left or the lists end, and those left get their
final scores. Each query first reads the block it lies in; the k-th score found there is a lower bound for all other
blocks, which then stop early. The blocks' best rows are merged.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import materialised

BLOCK_ROWS, QUERY_ROWS = 4096, 4096
#: Parts of the lists read before the bounds are compared again.
DEPTHS = (0.6, 0.9)


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def nra(query: np.ndarray, values: np.ndarray, ascending: np.ndarray, k: int, known=None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that may be among the k best of ``values`` and their exact scores.

    ``ascending`` has each column of ``values`` sorted. ``known`` is a score that k vectors are known to reach, here
    or elsewhere; without it the bound comes from these rows. Rows that tie with the k-th score all stay.
    """
    rows = np.arange(len(values))
    if len(rows) <= k and known is None:
        return rows, values @ query
    last = np.where(query > 0, ascending[0], ascending[-1]) * query
    gains = values * query
    for part in DEPTHS:
        depth = int(part * (len(values) - 1))
        frontier = np.where(query > 0, ascending[-1 - depth], ascending[depth]) * query
        upper = np.maximum(gains, frontier).sum(axis=1)
        if known is None:
            lower = np.where(gains >= frontier, gains, last).sum(axis=1)
            stay = upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
        else:
            stay = upper >= known
        if not stay.all():
            rows, gains = rows[stay], gains[stay]
        if len(rows) <= k:
            break
    return rows, gains.sum(axis=1)


def _search_block(k: int):
    def search(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *map(len, queries["asked"]), *map(len, block["v"])])
        asked, values = _matrix(queries["asked"], width), _matrix(block["v"], width)
        ids = block["vec_id"].to_numpy()
        largest = int(np.abs(asked).max(initial=0)) * int(np.abs(values).max(initial=0)) * max(width, 1)
        if largest >= 2**62:
            asked, values = asked.astype(object), values.astype(object)
        elif largest < 2**53:  # products and sums are exact
            kind = np.float32 if largest < 2**24 else np.float64
            asked, values = asked.astype(kind), values.astype(kind)
        ascending = np.sort(values, axis=0)
        found = []
        bars = [None if pd.isna(b) else int(b) for b in queries["bar"]]
        for query_id, q, bar in zip(queries["query_id"].to_numpy(), asked, bars):
            rows, scores = nra(q, values, ascending, k + 1, bar) if len(ids) else ([], [])
            best = sorted(((-int(s), int(ids[r])) for r, s in zip(rows, scores) if ids[r] != query_id))[:k]
            found += [(query_id, vec_id, -s) for s, vec_id in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k highest integer inner products, ties to smaller ids.

    Both inputs have ``vec_id`` and ``v`` (array of long; see ``quantised``). Vectors with a query's own id are not
    candidates for it. Rows that repeat both id and vector count once; rows without id or vector take no part. Where
    lengths differ, missing components count 0. Fewer than k candidates are all returned; empty inputs give no rows.
    Scores must fit a long.

    Every block of vectors meets every block of queries, and each pair returns k rows per query at most.
    """
    vectors = vectors.select("vec_id", "v").where("vec_id is not null and v is not null").dropDuplicates()
    queries = queries.where("vec_id is not null and v is not null").select(F.col("vec_id").alias("query_id"), F.col("v").alias("asked")).dropDuplicates()
    n_vectors, n_queries = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n_vectors // block_rows)), max(1, -(-n_queries // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    right = vectors.withColumn("b", dealt("vec_id", blocks)).withColumn("g", every(groups))

    def search(left: DataFrame) -> DataFrame:
        return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(_search_block(k), "query_id long, vec_id long, score long")

    left = queries.withColumn("g", dealt("query_id", groups))
    own = search(left.withColumns({"b": dealt("query_id", blocks), "bar": F.lit(None).cast("long")}))
    # Of several vectors under one id each asks for itself; the least bound holds for all.
    reached = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    bars = materialised(reached.where(F.col("n") == k).select("query_id", F.col("low").alias("bar")))
    found = search(left.join(bars, "query_id", "left").withColumn("b", every(blocks)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
