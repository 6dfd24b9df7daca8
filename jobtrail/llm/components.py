"""Connected components of an undirected graph, as alternating star operations over an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import materialised, packed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that an edge names; a component is called by its smallest node.

    Each round points all larger neighbours of a node, then all smaller ones, at the smallest node it knows
    (Kiveris et al., "Connected components in MapReduce and beyond", 2014), until every node points at the smallest
    of its component. The rounds grow with the logarithm of a component's size. Two numbers per round come to the
    driver. Edges with a null end and loops say nothing.

    The count of the edges is known in each round, and no step of it has more than two rows for each: all have as many
    tasks as those rows fill, not as many as the session has shuffle partitions.
    """
    x, y = F.col(a), F.col(b)
    stars = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    stars = materialised(stars)
    before = None
    while True:
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        stars = packed(stars, now[0])
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = packed(both.groupBy("u").agg(F.min("v").alias("m")), 2 * now[0]).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = packed(packed(large, now[0]).distinct(), now[0])
        smallest = packed(large.groupBy("u").agg(F.min("v").alias("m")), now[0])
        joined = packed(large.join(smallest, "u"), now[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        stars = materialised(packed(small.distinct(), 2 * now[0]))
    stars = packed(stars, now[0])
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
