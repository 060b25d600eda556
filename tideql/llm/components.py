"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for every node that is not its component's smallest; v is the smallest.

    ``links`` has two columns of ids of any type with an order.  The smallest neighbours are partially
    aggregated and written, which leaves plain joins: a hub, on which a third of all edges may hang, is
    split by Spark's skew join, and no group is gathered.  The number of steps is logarithmic in a
    component's length.
    """
    a, b = links.columns
    edges = scratch.table(_ends(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.table(_ends(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        smallest = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(smallest, "u")
        after = scratch.table(_ends(small.select("v", "m").toDF("u", "v").union(smallest.toDF("u", "v"))))
        scratch.drop(edges, least, large, smallest)
        edges, now = after, state(after)
        if now == before:
            break
        before = now
    return edges
