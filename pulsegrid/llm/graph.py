"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the ``a``-``b`` edges that has an edge to another.

    Large-star and small-star rounds, each a sum by node and a join, written to the shared folder, until every node hangs on the
    smallest of its component.  The number of rounds grows with the logarithm of the nodes.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        before = now
        # Large star: larger neighbours of a node go to the smallest one around it.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        joined = now.join(least, "u")
        now = written(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(got):
            break
        mark = tuple(got)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
