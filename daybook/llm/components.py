"""Connected components of a graph of long ids, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every id in ``a, b``: the smallest id that can be reached.

    Alternates two star operations (each node's larger neighbours, then its smaller ones and itself,
    are tied to its smallest neighbour), which needs a logarithmic number of rounds and never more
    edges than at the start. A null end or a loop is ignored; no edges give no rows. Each round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    links = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stage(links.distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        links = stage(small.distinct(), "links")
        # an order-free digest of the edges; equal after a whole round means a fixed point
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
