"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. Returns node, root (the smallest node that links reach), for nodes with a link.

    Each step replaces links by links to smaller nodes until every component is a star. A node's
    neighbours are never collected: only their minimum is, so a hub of any degree is two joins.
    """
    e = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node move to the smallest node next to it
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = durable(large, "links-large")
        # small star: a node's smaller neighbours and the node itself move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = durable(small.filter("a <> b").distinct(), "links-small")
        # done when each node has one link and no link's end has one: all components are stars
        ends = e.select(F.col("b").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("own")).unionByName(e.select(F.col("a").alias("node"), F.lit(0).alias("end"), F.lit(1).alias("own")))
        per = ends.groupBy("node").agg(F.max("end").alias("end"), F.sum("own").alias("own"))
        if per.filter("own > 1 OR (own > 0 AND end > 0)").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
