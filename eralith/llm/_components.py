"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.llm._spark import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not itself the least of its component.

    Each round links every node's larger neighbours to its least one, then its smaller ones; in some log^2(n) rounds all
    hang from the least node. A node with a third of all edges is one row of a partial aggregate, and the join with
    it may be split. Every round is written, so lost executors cost one round at most.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = written(e)
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
