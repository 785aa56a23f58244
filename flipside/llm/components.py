"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flipside.llm.common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links every node's larger (or smaller) neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    linked = both.join(least, "a")
    if larger:
        return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): every node of `edges` (a, b) but the least of its component.

    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.  Loops (a = b) say nothing.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    mark = None
    while True:
        now = written(_star(_star(now, True), False), "star")
        row = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(row) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("least"))
        mark = tuple(row)
