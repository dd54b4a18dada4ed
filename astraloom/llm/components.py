"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum by node and an equi-join. A hub may have a large part of all edges, so a node's edges are
dealt over `SALTS` sub-keys by the other end: minima are taken per sub-key first, those of a node meet next (at most
`SALTS` rows each), and go back to the sub-keys, where the edges still lie. Each round is a written table, which
replaces the one before it, so lost executors cost one round at most. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.llm.common import release, written

SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v): u, v and m, the least v of u."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = part.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))  # at most SALTS numbers
    return dealt.join(least.select("u", F.explode("salts").alias("salt"), "m"), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = _with_least(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    moved = down.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any one orderable type: (node, root) for every node that has an edge to another; root is the least node it reaches.

    Repeated edges, edges in both directions and an empty table are as one would expect; null ends have no edge.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        last, now = now, written(_small_star(_large_star(now)), "edges")
        release(last)
        before, mark = mark, _mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
