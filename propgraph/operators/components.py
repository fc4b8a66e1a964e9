"""Connected components of a graph held in a DataFrame.

Edges are replaced round by round: every node links its larger neighbours to the least node it
sees (large star), then every node links its smaller neighbours to the least of them (small star).
After a number of rounds that grows with the logarithm of the longest chain, each edge joins a node
to its component's least node. Nothing but one count and one checksum a round reaches the driver.
Minima are summed up per task before rows move, and a hub's least neighbour reaches its edges by a
broadcast (``common.lookup``), so no node gathers its edges in one task. Nodes may be of any type that
has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup


#: Edges of which one node may gather all in one task.
FEW = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, n: int, few: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"), "w")
    out = lookup(both.filter("b > a"), "a", least, "n", "w", 2 * n, few=few).filter("b <> m")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, n: int, few: int) -> DataFrame:
    """Edges run from the larger node a to the smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w")).withColumnRenamed("a", "n")
    out = lookup(edges, "a", least, "n", "w", n, few=few).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """``node, root`` for every node that has an edge to another; root is the least node it reaches. ``few``: as in ``lookup``."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    edges = cut(edges)
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges, state[0], few), state[0], few))  # a large star has no more edges than there were
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
