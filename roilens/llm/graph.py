"""Connected components of an edge table by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over directed edges (a > b). The minima are cut so that the join has a
    plain shuffle on either side, which lets adaptive execution split a hub."""
    pairs = edges.select("a", "b")
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = pairs.join(least, "a")
    if large:  # each neighbour above a is tied to the least of a's neighbourhood
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a and its neighbours below are tied to the least of them
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link in (a, b); root is the component's least node."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = cut(_star(cut(_star(edges, large=True)), large=False))
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                                F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
