"""Connected components of a graph of narrow link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of
    ``links`` (a, b).

    Large stars and small stars in turn: each round links all larger
    neighbours of a node, then all smaller ones, to its smallest neighbour, so
    a chain shortens to a logarithm of rounds and a hub's neighbours are never
    paired.  Rounds end when the links no longer change.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = land(both, "links")
    before = None
    for _ in range(max_rounds):
        every = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = every.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small stars: every link points from the larger node to the smaller
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.a", "x.b").where("a <> b").distinct())
        now = land(small, "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    ends = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
