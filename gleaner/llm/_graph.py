"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (u, v longs); component is its smallest node.

    Each round points the larger neighbours of every node at its smallest
    neighbour, then the smaller ones; the rounds grow with the logarithm of the
    longest chain. A hub's edges are a skewed join that AQE splits, its minimum
    is combined before the shuffle, and each round is a table in shared scratch.
    """
    known = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    known = materialise(known, "edges")
    before = None
    while True:
        after = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before or not after[0]:
            return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = after
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(low, "u").select(star.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        known, old = materialise(small, "edges"), known
        discard(old)
