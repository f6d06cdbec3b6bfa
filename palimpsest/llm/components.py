"""Connected components by alternating large-star and small-star.

Large-star joins each node's larger neighbours to its least neighbour, small-star its smaller ones and
itself; both keep connectivity, and repeated they leave a star around the least node of each component.
No step holds a node's neighbours in one place: least neighbours are aggregated before the exchange and
joined back, and joins split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) -> node, component (the least node); nodes without edges to others are absent."""
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = scratch.cut(e), None
    while True:
        n = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (n["n"], n["s"]) == mark or not n["n"]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._scratch = e._scratch  # type: ignore[attr-defined]
            return out
        mark = (n["n"], n["s"])
        e = scratch.cut(_small(_large(e)), e)
