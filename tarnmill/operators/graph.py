"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node on the least of them: the larger ones (large star) or the smaller ones and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, store) -> DataFrame:
    """(node, root) for edges (a, b): the least node that each one reaches, a node without an edge to another included if it
    has a loop. A chain of n nodes takes about log n rounds; `store` writes a table between them."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        e = store(_stars(_stars(e, True), False), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
