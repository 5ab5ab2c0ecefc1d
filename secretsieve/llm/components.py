"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node that it reaches.

    ``edges`` has two long columns, u and v.  A large star hangs the larger neighbours of a
    node on its least neighbour, a small star the others; after a logarithmic number of
    rounds only stars are left.  A round aggregates per node, combined on the map side, and
    joins the result back, so a node with many neighbours is split as any skewed join; its
    edges are written to the shared folder, which ends the lineage.
    """
    edges = landed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == last or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = landed(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges", instead_of=edges)
