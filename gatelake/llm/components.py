"""Connected components by alternating star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import drop_table, keep


def _toward_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours on the smallest member of their neighbourhood: larger ones only, or those below the centre."""
    if both_ways:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("centre"), F.least("u", "m").alias("m"))
    joined = edges.join(smallest, F.col("u") == F.col("centre"))
    if both_ways:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select(F.col("centre").alias("u"), F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that a link names; the component is its smallest node.

    ``links`` may hold repeated pairs, either order and loops; pairs with a null are ignored. Each round is two
    groupings with map-side minima and two joins on skewed but splittable keys, written to the shared folder, so no
    lineage grows and nothing but two totals reaches the driver. Rounds grow with the logarithm of the node count.
    """
    edges = (links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges, path = keep(edges, "links")
    before = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == before or row.n == 0:
            break
        before = (row.n, row.s)
        raised = _toward_smallest(edges, True).distinct()
        following, new_path = keep(_toward_smallest(raised, False).distinct(), "links")
        drop_table(edges.sparkSession, path)
        edges, path = following, new_path
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
