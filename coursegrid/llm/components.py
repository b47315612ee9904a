"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step groups by node with map-side combine and joins the smallest neighbour back; no neighbour list is gathered, and no
part of the graph comes to the driver but its size and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursegrid.llm.shared import settled


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("u", "m").alias("v")
    )


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return (
        moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """`node, root`: for every node with an edge, other than a root itself, the smallest node it is connected with.

    `edges`: columns `u, v` without nulls. Loops and repeated edges do no harm.
    """
    now = settled(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before, after = None, _sum(now)
    while before != after:
        now = settled(_small(_large(now)))
        before, after = after, _sum(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
