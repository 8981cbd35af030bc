"""Connected components of a link table, by alternating large and small stars.

Each step is an aggregation and a join on the node, so a node with very many links is
pre-aggregated before the shuffle and its join is split as a skewed one.  The number of rounds
grows with the logarithm of the longest chain.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(both: DataFrame) -> DataFrame:
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _stars(both)
    return joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    joined = _stars(edges)
    down = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select("u", F.col("m").alias("v")).union(down).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); root is the smallest node reachable.

    Links of a node with itself and null ends are ignored; no links give an empty table.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        if not mark[0]:
            break
        edges = stored(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
