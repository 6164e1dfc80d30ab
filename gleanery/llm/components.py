"""Connected components of a table of links, by alternating star operations.

Every round re-hangs the neighbours of each node on its least neighbour, once for the larger neighbours and once for
the smaller ones, until the links no longer change and form stars around the least node of each component. Each round is
written to the shared folder, and the one before it removed. Least neighbours are aggregated before the shuffle, and the
join by node is one that adaptive execution splits where many links share a node. Nothing of the graph reaches the driver
but a count and a check sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialise, release


def _rehang(links: DataFrame, sides: DataFrame) -> DataFrame:
    """links (u, v): every v goes to the least of u and its neighbours in sides."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return links.join(least, links["u"] == least["c"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def roots(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of links (a, b) but the roots themselves.

    Links of a node to itself and links with a null end count for nothing; repeated links count once.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _rehang(both.where("v > u"), both)
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            lower.select("u", F.col("m").alias("v")))
        last = edges
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        release(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found.stored_at = edges.stored_at  # for release()
            return found
        before = now
