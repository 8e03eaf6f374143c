"""Connected components of a large graph, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), with the smallest node of its component as root.

    Each round joins every node's neighbours to the smallest of them, first the larger neighbours (large star), then the
    smaller ones (small star), until nothing changes; a path of n nodes takes about log n rounds. Minima are summed up before the shuffle
    and the joins are plain equality joins, so that a node with very many links is split like any skewed key. Each round's links
    are written to the shared checkpoint folder: lineage stays short and a lost executor costs one round at most. Nothing but a
    count and a checksum reaches the driver.
    """
    edges = cut(_ordered(links.select("a", "b")))
    seen = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(_ordered(small.unionAll(least.select("a", F.col("m").alias("b")))))
        now = _state(edges)
        if now == seen:
            break
        seen = now
    # At rest every component is a star around its smallest node.
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, larger node first; loops go."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
