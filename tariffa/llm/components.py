"""Connected components of links by alternating large and small stars, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tariffa.llm.common import lookup, stored

#: A round's file and task hold about so many links; of at most BROADCAST links the least neighbours are broadcast.
PART, LEAST_PARTS, BROADCAST = 20_000, 4, 1 << 16


def _least_neighbour(links: DataFrame, total: int) -> DataFrame:
    """Links (a, b) with the least b of each a as m; an a with very many links is joined by broadcast, and so are all of few links."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if total <= BROADCAST:
        return links.join(F.broadcast(least.select("a", "m")), "a")
    return lookup(links, least, "a", "n", total, F.col("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b) to another; root is the least node of its component.

    Each round replaces links by links to smaller nodes until only stars are left; there are about as many
    rounds as the logarithm of the longest chain. Every round is written to the shared folder, in parts by its number
    of links: few links need not as many files and tasks as the session has shuffle partitions.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seal = None
    while True:
        n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == seal:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seal, parts = (n, mark), max(LEAST_PARTS, n // PART)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_neighbour(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = stored(large.coalesce(parts), "large-star")
        small = _least_neighbour(large, n)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small.coalesce(parts), "small-star")
