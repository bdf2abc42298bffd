"""Connected components of a link table by alternating star steps.

Each round is two joins and two groupings; no vertex or component is collected.
The large step hangs every larger neighbour of a vertex on its least neighbour,
the small step hangs the smaller ones there; the rounds end when a round changes
no link, which takes about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_by_share, saved


def _large(links: DataFrame, total: int) -> DataFrame:
    """A vertex of many links is broadcast with its least neighbour; ``total``: links in both directions."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return joined_by_share(both, least, "a", "degree", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame, total: int) -> DataFrame:
    """links have b < a."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    moved = joined_by_share(links, least, "a", "degree", total).where("b <> m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(vertex, component) of every vertex in ``links(a, b)``, a saved table; component: its least vertex."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = saved(links, label)
    digest = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("y")).first()
    before = digest(current)
    while before["n"]:
        # The large step gives no more links than it takes.
        old, current = current, saved(_small(_large(current, 2 * before["n"]), before["n"]), label)
        discard(old)
        now = digest(current)
        if now == before:
            break
        before = now
    # At the fixed point every vertex hangs on the least of its component.
    out = saved(current.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct(), label)
    discard(current)
    return out
