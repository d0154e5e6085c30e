"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.scratch import discard, stash

#: The smallest neighbours are broadcast in a round of at most so many links; beyond it they are written, so that Spark splits the join where a node is hot.
BROADCAST_LINKS = 300_000


def _beside_smallest(e: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """e (written) with m, the smallest v of each u; and the table written for it."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    if few:
        return e.join(F.broadcast(least), "u"), []
    least = stash(least, "least")
    return e.join(least, "u"), [least]


def _large_star(both: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    joined, written = _beside_smallest(both, few)
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), written


def _small_star(e: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    joined, written = _beside_smallest(e, few)
    moved = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return moved.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of each linked node but the smallest of a component, which is its name.

    Links are oriented from larger to smaller id. A round writes the edges to
    the checkpoint folder; rounds end when every edge leads to a component's
    smallest node (after a number of rounds logarithmic in practice). A node
    with very many links is summed partially before the shuffle, and a join on
    it is a broadcast or one that Spark splits. Nulls and links to oneself are
    left out.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct()
    e = stash(e, "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, last, few = now, e, now[0] <= BROADCAST_LINKS
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, first = _large_star(both, few)
        if not few:
            large = stash(large, "edges")
            first.append(large)
        small, second = _small_star(large, few)
        e = stash(small, "edges")
        discard(last, *first, *second)
