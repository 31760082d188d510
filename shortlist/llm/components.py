"""Connected components of a table of links, by alternating large and small
stars: each round links every node's larger (then smaller) neighbours to the
smallest one. The number of rounds grows with the logarithm of the number of
nodes; a round is two joins of narrow rows and is written to the checkpoint
folder. Rounds end as soon as the links are stars, which one aggregation tells,
so no round is spent on finding that nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """May repeat links; the small star that follows does not."""
    here, there = F.col("a"), F.col("b")
    both = links.select(F.inline(F.array(F.struct(here.alias("a"), there.alias("b")),
                                         F.struct(there.alias("a"), here.alias("b")))))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    own = F.struct(F.col("a").alias("a"), F.col("m").alias("b"))
    moved = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
    to_least = F.when(F.col("b") > F.col("m"), F.array(own, moved)).otherwise(F.array(own))
    return links.join(least, "a").select(F.inline(to_least)).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, and that one none: a
    round would change nothing."""
    up = F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    inner = links.select(F.inline(F.array(up, down))).groupBy("node").agg(
        F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return inner.agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: bigint, in any order, no nulls) -> (node, label) with the
    smallest node of its component, for every node but that smallest one."""
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a > b").distinct())
    while not _are_stars(links):
        links = cut_lineage(_small_star(_large_star(links)))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
