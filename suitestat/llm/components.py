"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import discard, materialize


def _minima(edges: DataFrame, name: str) -> DataFrame:
    """The smallest neighbour of each u, itself included, as a written table: a join with it may be split at a hub."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root): for each id on an edge (a, b long), the smallest id that it reaches.

    Links a component to its smallest id in about log2(size) rounds.  Minima combine
    before they shuffle.  Null ends are left out; an id linked to itself has itself as
    its root; an empty table gives an empty table.
    """
    ends = edges.filter("a is not null and b is not null")
    now = materialize(_distinct(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "edges")
    alone = ends.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("root"))
    mark = None
    for _ in range(rounds):
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u are linked to u's smallest neighbour.
        most = _minima(both, "large")
        large = materialize(_distinct(both.join(most, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large-star")
        # Small star: u and its neighbours below are linked to the smallest of them.
        least = _minima(large, "small")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, materialize(_distinct(small), "small-star")
        discard(before, most, large, least)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return found.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).unionByName(alone).groupBy("id").agg(F.min("root").alias("root"))
