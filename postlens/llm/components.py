"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (combined before the shuffle) and one join on
the node; nothing is collected but one checksum row a round.  The minima are
written to the shared folder before the join, so both join sides are plain
exchanges whose hot nodes Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stage

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stage(both.groupBy("u").agg(F.min("v").alias("m"))
                .select("u", F.least("u", "m").alias("m")), "cc-min")
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
    own = low.select("u", F.col("m").alias("v"))
    rest = (edges.join(low, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    return own.unionByName(rest).where("u <> v").distinct()


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another; root is its component's smallest node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stage(edges, "cc-links")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        edges = stage(_small_star(stage(_large_star(edges), "cc-links")), "cc-links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
