"""Connected components of a graph given as links, by alternating large and small stars.

Every round replaces links by links to smaller neighbours until each node hangs on the smallest of
its component. Minima are aggregated before the shuffle and joined back, so a node with very many
links is split like any skewed join; links are never gathered by node or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import staged


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v) that has a link to another node."""
    e = staged(links.select("u", "v").where("u <> v").distinct(), "links")
    before = _state(e)
    while before[0]:
        e = staged(_small_star(_large_star(e).distinct()).distinct(), "links")
        after = _state(e)
        if after == before:
            break
        before = after
    members = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
