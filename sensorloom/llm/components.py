"""Connected components of a table of links, by alternating stars.

Every round hangs the neighbours of a node on the least of them: first the larger
ones (*large star*), then the smaller ones (*small star*). What is left at the end is one
link from each node to the least node it can reach. Rounds grow with the logarithm of
the longest chain. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Store
from sensorloom.sources.scratch import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Every link points down: u > v.
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, store: Store = materialize) -> DataFrame:
    """``node, component``: the nodes that some link leads down from, with the least
    node they reach. The least nodes themselves and nodes without links have no row."""
    current = store(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "links",
    )
    before = None
    while True:
        mark = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before or mark[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        current = store(_small_star(_large_star(current)), "stars")
