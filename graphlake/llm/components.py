"""Connected components over a table of links, by alternating large and small stars.

Every round rewrites links so that they point to ever smaller nodes: each is a join and a minimum per node (no
list of neighbours is built, so a hub is no single task's burden: AQE splits its side of the join).  Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise_lean


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b, distinct).  Each node's neighbours (large: the greater ones; small: the lesser) move to its least."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node in ``links`` (columns a, b), root being the least node it is connected with."""
    links = materialise_lean(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _state(links)
    while seen[0]:
        links = materialise_lean(_star(_star(links, True), False), name)
        now = _state(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select("b", F.col("b").alias("root")).distinct().withColumnRenamed("b", "node"))
