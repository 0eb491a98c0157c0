"""Connected components of a link table, by alternating stars.

Large star: every node hands its larger neighbours to the smallest node it
knows. Small star: every node hands its smaller neighbours, and itself, to the
smallest one. Both keep the components and never add links; the rounds end when
every node points at the smallest node of its component. The smallest neighbour
of a node comes from a partially aggregated minimum that is written, so the join
that hands links over has plain exchanges on both sides and a hub with very many
links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import done_with, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b; any order, no
    nulls); a component is named by its smallest node."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("m")).distinct(), "links")
    state = None
    while True:
        both = now.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(
            now.select(F.col("m").alias("u"), F.col("x").alias("v")))
        least = written(_least(both), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("x"), "m").distinct(), "large-star")
        done_with(now, least)
        links = large.select(F.col("x").alias("u"), F.col("m").alias("v"))
        least = written(_least(links), "least")
        # every v, and u itself, to the smallest node that u knows
        handed = links.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        now = written(handed.where("x <> m").distinct(), "small-star")
        done_with(large, least)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "m").cast("decimal(38,0)"))).first()  # one row
        if after == state:
            return now.select(F.col("x").alias("node"), F.col("m").alias("component")).unionByName(
                now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        state = after


def _least(links: DataFrame) -> DataFrame:
    """For links (u, v): the smallest node that u knows, itself included."""
    return links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
