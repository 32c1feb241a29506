"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour to its centre's smallest: the larger neighbours if large, else the smaller ones and the centre.

    A large star has as many links as before; some may occur twice.
    """
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = links.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _done(links: DataFrame) -> bool:
    """Whether each id has one link down or only links from above; only a count comes to the driver."""
    ends = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("down")))
    each = links.select(F.inline(ends)).groupBy("id").agg(F.sum("down").alias("downs"), F.min("down").alias("least"))
    return each.where("downs > 1 OR downs > least").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of any order as (id, root): each linked id but the roots, with the smallest id it reaches.

    Links from an id to itself, repeated links and nulls count for nothing. Every round is written to the checkpoint
    folder, and a round is made only if ids are not linked to their roots yet: each leaves plans and threads in the driver.
    """
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _done(links):
        links = cut(_star(_star(links, large=True), large=False))
    return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
