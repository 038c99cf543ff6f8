"""Connected components of a table of links, by alternating star contraction.

Each round rewrites links to point at smaller members; hubs are handled by aggregates and joins, never by
gathering a neighbourhood, and every round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch


def _marks(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: every linked node that is not the smallest of its component, with that smallest node.

    links: columns u, v (bigint, u > v), one row or more for each link.
    """
    links = scratch.keep(links.select("u", "v").distinct(), "links")
    marks = _marks(links)
    while marks[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.drop(links)
        links, before, marks = new, marks, _marks(new)
        if marks == before:
            break
    return links
