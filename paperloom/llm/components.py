"""Connected components over a table of links, by alternating large and small stars.

Each round is two aggregations to a minimum (combined before the shuffle) and two joins; its result is stored, so
the lineage stays short. Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _state(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(h, 16)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id of ``links`` (u long, v long): the least id it can reach."""
    now = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"),
        "links",
    )
    state = _state(now)
    while state[0]:
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one")
        # small star: u and its smaller neighbours link to the least of them
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).drop("one"), "links")
        reached = _state(after)
        discard(now)
        now = after
        if reached == state:
            break
        state = reached
    star = now.groupBy("u").agg(F.min("v").alias("m"))
    return star.select(F.col("u").alias("id"), F.col("m").alias("component_id"))
