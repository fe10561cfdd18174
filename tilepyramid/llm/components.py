"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilepyramid.llm.common import gathered, stored


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(id, component): every id that has a link, with the smallest id it can reach.

    ``links`` has one row or more per link, at most ``rows``, in any direction; loops and rows with
    nulls count for nothing. Every round is written to the shared folder, so a lost executor costs one round at
    most; ids never go to the driver. In each round all links of an id point to its smallest
    neighbour, so hubs are summed before they are shuffled, and the number of links never grows.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col("u") > F.col("v")).distinct()
    pairs = stored(pairs if rows is None else gathered(pairs, rows), "links")
    rows = pairs.count()
    if not rows:
        return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    seen = None
    while True:
        # large star: larger neighbours of u are linked to the smallest of u and its neighbours
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: smaller neighbours of u, and u itself, are linked to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(
            F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") > F.col("v")).distinct())
        pairs = stored(gathered(small, rows), "stars")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct().toDF("id", "component"))
