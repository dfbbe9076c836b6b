"""Connected components by alternating large-star and small-star steps.

Every step is two shuffles of the links with map-side combined minima, so a node
with very many links is neither collected nor sent to one task; the links are
written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v): the large step ties each node's larger
    neighbours to the smallest of its neighbourhood, the small step ties its smaller
    neighbours and itself to it."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        made = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        made = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (u, v), for every
    node with a link to another. Links of a node to itself and repeated links are
    allowed; no links give no rows."""
    now, mark = links.select("u", "v"), None
    while True:
        now = stored(_star(_star(now, True), False), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
