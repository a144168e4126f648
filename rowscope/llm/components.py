"""Connected components over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): root is the least node of the component.

    Alternates large-star and small-star steps until the edges stand still.  Least neighbours are combined on the map
    side, and joins read stored tables, so AQE can split the rows of a hot node.
    """
    e = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # a node that is least itself keeps no edge of its own, its greater neighbours point to it
        large = stored(large.distinct())
        dropped(e, least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(large, least)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
