"""Connected components as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """From (a, b) links: (id, component), the smallest id reachable, for every id that has a link.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node hangs its larger neighbours, then
    its smaller ones, under the smallest. Each step is a map-side combined minimum and a join back; a hub with many
    links is a key that adaptive execution splits. Edge tables are written between rounds, never gathered.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, now = now, stored(small.where("a <> b").distinct(), "edges")
        discard(last, large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(now.select("b", "b").distinct())
