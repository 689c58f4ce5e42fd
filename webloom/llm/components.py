"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.storage import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v): long pairs. Returns (node, component): component is the smallest node that links reach.

    Null ends and loops are left out; repeated edges count once. Each step aggregates a minimum per
    node with map-side combining and joins it back, so no neighbour list is ever gathered, and
    writes its edges to the shared folder. The number of steps is logarithmic in the longest path.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = e = materialize(e, "cc")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(e, "cc")
        discard(before)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").select("v", "m").union(low.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        before = e = materialize(e, "cc")
        discard(large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
