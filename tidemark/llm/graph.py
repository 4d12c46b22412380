"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in edges (a long, b long); a component is named by its least node.

    Each round links the neighbours of a node to the least of them (large stars: the larger
    neighbours, small stars: the others), until nothing changes: a logarithmic number of
    rounds. A hub's neighbours are reduced by a partial minimum and never meet in one task.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, links = links, cut(small.where("u <> v").distinct())
        drop(before)
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    stars = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
