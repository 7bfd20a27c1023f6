"""Connected components of a link table by alternating large-star and small-star steps.

Follows Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every step is
a grouped minimum, which is pre-aggregated, and an equi-join.  Nodes of very many links are salted:
among the larger neighbours always, since roots gather them, and among the smaller ones at first;
later a node has few of those.  Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import materialise, spread_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return spread_join(both, least, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, salted: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = spread_join(edges, least, ["u"], ["v"]) if salted else edges.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (u, v) of longs -> (id, component): every linked id with the smallest id it reaches.

    Ids without links don't appear; self links and links with null are ignored; repeated links
    count once.  An empty table gives an empty table.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, name)
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    last, first = edges.agg(mark).first()[0], True
    while last[0]:
        large = _large_star(edges)
        edges = materialise(_small_star(materialise(large, name) if first else large, first), name)
        first = False
        now = edges.agg(mark).first()[0]
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
