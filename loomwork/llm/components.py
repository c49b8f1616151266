"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import exchange as X
from loomwork.llm import scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the lowest node of its component) of every node that has a link.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller neighbours to the
    lowest node it sees, until all edges point at the lowest node of their component. Minima are aggregated before
    they are shuffled and joined back from a written table, so a node with very many links can be split.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = scratch.table(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low_1 = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.where("v > u").join(low_1, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, "edges")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        before, edges = edges, scratch.table(small, "edges")
        X.release(edges)
        scratch.drop(before, low_1, large, low)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    lows = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(lows)
