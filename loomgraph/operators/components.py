"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.storage import discard, materialize


def _signature(links: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the node's smallest neighbour."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are hung below the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, src: str | Column = "src", dst: str | Column = "dst") -> DataFrame:
    """``(id, component)`` for every node on an edge; the component is its smallest id.

    Null endpoints are ignored; a self loop makes a node of its own. Each round is two aggregations and two
    equi-joins, so a hub is pre-aggregated on the map side and its join is one that Spark can split.
    Rounds needed grow with the logarithm of the longest chain. No link reaches the driver, only a checksum.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src) if isinstance(src, str) else src, F.col(dst) if isinstance(dst, str) else dst).toDF("a", "b").dropna()
    links, _ = materialize(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    loops, proper = links.where("hi = lo"), links.where("hi > lo")
    state, kept, seen = proper, [], _signature(proper)
    while seen[0]:
        hung, half = materialize(_large_star(state), "stars")  # apart, so that only one star's shuffles lie on disk
        discard(spark, *kept)
        state, new = materialize(_small_star(hung), "stars")
        discard(spark, half)
        kept, now = [new], _signature(state)
        if now == seen:
            break
        seen = now
    member = state.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return member.union(state.select("lo", "lo")).union(loops.select("hi", "lo")).groupBy("id").agg(F.min("component").alias("component"))
