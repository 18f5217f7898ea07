"""Connected components of links between 64-bit ids, by alternating star contractions; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label for every id that a link (columns a, b) names: the smallest id of its component.

    Each round makes every node point at the smallest id it knows of: first the larger neighbours (large star), then
    the smaller ones (small star). The number of rounds grows with the logarithm of the longest chain. A node with very
    many neighbours, as the root of a large component has, is dealt over several tasks. A null id has no links; repeated
    links and links of an id to itself change nothing. The result reads one table of scratch.
    """
    edges = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.save(edges)
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.save(lookup(both, least, "u", "inner").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = lookup(large, small, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.save(new)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, large)
        edges = new
        if got == state:
            break
        state = got
    found = scratch.save(edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()))
    scratch.drop(edges)
    return found
