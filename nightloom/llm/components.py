"""Connected components of links in a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """key, component (its smallest key) of every end of links(u, v); no links, no rows.

    Each round points all larger neighbours of a key at its smallest one, then
    the smaller ones; rounds go on until the links are stars. Rounds grow with the logarithm of the longest path.
    Each round is written, so a lost executor costs one round; the one before it is deleted.
    """
    edges = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.filter("u > v")
        small = down.join(_least(down), "u").select("u", "v", "m")
        made = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        counts = Observation()
        new = materialize(made.observe(counts, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")), "links")
        discard(edges)
        edges, now = new, (counts.get["n"], counts.get["hash"])
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("u").alias("key"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("key"), "component").distinct())
