"""Connected components of an edge table by alternating star contraction
(Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.session import materialize


def _with_min(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with the smallest node of u's neighbourhood."""
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_min(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _with_min(down)
    linked = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(hung.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edge table (u, v) with the smallest node
    it is connected to.  Converges in a logarithmic number of rounds."""
    cur = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    cur = materialize(cur.where("u <> v").distinct(), "edges")
    seen = _fingerprint(cur)
    while seen[0]:
        cur = materialize(_small_star(_large_star(cur)), "edges")
        now = _fingerprint(cur)
        if now == seen:
            break
        seen = now
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
