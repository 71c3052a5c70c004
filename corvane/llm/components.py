"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import drop_table, put


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v. Aggregated apart and joined, so that a node with many pairs can be split."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    starred = _least(down)
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).filter("u != v")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node that edges (u, v) lead to, for every node with an edge to another. Any orderable, equal types."""
    now = put(edges.filter("u != v").distinct(), "edges")
    told = None
    while True:
        after = put(_small_star(_large_star(now).distinct()).distinct(), "edges")
        drop_table(now)
        sign = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        now = after
        if sign == told:
            break
        told = sign
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(ends.select(F.col("label").alias("node"), "label").distinct())
