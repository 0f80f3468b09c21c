"""Connected components of an edge table, as rounds of joins.

Large-star and small-star steps in turn: each hangs a node's neighbours on the
smallest of them, until only stars are left.  A node's minimum is aggregated
before the shuffle and joined back, so no group of edges is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampflow.llm.common import saved


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v longs) to (node, component): the smallest node reachable.

    Only nodes other than their component's smallest get a row.  Loops and
    repeated or reversed edges do no harm; nulls are left out.
    """
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = saved(now, "edges")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(mark)
        now = saved(_stars(now), "edges")
