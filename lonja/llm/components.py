"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"): each
round is two grouped minima joined back to the edges, so a hub is a hot join key that adaptive execution splits, never a
group gathered in one task. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.store import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` but the roots; a root is the smallest node it can reach.

    Self-loops and repeated edges are ignored; an empty edge list gives an empty result.
    """
    state = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, turn = None, 0
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, turn = mark, turn + 1
        state = scratch.write(_small_star(_large_star(state)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
