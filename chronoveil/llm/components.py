"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """From (u, v), u > v. Large: larger neighbours go to the smallest of a node's neighbours; small: smaller ones do."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = base.written(near.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "star")
        moved = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = base.written(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    out = base.written(moved.filter("u <> v").distinct(), "edges")
    base.discard(edges, least)
    return out


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), as a written table; the root is the smallest node it reaches.

    A node with very many edges is no hot task: minima are combined before the shuffle and the joins are split by skew.
    """
    now = base.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first())
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            out = base.written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")
            base.discard(now)
            return out
        before = state
        now = _stars(_stars(now, True), False)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
