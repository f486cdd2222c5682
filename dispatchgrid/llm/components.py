"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped aggregations and joins; a hub's edges are only ever aggregated with a map-side combine or joined,
never gathered. The aggregate is dealt out once more before its join: only then are both sides plain shuffles, and adaptive
execution can split a hub. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).repartition("a")
    return both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    m = e.groupBy("a").agg(F.min("b").alias("m"))
    far = e.join(m.repartition("a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return far.union(m.select("a", F.col("m").alias("b"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge up, or is the smallest of its star and has none."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(e.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up + top > 1").limit(1).count()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node that has an edge: root is the smallest node of its component.

    edges: columns a, b (long); loops and repeats are allowed. No edges gives no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.keep(e, f"{name}-0")
    i = 0
    while not _stars(e):
        i += 1
        if i > MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        e = scratch.keep(_small(_large(e)), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
