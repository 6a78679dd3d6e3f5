"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and an equi-join; each is written to the shared folder, so lineage stays short
and no component is gathered in one task. Rounds grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm import shared


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """edges (a > b). Large star (both): every node's larger neighbours hang on its least neighbour or itself. Small
    star: a node and its smaller neighbours hang on the least of them."""
    near = edges.union(edges.select("b", "a")) if both else edges
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = shared.stored(least.select("a", F.least("a", "m").alias("m")), "least")
    joined = near.join(least, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    made = shared.stored(out.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"), "star")
    shared.discard(least)
    return made


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("a"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without an edge have no row."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b")
    now = shared.stored(now.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"), "edges")
    before = _state(now)
    while before[0]:
        large = _star(now, True)
        shared.discard(now)
        now = _star(large, False)
        shared.discard(large)
        after = _state(now)
        if after == before:
            break
        before = after
        rounds -= 1
        if not rounds:
            raise RuntimeError("components didn't converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
