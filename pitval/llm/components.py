"""Connected components over an edge table, without ever holding a component in one place."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitval.session import cut, stack


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the smallest node reachable.

    Alternates two steps until only stars are left. Large star: every node hands its
    larger neighbours to its smallest neighbour. Small star: every node hands its
    smaller neighbours to the smallest of them. Both keep connectivity; the number
    of rounds grows with the logarithm of the longest chain. Minima are combined
    before they are shuffled, so a node with very many edges costs one row per task.
    Each round is written to the checkpoint folder, which also cuts the lineage.
    An empty edge table gives no rows; edges from a node to itself are ignored.
    """
    x, y = F.col(a), F.col(b)
    e = cut(edges.where(x != y).select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).distinct())
    for _ in range(rounds):
        if _stars(e):
            return stack(e.select(F.col("hi").alias("node"), F.col("lo").alias("root")),
                         e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        both = stack(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")), e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").where("v != m")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        e = cut(stack(small.select(F.col("m").alias("lo"), "hi"),
                      small.where("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _stars(e: DataFrame) -> bool:
    """True if every larger end has one smaller end and no smaller end is itself a larger end."""
    seen = stack(e.groupBy("hi").agg(F.count("*").alias("n")).select(F.col("hi").alias("x"), F.col("n").alias("up"), F.lit(0).alias("down")),
                 e.select(F.col("lo").alias("x"), F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")).distinct())
    return seen.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
