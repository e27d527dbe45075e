"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.skew import join_unique
from caseloom.plans.staging import staged, unstage


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One star operation on edges ``u > v``; every star's centre becomes its minimum."""
    if large:  # neighbours on both sides; those above u move to the least neighbour
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("__m"), F.count(F.lit(1)).alias("__n"))
        least = least.select("u", F.least("u", "__m").alias("__m"), "__n")
        moved = join_unique(around, least, "u", "__n", 2 * total).where("v > u")
        return moved.select(F.col("v").alias("u"), F.col("__m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("__m"), F.count(F.lit(1)).alias("__n"))
    moved = join_unique(edges, least, "u", "__n", total).where("v > __m")
    return moved.select(F.col("v").alias("u"), F.col("__m").alias("v")).unionByName(
        least.select("u", F.col("__m").alias("v"))
    )


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component = its least node.

    Iterates (large-star, small-star) until the edge set no longer changes; the number
    of rounds grows with the logarithm of the longest path.  Each round is written to
    the shared folder, nothing but counts and checksums reaches the driver.  Self-loops
    are kept as single nodes; null ends are ignored; repeated and reversed edges count
    once; an empty table gives an empty result.  Hubs are handled by hot-key joins.
    """
    pairs = edges.select(F.col(src).alias("__a"), F.col(dst).alias("__b")).where("__a is not null and __b is not null")
    loops = pairs.where("__a = __b").select(F.col("__a").alias("u"), F.col("__b").alias("v"))
    now = staged(
        pairs.where("__a <> __b").select(F.greatest("__a", "__b").alias("u"), F.least("__a", "__b").alias("v")).distinct(),
        "stars",
    )

    def state(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        return r[0], r[1]

    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        large = staged(_star(now, seen[0], True).distinct(), "stars")
        unstage(now)
        now = staged(_star(large, seen[0], False).distinct(), "stars")
        unstage(large)
        fresh = state(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots)
        .unionByName(loops.select(F.col("u").alias("node"), F.col("v").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
