"""Joins and ranks whose tasks stay bounded when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/HOT_SHARE of the rows, so the
#: table of hot keys has a proven bound and may be broadcast.
HOT_SHARE = 500
#: A key with no more rows than this is no burden to a task, whatever its share.
HOT_LEAST = 100_000
#: The same for joins of a key's rows with one another.
HOT_PAIRED = 2_000


def hot_limit(total: int, least: int | None = None) -> int:
    """Rows beyond which a key is hot; fewer than ``HOT_SHARE`` keys can exceed it."""
    return max(HOT_LEAST if least is None else least, total // HOT_SHARE)


def join_unique(big: DataFrame, unique: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``big`` to ``unique`` (one row per ``key``; ``size`` = rows of that key in big).

    Hot keys are joined by broadcast (fewer than ``HOT_SHARE`` rows by construction),
    the others by shuffle, so no task receives a hot key's rows.  ``how`` is inner only.
    Null keys match nothing.
    """
    limit = hot_limit(total)
    if total <= limit:  # then no key can have more rows
        return big.join(unique, key, how)
    hot = F.broadcast(unique.where(F.col(size) > limit))
    keys = F.broadcast(unique.where(F.col(size) > limit).select(key))
    return big.join(hot, key, how).unionByName(
        big.join(keys, key, "left_anti").join(unique.where(F.col(size) <= limit), key, how)
    )


def self_pairs(members: DataFrame, key: str, item: str, total: int, per_task: int = 1_000) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of items that share a key.

    A hot key's members are cut into blocks; each left block meets each right block in
    a task of its own, so a key's work is spread over ``blocks`` tasks.
    ``members`` should be staged: it is read several times.
    """
    counts = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    limit = hot_limit(total, HOT_PAIRED)
    hot = F.broadcast(
        counts.where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / per_task).cast("int").alias("__blocks"))
    )
    tagged = members.select(key, item).join(hot, key, "left")
    block = F.coalesce(F.pmod(F.xxhash64(item), F.col("__blocks")), F.lit(0)).cast("int")
    left = tagged.select(key, F.col(item).alias("a"), block.alias("__block"))
    right = tagged.select(
        key, F.col(item).alias("b"),
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__blocks") - 1, F.lit(0)))).alias("__block"),
    )
    return left.join(right, [key, "__block"]).where("a < b").select("a", "b").distinct()


def class_pairs(members: DataFrame, pairs: DataFrame, per_task: int = 1_000) -> DataFrame:
    """(a, b, similarity), a < b, of all items of classes: within a class (1.0) and across two paired ones.

    ``members``: (item, rep, copies), one row per item; ``pairs``: (a, b, similarity) of
    reps of different classes, each pair once.  Nothing is left out: a large class is cut
    into blocks and each block meets each other one in a task of its own.
    """
    blocks = F.ceil(F.col("copies") / per_task).cast("int")
    cut = members.select("item", "rep", "copies", blocks.alias("__n"), F.pmod(F.xxhash64("item"), blocks).cast("int").alias("__block"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = cut.where("copies > 1")
    within = held.select("rep", F.col("item").alias("a"), "__block").join(
        held.select("rep", F.col("item").alias("b"), each("__n").alias("__block")), ["rep", "__block"]
    ).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    side = lambda x: cut.select(F.col("rep").alias(x), F.col("__block").alias(f"__{x}"), F.col("item").alias(f"__i{x}"))
    sizes = lambda x: cut.where("item = rep").select(F.col("rep").alias(x), F.col("__n").alias(f"__n{x}"))
    across = pairs.join(sizes("a"), "a").join(sizes("b"), "b")
    across = across.withColumn("__a", each("__na")).withColumn("__b", each("__nb"))
    across = across.join(side("a"), ["a", "__a"]).join(side("b"), ["b", "__b"])
    return within.unionByName(across.select(F.least("__ia", "__ib").alias("a"), F.greatest("__ia", "__ib").alias("b"), "similarity"))


def dense_rank_rows(df: DataFrame, group: str, order: Column, out: str, buckets: int) -> DataFrame:
    """0-based rank of each row within ``group`` without collecting a group in one task.

    Rows are spread over ``buckets`` by the hash ``order``; counts per (group, bucket)
    give offsets, and ranks are taken within (group, bucket).  The order of the ranks is
    by bucket and then by hash: deterministic and unrelated to row order.  The table of
    offsets has groups x buckets rows.
    """
    from pyspark.sql import Window

    spread = df.withColumn("__h", order).withColumn("__bucket", F.pmod("__h", F.lit(buckets)).cast("int"))
    counts = spread.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__bucket", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(group, "__bucket").orderBy("__h")
    ranked = spread.withColumn("__r", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [group, "__bucket"]).withColumn(out, F.col("__r") + F.col("__off")).drop(
        "__r", "__off", "__bucket", "__h"
    )
