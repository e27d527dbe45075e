"""Labelled selections: guarded joins, complements, seeded stratified splits, seals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_join(left: DataFrame, right: DataFrame, key: str, equal: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a join that must be total and agree on the named columns.

    Problems are keys without a partner on either side and keys whose columns differ
    (null agrees with null); the caller decides whether any problem is fatal.
    """
    l = left.select(key, *(F.col(c).alias(f"__l_{c}") for c in equal)).withColumn("__in_l", F.lit(True))
    r = right.select(key, *(F.col(c).alias(f"__r_{c}") for c in equal)).withColumn("__in_r", F.lit(True))
    both = l.join(r, key, "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")) for c in equal), F.lit(True))
    problem = F.when(F.col("__in_r").isNull(), "missing_right").when(F.col("__in_l").isNull(), "missing_left").when(~same, "different")
    bad = both.select(key, problem.alias("problem")).where("problem is not null").distinct()
    extra = [c for c in right.columns if c not in left.columns]
    rows = left.join(right.select(key, *extra), key).join(bad.select(key), key, "left_anti")
    return rows, bad


def complement(rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose values of every key are taken by none; null never matches."""
    for k in keys:
        rows = rows.join(taken.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows


def order_hash(seed: str, *parts: Column) -> Column:
    """Seeded order that any engine can compute: sha-256 of seed and parts."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def stratified_select(df: DataFrame, family: str, key: str, label: str, caps: dict[str, int], seed: str = "42") -> DataFrame:
    """Up to ``caps[label]`` families of each label by seeded hash, one record (least key) each.

    Halves go to dev and test by rank: the first n // 2 to dev, the rest to test.  The
    rank is a top-k of the caps, so no label's families are sorted whole.
    """
    one = df.where(F.col(label).isin(*caps)).groupBy(label, family).agg(F.min(key).alias(key))
    w = Window.partitionBy(label).orderBy("__h", family)
    cap = F.element_at(F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v)))), F.col(label))
    ranked = one.withColumn("__h", order_hash(seed, F.col(family))).withColumn("rank", F.row_number().over(w))
    kept = ranked.where(F.col("rank") <= max(caps.values())).where(F.col("rank") <= cap)
    total = F.count(F.lit(1)).over(Window.partitionBy(label))
    return kept.withColumn("split", F.when(F.col("rank") <= F.floor(total / 2), "dev").otherwise("test")).select(
        label, family, key, "rank", "split"
    )


def shared_values(df: DataFrame, value: str, side: str) -> DataFrame:
    """(value, sides) of values that occur on several sides; must be empty for a clean split."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(side).alias("sides"))
    return per.where("sides > 1")


def deficits(df: DataFrame, label: str, targets: dict[str, int]) -> DataFrame:
    """(label, target, actual, deficit) for every target, present or not."""
    want = df.sparkSession.createDataFrame(sorted(targets.items()), f"{label} string, target long")
    have = df.groupBy(label).agg(F.count(F.lit(1)).alias("actual"))
    full = want.join(have, label, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return full.withColumn("deficit", F.greatest(F.lit(0), F.col("target") - F.col("actual")))


def first_per_label(df: DataFrame, label: str, key: str) -> DataFrame:
    """The least key of each label with support."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("support"))


def seal(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(rows, digest): one hash over all rows, whatever their partitioning.

    Rows are hashed one by one; the hashes are summed by 4,096 prefixes, and the
    prefixes' digests are joined in order, so no task sees more than its share.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h"))
    fold = F.sum(F.conv(F.substring("h", 4, 12), 16, 10).cast("decimal(38,0)"))
    buckets = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), fold.alias("s"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "n", "s"))), ","), 256)
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), digest.alias("digest"))
