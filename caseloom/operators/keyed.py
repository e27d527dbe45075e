"""Keyed registries: ordered first occurrence, conflict-checked union, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.staging import staged


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``; the others are dropped.

    Partial aggregation keeps one row per key and task, so a frequent key costs nothing
    extra.  Null keys are a key of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order`` (a later record replaces an earlier one)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return picked.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def registry(rows: DataFrame, keys: list[str], role: str, order: list[str]) -> DataFrame:
    """One row per key: its first occurrence, the roles in order of first appearance, the count.

    Roles are first reduced to one row per key and role, so what is collected per key is
    bounded by the number of roles.
    """
    pos = F.struct(*order)
    per_role = rows.groupBy(*keys, role).agg(F.min(pos).alias("__at"), F.count(F.lit(1)).alias("__n"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("__at", role))), lambda x: x[role])
    return per_role.groupBy(*keys).agg(
        roles.alias("roles"), F.min("__at").alias("first_at"), F.sum("__n").cast("long").alias("occurrences")
    )


def keyed_union(parts: list[DataFrame], key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of keyed tables.

    Equal content under one key is one row (the first part that has it); a key with
    different contents is a conflict and is not merged.
    """
    tagged = [p.select(key, *content).withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    print_ = F.xxhash64(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
    grouped = rows.withColumn("__print", print_).groupBy(key).agg(
        F.min("__print").alias("__lo"), F.max("__print").alias("__hi"), F.count(F.lit(1)).alias("copies"),
        F.min_by(F.struct(*content, "__part"), "__part").alias("__row"),
    )
    merged = grouped.where("__lo = __hi").select(key, *(F.col(f"__row.{c}").alias(c) for c in content), F.col("__row.__part").alias("source_no"))
    return merged, grouped.where("__lo <> __hi").select(key, "copies")


def dangling(rows: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return rows.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def collapse_issues(issues: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Exact repeats of an issue reduced to the first, with its place and the count."""
    return issues.groupBy(*keys).agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("repeats"))


def ordinals(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """1-based number within the group, with the group's name: ``name_00001``.

    Rows are sorted over range partitions; a partition's rows of a group are numbered
    from the count of that group's rows in the partitions before it, so a group of any
    size is spread over tasks.  ``order`` must be unique within the group.
    """
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(n, group, *order)
    parts = staged(ranged.withColumn("__p", F.spark_partition_id()), "ranged")
    counts = parts.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__c"))  # groups + partitions rows at most
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order))
    numbered = parts.withColumn("__r", inside).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    no = F.lpad((F.col("__r") + F.col("__off")).cast("string"), 5, "0")
    return numbered.withColumn(out, F.concat(F.col(group), F.lit("_"), no)).select(*df.columns, out)
