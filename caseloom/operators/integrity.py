"""Joins that tell whether records agree with what they were made from.

Both sides are reduced to one row a key before they meet, so a key that a third of all
rows share arrives as one row.  Null keys match nothing and are reported as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_matches(evidence: DataFrame, results: DataFrame, key: str, content: str, ok: Column) -> DataFrame:
    """(key, content, outcome) of each evidence row: ``match`` if a usable result has its content,
    ``differs`` if usable ones have another, ``no_usable`` if there are only others, ``no_result`` if none.

    ``ok`` is a condition on ``results``.
    """
    seen = results.select(key, content, F.coalesce(ok, F.lit(False)).alias("__ok")).where(F.col(key).isNotNull())
    byboth = seen.where("__ok").select(key, F.col(content).alias("__c")).distinct()
    bykey = seen.groupBy(key).agg(F.bool_or("__ok").alias("__any"))
    rows = evidence.select(key, content).join(bykey, key, "left")
    same = byboth.select(F.col(key).alias("__k"), "__c", F.lit(True).alias("__same"))
    rows = rows.join(same, (F.col(key) == F.col("__k")) & F.col(content).eqNullSafe(F.col("__c")), "left")
    outcome = F.when(F.col("__any").isNull(), "no_result").when(~F.col("__any"), "no_usable").when(F.col("__same"), "match").otherwise("differs")
    return rows.select(key, content, outcome.alias("outcome"))


def typed_references(rows: DataFrame, ref: str, kind: str, items: DataFrame, item: str, item_kind: str) -> DataFrame:
    """``rows`` with ``check``: ``ok``, ``missing`` (no item of that id) or ``type`` (an item of another kind).

    An id listed under several kinds is ``ok`` if one of them is the row's.
    """
    known = items.where(F.col(item).isNotNull()).select(F.col(item).alias("__i"), F.col(item_kind).alias("__k")).distinct()
    ids = known.select("__i").distinct().withColumn("__there", F.lit(True))
    got = rows.join(ids, F.col(ref) == F.col("__i"), "left").drop("__i")
    pairs = known.withColumn("__right", F.lit(True))
    got = got.join(pairs, (F.col(ref) == F.col("__i")) & (F.col(kind) == F.col("__k")), "left")
    check = F.when(F.col("__right"), "ok").when(F.col("__there"), "type").otherwise("missing")
    return got.withColumn("check", check).drop("__i", "__k", "__right", "__there")


def link_reference(part: Column, link: Column) -> Column:
    """The reference of a link within its message: part, the word link, and sixteen characters of its id."""
    bare = F.regexp_replace(link, "^[a-z]+_", "")
    return F.concat(part, F.lit(":link:"), F.substring(bare, 1, 16))


def agreement(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem) of every disagreement of two tables with one row a key.

    Problems: ``missing_left``, ``missing_right``, ``repeated_left``, ``repeated_right``
    (several different rows of a key), or the name of a field that differs (nulls are equal).
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.select(key, *fields).where(F.col(key).isNotNull()).distinct()
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{tag}"), *(F.min(f).alias(f"{f}_{tag}") for f in fields))

    both = side(left, "l").join(side(right, "r"), key, "full")
    whole = (F.col("n_l") == 1) & (F.col("n_r") == 1)
    said = [
        F.when(F.col("n_l").isNull(), "missing_left"), F.when(F.col("n_r").isNull(), "missing_right"), F.when(F.col("n_l") > 1, "repeated_left"), F.when(F.col("n_r") > 1, "repeated_right"),
        *(F.when(whole & ~F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r")), f) for f in fields),
    ]
    return both.select(key, F.explode(F.array_compact(F.array(*said))).alias("problem"))


def timing_problems(df: DataFrame, key: str, total: str, phases: list[str], slack: float) -> DataFrame:
    """(key, problem): negative or missing times, and totals below the sum of their phases less ``slack``."""
    parts = F.coalesce(F.col(phases[0]), F.lit(0))
    for p in phases[1:]:
        parts = parts + F.coalesce(F.col(p), F.lit(0))
    bad = F.lit(False)
    for c in (total, *phases):
        bad = bad | (F.col(c) < 0)
    said = [F.when(F.col(total).isNull(), "no_total"), F.when(bad, "negative"), F.when(F.col(total) + slack < parts, "below_phases")]
    return df.select(key, F.explode(F.array_compact(F.array(*said))).alias("problem"))


def canonical_order(results: DataFrame, group: str, kind: str, ranks: dict[str, int], ref: str, columns: list[str]) -> DataFrame:
    """``columns`` with ``position`` within ``group``: by rank of the kind, then reference, then the row's canonical text.

    Kinds without a rank come last.  Positions are taken within a group; groups are
    messages, whose results are few by their own budget.
    """
    rank = F.lit(len(ranks))
    for k, n in ranks.items():
        rank = F.when(F.col(kind) == k, n).otherwise(rank)
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    w = Window.partitionBy(group).orderBy(rank, F.coalesce(F.col(ref), F.lit("")), text)
    return results.select(*columns, F.row_number().over(w).cast("long").alias("position"))
