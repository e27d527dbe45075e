"""Exact and near duplicates of records, and the families they form.

The near-duplicate join of the core is exact: records of equal run sets are one class, and
two classes are compared if they share one of their rarest runs (a prefix filter, which
loses no pair that is similar enough), however many records hold the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.operators.components import connected_components
from caseloom.plans.skew import HOT_PAIRED, class_pairs, hot_limit, join_unique
from caseloom.plans.staging import spread, staged

SIMILARITY = 0.85


def exact_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """(hash, size, first) of contents held by several records; no members are collected."""
    hashed = df.select(F.col(key).alias("k"), tx.content_hash(content).alias("hash")).where("hash is not null and hash <> ''")
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min("k").alias("first")).where("size > 1")


def run_sets(df: DataFrame, key: str, text: Column, size: int = 5) -> DataFrame:
    """(k, runs): the distinct hashed word runs of each record; none for shorter texts.

    In steps, so that the words of a text are cut and hashed once: an expression within
    a lambda, or used twice in one step, would be evaluated again each time.
    """
    rows = spread(df.select(F.col(key).alias("k"), text.alias("__text")))
    words = rows.select("k", F.transform(F.split(tx.squash(F.col("__text")), " "), lambda w: F.xxhash64(w)).alias("__w"))
    n = F.greatest(F.size("__w") - size + 1, F.lit(0))
    side = F.arrays_zip(*(F.slice("__w", i + 1, n).alias(f"w{i}") for i in range(size)))
    runs = F.transform(side, lambda x: F.xxhash64(*(x[f"w{i}"] for i in range(size))))
    return words.select("k", F.array_distinct(F.coalesce(runs, F.array().cast("array<bigint>"))).alias("runs"))


def run_frequencies(df: DataFrame, key: str, text: Column, size: int = 5) -> DataFrame:
    """(run, df): in how many records each hashed word run occurs."""
    runs = run_sets(df, key, text, size).select("k", F.explode("runs").alias("run"))
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("df"))


def run_classes(df: DataFrame, key: str, text: Column, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, sets)``: (item, rep, copies) of every record with runs, and (k, n, runs) of each rep."""
    sets = staged(run_sets(df, key, text, size), "sets").where(F.size("runs") > 0).select("k", F.sort_array("runs").alias("runs"))
    same = F.struct(F.size("runs"), F.xxhash64("runs"), F.xxhash64(F.lit(1), F.col("runs")))
    rows = sets.select(F.col("k").alias("item"), same.alias("__c"))
    sizes = rows.groupBy("__c").agg(F.min("item").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = staged(join_unique(rows, sizes, "__c", "copies", rows.count()).select("item", "rep", "copies"), "members")
    reps = members.where("item = rep").select(F.col("item").alias("k"))
    return members, staged(sets.join(reps, "k", "left_semi").select("k", F.size("runs").alias("n"), "runs"), "sets")


def rep_pairs(sets: DataFrame, similarity: float = SIMILARITY, per_task: int = 1_000) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of different sets (k, n, runs) that are similar enough.

    With the runs of every set in one order, rarest first, two such sets share a run among
    the first n - ceil(similarity * n) + 1 of each.  Runs of one set come first and meet
    nothing, so most sets offer few runs or none.  What may still be shared after the place
    of a met run bounds the similarity; only pairs within the bound fetch their sets.
    """
    least = similarity - 1e-9
    runs = sets.select("k", "n", F.explode("runs").alias("run"))
    dfs = staged(runs.groupBy("run").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "dfs")
    total = dfs.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shared = join_unique(runs, dfs, "run", "df", total).groupBy("k", "n").agg(F.count(F.lit(1)).alias("r"))  # hot runs (footers) are not shuffled
    open_ = staged(shared.where(F.col("r") >= F.ceil(F.lit(least) * F.col("n"))).select("k", "r"), "open")  # others have no run to offer
    rank = F.row_number().over(Window.partitionBy("k").orderBy("df", "run"))
    placed = runs.join(open_, "k").join(dfs, "run").withColumn("place", F.col("n") - F.col("r") + rank)
    first = placed.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    first = staged(first.select("run", F.struct("k", "n", "place").alias("x")), "first")
    counts = first.groupBy("run").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    hot = counts.where(F.col("c") > hot_limit(first.count(), HOT_PAIRED)).select("run", F.ceil(F.col("c") / per_task).cast("int").alias("blocks"))
    tagged = first.join(F.broadcast(hot), "run", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # fewer than HOT_SHARE runs
    left = tagged.select("run", F.pmod(F.xxhash64("x"), "blocks").cast("int").alias("block"), F.col("x").alias("a"))
    right = tagged.select("run", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("x").alias("b"))
    na, nb = F.col("a.n"), F.col("b.n")
    most = 1 + F.least(na - F.col("a.place"), nb - F.col("b.place"))  # true of the first run that two sets share
    able = left.join(right, ["run", "block"]).where("a.k < b.k").where(F.least(na, nb) >= least * F.greatest(na, nb))
    able = staged(able.where(most >= least * (na + nb - most)).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct(), "able")
    side = lambda x: sets.select(F.col("k").alias(x), F.col("runs").alias(f"r{x}"))
    scored = able.join(side("a"), "a").join(side("b"), "b").select("a", "b", tx.jaccard(F.col("ra"), F.col("rb")).alias("similarity"))
    return staged(scored, "scored").where(F.col("similarity") >= similarity)


def near_pairs(df: DataFrame, key: str, text: Column, size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of records whose run sets are similar enough, equal ones too."""
    members, sets = run_classes(df, key, text, size)
    return class_pairs(members, rep_pairs(sets, similarity))


def families(df: DataFrame, key: str, text: Column, size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(key, family, family_size): records tied by equal content or near pairs; root = least key."""
    body = tx.squash(text)
    hashed = staged(df.select(F.col(key).alias("k"), F.nullif(tx.content_hash(body), F.lit("")).alias("h")), "hashed")
    firsts = hashed.where("h is not null").groupBy("h").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    exact = join_unique(hashed, firsts, "h", "n", hashed.count()).where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    members, sets = run_classes(df, key, text, size)  # a class is tied by its rep: its pairs are not listed
    same = members.where("item <> rep").select(F.col("rep").alias("a"), F.col("item").alias("b"))
    ties = exact.unionByName(same).unionByName(rep_pairs(sets, similarity).select("a", "b"))
    comps = connected_components(staged(ties, "ties"), "a", "b")
    named = df.select(F.col(key).alias("k")).distinct().join(comps.withColumnRenamed("node", "k"), "k", "left")
    named = staged(named.select(F.col("k").alias(key), F.coalesce("component", "k").alias("family")), "families")
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("family_size"))
    return join_unique(named, sizes, "family", "family_size", named.count()).select(key, "family", "family_size")


def family_stats(members: DataFrame, family: str, dataset: str) -> DataFrame:
    """One row: families, multi-member families, the largest, families across datasets."""
    per = members.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(dataset).alias("sets"))
    return per.agg(
        F.count(F.lit(1)).alias("families"), F.count_if(F.col("n") > 1).alias("multi_member"),
        F.max("n").alias("largest"), F.count_if(F.col("sets") > 1).alias("across_datasets"),
    )
