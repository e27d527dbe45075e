"""Splits that keep tied records together: frontier breadth-first components.

The graph's nodes are group values (typed, so equal strings of different fields differ);
each record that has several values ties them.  Records are never nodes, so a group with
a third of all rows is one node whose distinct ties alone are walked.

* Adjacency lists are hash-partitioned by (node, salt); a node with many neighbours gets
  several salts, so its list is spread over several tasks.
* A wave seeds a share of the unreached nodes and expands all seeds at once, one round
  per step: a reached node takes the least label offered, a node offered different
  labels (or reached again under another) adds an edge between those labels.
* Two waves (a sixteenth of the nodes, then all that are left, which lie in components
  without a seed) reach every node.
* The label graph has only seeds for nodes: n/16 of the first wave, and of the second
  those of components that the first wave did not touch.  It is merged
  by star components.

Splits: components are ordered by hash and cut by cumulative record count.  Components
of more than ``LARGE`` of all records (fewer than 1/LARGE of them) are placed first,
largest first, each where most room is left.

Defined results: records without any group value are components of their own; null keys
are left out; repeated rows of a key count once (their values are all used); an empty
table gives no rows; a ratio of 0 gets no component as long as another has room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.components import connected_components
from caseloom.plans.skew import hot_limit, join_unique
from caseloom.plans.staging import staged, staged_counting

#: One in so many of the unreached nodes seeds a wave; only seeds are nodes of the label graph.
SEED_SHARES = (16, 1)
LARGE = 0.01
#: Neighbours of a node kept in one adjacency list; more are spread over salts.
LIST_SIZE = 10_000


def group_value(col: Column, prefix: str) -> Column:
    """A well-formed group value (``prefix:`` and 16 hex digits) or null.

    Letter case and outer blanks (any Unicode white space) are ignored.
    """
    bare = F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.rlike(rf"^{prefix}:[0-9a-f]{{16}}$"), bare)


def _adjacency(ties: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Salted adjacency lists (node, salt, other), nodes (node, salts), length of all lists."""
    both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degrees = staged(both.groupBy("a").agg(F.count(F.lit(1)).alias("d")), "degrees")
    total = degrees.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    limit = max(LIST_SIZE, hot_limit(total))
    salts = F.ceil(F.col("d") / limit).cast("int")
    hot = F.broadcast(degrees.where(F.col("d") > limit).select("a", salts.alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int")
    lists = both.join(hot, "a", "left").select(F.col("a").alias("node"), salt.alias("salt"), F.col("b").alias("other"))
    nodes = degrees.select(F.col("a").alias("node"), F.greatest(F.lit(1), salts).alias("salts"))
    return staged(lists.repartition("node", "salt"), "lists"), staged(nodes, "nodes"), total


def frontier_components(ties: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of a tie, by concurrent breadth-first waves.

    The component's id is the least node label that names it; ids agree within a
    component and differ between components.  Null ends are ignored.
    """
    clean = ties.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    lists, nodes, total = _adjacency(clean.where("a <> b"))
    alone = clean.where("a = b").select(F.col("a").alias("node")).distinct()
    reached: DataFrame | None = None
    merges: list[DataFrame] = []
    for share in SEED_SHARES:
        left = nodes if reached is None else nodes.join(reached, "node", "left_anti")
        seeds = left.where(F.pmod(F.xxhash64("node", F.lit(share)), F.lit(share)) == 0)
        front, fresh = staged_counting(seeds.select("node", F.col("node").alias("label"), "salts"), F.lit(True), "front")
        wave: list[DataFrame] = []
        while fresh:
            grown = front.select("node", "label") if reached is None else reached.unionByName(front.select("node", "label"))
            asked = front.select("node", "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            offers = staged(
                asked.join(lists, ["node", "salt"]).select(F.col("other").alias("node"), "label").distinct(), "offers"
            )
            lows = offers.groupBy("node").agg(F.min("label").alias("low"), F.count(F.lit(1)).alias("n"))
            met = lows.join(grown.withColumnRenamed("label", "had"), "node", "left").join(nodes, "node")
            met, fresh = staged_counting(met.withColumn("x", F.coalesce("had", "low")), F.col("had").isNull(), "met")
            made = join_unique(offers, met.select("node", "x", "n"), "node", "n", total)
            wave.append(made.select("x", F.col("label").alias("y")).where("x <> y"))
            reached = grown
            front = met.where("had is null").select("node", F.col("low").alias("label"), "salts")
        if wave:
            reached = staged(reached, "reached")
            tied = wave[0]
            for m in wave[1:]:
                tied = tied.unionByName(m)
            merges.append(staged(tied.distinct(), "merges"))
    if reached is None:
        return alone.select("node", F.col("node").alias("component"))
    tied = merges[0]
    for m in merges[1:]:
        tied = tied.unionByName(m)
    roots = connected_components(tied, "x", "y")
    named = reached.join(roots.withColumnRenamed("node", "label"), "label", "left")
    named = named.select("node", F.coalesce("component", "label").alias("component"))
    extra = alone.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.unionByName(extra)


def tied_records(df: DataFrame, key: str, values: list[Column]) -> DataFrame:
    """(key, component): records tied by any shared value, directly or through others.

    ``values``: one column of each field, already made comparable; null = no value.
    A component without values is named by its key.  Repeated rows of a key tie all
    the values that any of them has.
    """
    typed = [F.when(v.isNotNull(), F.concat(F.lit(f"{i}|"), v.cast("string"))) for i, v in enumerate(values)]
    held = F.array_compact(F.array(*typed))
    rows = staged(
        df.select(F.col(key).alias("key"), held.alias("held")).where("key is not null")
        .groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("held")))).alias("held")),
        "records",
    )
    first = F.element_at("held", 1)
    ties = rows.where("size(held) > 0").select(first.alias("a"), F.explode("held").alias("b")).distinct()
    comps = frontier_components(staged(ties, "ties"), "a", "b")
    tied = rows.where("size(held) > 0").select("key", first.alias("node"))
    # a node held by a third of the rows is matched by broadcast
    total = rows.count()
    sizes = tied.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    named = join_unique(tied, comps.join(sizes, "node"), "node", "n", max(1, total)).select("key", "component")
    alone = rows.where("size(held) = 0").select("key", F.concat(F.lit("key|"), F.col("key").cast("string")).alias("component"))
    return named.unionByName(alone)


def assign_splits(components: DataFrame, key: str, names: list[str], ratios: list[float]) -> DataFrame:
    """(key, component, split) in about the given shares, components kept whole."""
    comps = staged(components.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = comps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weight = sum(ratios)
    quota = [total * r / weight for r in ratios]
    room = list(quota)
    large = comps.where(F.col("n") > total * LARGE).orderBy(F.desc("n"), "component").limit(int(1 / LARGE)).collect()
    placed: list[tuple[str, str]] = []
    for row in large:  # fewer than 1/LARGE rows by construction
        best = max(range(len(names)), key=lambda i: (room[i], -i))
        room[best] -= row["n"]
        placed.append((row["component"], names[best]))
    room = [max(0.0, r) for r in room]
    spark = components.sparkSession
    fixed = F.broadcast(spark.createDataFrame(placed, "component string, fixed string"))
    rest = comps.join(fixed, "component", "left_anti")
    left = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scale = left / sum(room) if sum(room) else 0
    bounds, acc = [], 0.0
    for r in room:
        acc += r * scale
        bounds.append(acc)
    # cumulative count in hash order: per bucket of the hash, then within the bucket
    h = F.xxhash64("component")
    spread = rest.withColumn("__h", h).withColumn("__k", F.shiftrightunsigned(h, 52).cast("int"))
    sums = spread.groupBy("__k").agg(F.sum("n").alias("__s"))  # at most BUCKETS rows
    before = sums.withColumn(
        "__off", F.coalesce(F.sum("__s").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("__k", "__off")
    inside = Window.partitionBy("__k").orderBy("__h", "component").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("n").over(inside)
    at = spread.withColumn("__c", cum).join(F.broadcast(before), "__k").withColumn("__mid", F.col("__c") + F.col("__off") - F.col("n") / 2)
    pick = F.lit(names[-1])
    for name, edge, r in reversed(list(zip(names, bounds, room, strict=True))[:-1]):
        if r:
            pick = F.when(F.col("__mid") <= F.lit(edge), F.lit(name)).otherwise(pick)
    chosen = at.select("component", pick.alias("split")).unionByName(fixed.select("component", F.col("fixed").alias("split")))
    sized = chosen.join(comps, "component")
    return join_unique(components, sized, "component", "n", max(1, total)).select(key, "component", "split")


def conflicting_sets(tied: DataFrame, records: DataFrame, key: str, split: str) -> DataFrame:
    """(key, root) of all records of tied sets whose recorded splits are more than one.

    Splits are compared regardless of letter case and outer blanks; null is no split.
    ``root`` is the least key of the set.
    """
    said = records.select(F.col(key).alias("key"), F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", "")).alias("said")).distinct()
    sets = tied.join(said.groupBy("key").agg(F.min("said").alias("lo"), F.max("said").alias("hi")), "key", "left")
    roots = sets.groupBy("component").agg(
        F.min("key").alias("root"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")
    ).where("lo <> hi")
    return join_unique(tied, roots, "component", "n", max(1, tied.count())).select("key", "root")
