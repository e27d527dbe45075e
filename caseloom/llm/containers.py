"""Filling containers of fixed capacity: a linear grouping scheme over the whole corpus.

1. Items larger than the capacity give full containers and a remainder; nothing else is
   divided.
2. Large items (over ``SMALL`` of the capacity) are put in ``GROUPS`` groups of about
   equal cardinality by size and rounded up to their group's largest size.  Only the
   histogram of sizes is needed for that: at most ``capacity`` rows, whatever the corpus.
3. Configurations of the few rounded sizes are optimised by column generation (the
   linear program's duals price new configurations, a knapsack table finds them); the
   fractional plan is rounded down and the rest packed by best fit.
4. Actual items take the slots of their group by rank (ranks by hash buckets, no group
   in one task); they are no larger than the slot, so every container keeps its capacity.
5. Small items go by best fit, largest first, into what is left.  Containers and small
   items are spread by hash over shards of about ``SHARD`` rows; each shard opens at
   most one container that it does not fill.

Defined results: null and empty texts are items of size 0 and share a container with
others (or one of their own if there are none); repeated rows are items of their own
only if their ids differ; null ids are left out; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.plans.skew import dense_rank_rows
from caseloom.plans.staging import staged

GROUPS = 48
SMALL = 1 / 8
SHARD = 10_000


def group_sizes(hist: list[tuple[int, int]], groups: int) -> np.ndarray:
    """Upper sizes of groups of about equal cardinality; sorted, last = largest size."""
    size = np.array([s for s, _ in hist], np.int64)
    cum = np.cumsum([n for _, n in hist])
    if not len(size):
        return size
    marks = np.searchsorted(cum, cum[-1] * np.arange(1, groups + 1) / groups)
    return np.unique(size[np.minimum(marks, len(size) - 1)])


def _best_config(size: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest worth: a knapsack table over the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = np.searchsorted(size, c, "right")
        if n:
            value = best[c - size[:n]] + worth[:n]
            j = int(value.argmax())
            if value[j] > best[c - 1]:
                best[c], pick[c] = value[j], j
                continue
        best[c] = best[c - 1]
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        counts[pick[c]] += 1
        c -= int(size[pick[c]])
    return counts


def plan_configs(size: np.ndarray, count: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, multiplicity): containers for ``count`` items of each size."""
    k = len(size)
    if not k:
        return []
    basis = np.diag(capacity // size).astype(float)
    x = np.linalg.solve(basis, count.astype(float))
    for _ in range(20 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        col = _best_config(size, duals, capacity)
        if duals @ col <= 1 + 1e-6:
            break
        step = np.linalg.solve(basis, col.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = col
    left = count.copy()
    plan: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-x):
        col = basis[:, j].astype(np.int64)
        times = min(int(x[j] + 1e-9), *(int(left[i] // col[i]) for i in np.flatnonzero(col)))
        if times > 0:
            plan.append((col, times))
            left -= col * times
    # at most k containers' worth is left: best fit, largest first
    room: list[tuple[int, int]] = []
    open_: list[np.ndarray] = []
    for i in range(k - 1, -1, -1):
        for _ in range(int(left[i])):
            at = bisect_left(room, (int(size[i]), -1))
            if at < len(room):
                r, b = room.pop(at)
            else:
                r, b = capacity, len(open_)
                open_.append(np.zeros(k, np.int64))
            open_[b][i] += 1
            insort(room, (r - int(size[i]), b))
    return plan + [(c, 1) for c in open_]


def best_fit(rooms: list[tuple[int, int]], sizes: list[int], capacity: int) -> list[int]:
    """Container of each item: an index of ``rooms`` or, from len(rooms) on, a new one.

    ``sizes`` come largest first; ``rooms`` holds (room, name) in any order.
    """
    free = sorted((r, i) for i, (r, _) in enumerate(rooms))
    made, out = len(rooms), []
    for s in sizes:
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b, made = capacity, made, made + 1
        out.append(b)
        if r - s > 0:
            insort(free, (r - s, b))
    return out


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece, size, container) of every item, each of ``sizes`` rows one item.

    ``piece`` is 0 for items that are not divided.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    base = sizes.select(F.col(id_col).cast("long").alias("id"), n.alias("n")).where("id is not null").dropDuplicates(["id"])
    parts = F.when(F.col("n") > capacity, F.ceil(F.col("n") / capacity).cast("int")).otherwise(1)
    items = staged(
        base.select("id", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece")).select(
            "id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("size")
        ),
        "items",
    )
    hist = items.groupBy("size").agg(F.count(F.lit(1)).alias("c")).collect()  # at most capacity + 1 rows
    total = sum(r["c"] for r in hist)
    if not total:
        return items.withColumn("container", F.lit(None).cast("long"))
    edge = int(capacity * SMALL)
    large = sorted((r["size"], r["c"]) for r in hist if r["size"] > edge)
    upper = group_sizes(large, GROUPS)
    count = np.zeros(len(upper), np.int64)
    for s, c in large:
        count[np.searchsorted(upper, s)] += c
    plan = plan_configs(upper, count, capacity)
    first = np.cumsum([0, *(t for _, t in plan)])
    # slots of a group: ranges of ranks, one per configuration that has the group
    starts, bases, widths = [], [], []
    for g in range(len(upper)):
        rank, s, b, w = 0, [], [], []
        for (col, times), at in zip(plan, first[:-1], strict=True):
            if col[g]:
                s.append(rank), b.append(int(at)), w.append(int(col[g]))
                rank += int(col[g]) * times
        starts.append(np.array(s, np.int64)), bases.append(np.array(b, np.int64)), widths.append(np.array(w, np.int64))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "rank"))
            out = np.empty(len(g), np.int64)
            for x in np.unique(g):
                at = np.flatnonzero(g == x)
                j = np.searchsorted(starts[x], r[at], "right") - 1
                out[at] = bases[x][j] + (r[at] - starts[x][j]) // widths[x][j]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "size")), pa.array(out)], names=["id", "piece", "size", "container"])

    shape = "id long, piece int, size long, container long"
    shards = max(1, -(-total // SHARD))
    if len(upper):
        bounds = F.array(*(F.lit(int(u)) for u in upper))
        big = items.where(F.col("size") > edge).withColumn("g", F.size(F.filter(bounds, lambda u: u < F.col("size"))))
        ranked = dense_rank_rows(big, "g", F.xxhash64("id", "piece"), "rank", shards)
        placed = staged(ranked.select("id", "piece", "size", "g", "rank").mapInArrow(slots, shape), "placed")
        rooms = placed.groupBy("container").agg((F.lit(capacity) - F.sum("size")).alias("room")).where("room > 0")
    else:
        placed = spark.createDataFrame([], shape)
        rooms = spark.createDataFrame([], "container long, room long")
    made = int(first[-1])

    def fit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["size", "id", "piece"], ascending=[False, True, True])
        right = right.sort_values("container")
        names = right["container"].tolist()
        at = best_fit(list(zip(right["room"].tolist(), names, strict=True)), left["size"].tolist(), capacity)
        shard = int(key[0])
        left["container"] = [names[i] if i < len(names) else made + (i - len(names)) * shards + shard for i in at]
        return left[["id", "piece", "size", "container"]]

    small = items.where(F.col("size") <= edge).withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    spread = rooms.withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(shards)))
    fitted = small.groupBy("shard").cogroup(spread.groupBy("shard")).applyInPandas(fit, shape)
    return placed.unionByName(fitted)
