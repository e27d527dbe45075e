"""Nearest cases by cosine distance, one per family, with isolation rules.

The queries are a stated set; they are read in blocks of ``BLOCK`` rows, and each block
goes to every task that holds base rows (its size is bounded by the block).  A task
keeps, per query and family, the nearest base row, and of these the nearest ``k``: more
can never be asked of it, so what is shuffled is queries x tasks x k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(-1, dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def nearest_per_family(
    base: DataFrame, queries: DataFrame, key: str, vector: str, family: str, k: int = 3, max_distance: float = 0.4,
    exclude_same: bool = True, block: int = BLOCK,
) -> DataFrame:
    """(query, key, family, distance, rank): up to ``k`` nearest rows within the distance.

    One row per family; with ``exclude_same`` rows of the query's own key or family are
    left out (null families match nothing and count as families of their own).  Ties go
    to the smaller key.  Distances are rounded to 6 digits before they are compared.
    Null and zero vectors are at distance 1 from everything.
    """
    stated = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(family).cast("string").alias("f"))
    stated = stated.where("k is not null and v is not null")
    n = stated.count()
    rows = base.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(family).cast("string").alias("f"))
    rows = rows.where("k is not null and v is not null")
    out = None
    for b in range(max(1, -(-n // block))):
        part = stated.where(F.pmod(F.xxhash64("k"), F.lit(max(1, -(-n // block)))) == b)
        got = part.toArrow()  # one block of the stated queries: about BLOCK rows
        found = _block(rows, got, k, max_distance, exclude_same)
        out = found if out is None else out.unionByName(found)
    near = Window.partitionBy("query", "fam").orderBy("distance", "k")
    top = Window.partitionBy("query").orderBy("distance", "k")
    one = out.withColumn("r", F.row_number().over(near)).where("r = 1").drop("r")
    ranked = one.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query", F.col("k").alias(key), F.col("f").alias(family), "distance", "rank")


def _block(rows: DataFrame, got: pa.Table, k: int, max_distance: float, exclude_same: bool) -> DataFrame:
    qk = got.column("k").to_numpy()
    qf = np.array([x if x is not None else "" for x in got.column("f").to_pylist()], object)
    dim = len(got.column("v")[0]) if got.num_rows else 0
    q = _matrix(got.column("v").combine_chunks(), dim) if got.num_rows else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[str, tuple[float, int, str | None]]] = {}
        for b in batches:
            if not b.num_rows or not len(qk):
                continue
            keys, fams = b.column("k").to_numpy(), b.column("f").to_pylist()
            own = [f if f is not None else f"\0{i}" for i, f in zip(keys, fams, strict=True)]
            m = _matrix(b.column("v"), dim)
            for lo in range(0, len(qk), 512):
                d = np.round(1 - q[lo : lo + 512] @ m.T, 6)
                for i in range(len(d)):
                    near = np.flatnonzero(d[i] <= max_distance)
                    if not len(near):
                        continue
                    mine, met = best.setdefault(lo + i, {}), set()
                    for j in near[np.lexsort((keys[near], d[i][near]))].tolist():
                        if own[j] in met or exclude_same and (keys[j] == qk[lo + i] or fams[j] is not None and fams[j] == qf[lo + i]):
                            continue
                        met.add(own[j])
                        cand = (float(d[i, j]), int(keys[j]), fams[j])
                        if own[j] not in mine or cand[:2] < mine[own[j]][:2]:
                            mine[own[j]] = cand
                        if len(met) == k:  # this batch has no nearer families
                            break
                    if len(mine) > 8 * k:
                        best[lo + i] = dict(sorted(mine.items(), key=lambda x: x[1][:2])[:k])
        flat = [(int(qk[i]), c[1], c[2], f, c[0]) for i, mine in best.items() for f, c in sorted(mine.items(), key=lambda x: x[1][:2])[:k]]
        cols = list(zip(*flat, strict=True)) if flat else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)],
            names=["query", "k", "f", "fam", "distance"],
        )

    return rows.mapInArrow(run, "query long, k long, f string, fam string, distance double")


def exclude(found: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys is among the taken ones; a null key never matches."""
    for c in keys:
        found = found.join(taken.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return found


def add_cases(index: DataFrame, new: DataFrame, key: str, family: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason) of rows to be added to an index.

    Identical rows are skipped silently, different content under a known key is refused,
    as is a second row of a family, in the index or among the new rows.
    """
    mark = lambda df: df.withColumn("__p", F.xxhash64(F.to_json(F.struct(*content), {"ignoreNullFields": "false"})))
    known = mark(index).select(F.col(key), F.col("__p").alias("__old"))
    fresh = mark(new.dropDuplicates([key, *content])).join(known, key, "left")
    families = index.select(F.col(family), F.lit(True).alias("__fam")).where(F.col(family).isNotNull()).distinct()
    todo = fresh.where("__old is null or __old <> __p").join(families, family, "left")
    first = F.row_number().over(Window.partitionBy(family).orderBy(key))
    why = (
        F.when(F.col("__old").isNotNull(), "divergent").when(F.col("__fam"), "family_present")
        .when(F.col(family).isNotNull() & (first > 1), "family_repeated")
    )
    judged = todo.withColumn("reason", why)
    return judged.where("reason is null").select(*new.columns), judged.where("reason is not null").select(key, "reason")


def stub_embedding(text) -> object:
    """Deterministic 16-dimensional unit vector of a text: its hash's first bytes, normalized."""
    h = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.round(x / norm, 9))
