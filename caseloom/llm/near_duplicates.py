"""Near-duplicate texts: universal hash minima, banding, verification, star components.

1. Each text becomes its set of hashed runs of successive words; texts with equal sets
   are one class and go on as one representative (the least id of the class).
2. ``HASHES`` universal hash functions (multiply-shift, odd multipliers from a fixed
   seed) give a signature of minima; bands of ``ROWS`` minima are the bucket keys, of
   32 bits each (two texts that share one by accident are told apart by the checks).
3. Representatives sharing a bucket are candidates (hot buckets in blocks); their
   signatures, one bit of every minimum, are compared, and those that may reach the
   threshold are checked exactly, on run sets made again from the texts.
4. Classes tied by pairs are grouped by alternating large-star and small-star.

With 256 minima in 64 bands of 4 a pair of similarity 0.6 becomes a candidate with
probability 0.99986, one of 0.8 with 1 - 1e-14.  The signature check drops a pair only
when the estimate is ``SLACK`` (5 standard deviations) below the threshold.

Defined results: null, empty and short texts (under ``min_words`` words or with no run)
belong to no pair and are groups of their own; repeated rows of one id count once; ids
that are null are left out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bpe import slices
from caseloom.operators.components import connected_components
from caseloom.plans.skew import HOT_PAIRED, class_pairs, join_unique, self_pairs
from caseloom.plans.staging import let_go, staged, staged_counting, unstage

HASHES, ROWS = 256, 4
BANDS = HASHES // ROWS
SLACK = 0.25
#: Bucket keys that one task sorts, and pairs that it holds before it gives them out.
SORTED, HELD = 2_000_000, 1_000_000
#: Texts of one block of a family whose pairs are checked together.
BLOCK = 500
#: Keys of 8 bytes that may be broadcast; more are joined by shuffle.
CHECKED = 500_000
WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20240131)
_MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """Word -> 64-bit hash; emptied when it has a million words, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _shingles(texts: list[str | None], size: int, min_words: int, known: _WordHashes) -> list[np.ndarray]:
    """The sorted distinct run hashes of each text (empty where the text is too short)."""
    out, none = [], np.empty(0, np.uint64)
    for t in texts:
        words = WORD.findall(t.lower()) if t else ()
        if len(words) < max(min_words, size):
            out.append(none)
            continue
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        acc = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):  # position matters: mixed again after every word
            acc = _mix(acc ^ (h[i : len(h) - size + 1 + i] + _K[i % 3]))
        out.append(np.unique(acc))
    return out


def _minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima per text under each universal hash: array of (texts, HASHES) of 32 bits."""
    sig = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        sig[:, k] = np.minimum.reduceat((flat * _MULT[k] + _ADD[k]) >> np.uint64(32), starts).astype(np.uint32)
    return sig


def _bands(sig: np.ndarray) -> np.ndarray:
    """The key of each band, array of (texts, BANDS) of 32 bits; a bucket is a band and its key."""
    acc = np.arange(BANDS, dtype=np.uint64)[None, :] * _K[0]
    for r in range(ROWS):
        acc = _mix(acc ^ sig[:, r::ROWS][:, :BANDS].astype(np.uint64))
    return (acc >> np.uint64(32)).astype(np.uint32)


_BITS = [f"bits_{i}" for i in range(HASHES // 64)]
_FEATURES = "id long, cls binary, bands binary, " + ", ".join(f"{x} long" for x in _BITS)


def _bit_signature(sig: np.ndarray) -> np.ndarray:
    """One bit of every minimum, in words of 64: two texts of similarity s agree in a bit with probability (1 + s) / 2."""
    return np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("id is not null and text is not null")


def features(df: DataFrame, id_col: str, text_col: str, size: int, min_words: int) -> DataFrame:
    """Class key, bit signature and band keys of each text long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                sets = _shingles(part.column(1).to_pylist(), size, min_words, known)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                sets = [sets[i] for i in keep]
                sig = _minima(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
                cols = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([x.tobytes() for x in _bands(sig)], pa.binary())]
                cols += [pa.array(np.ascontiguousarray(x)) for x in _bit_signature(sig).T]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *cols], names=["id", "cls", "bands", *_BITS])

    return _texts(df, id_col, text_col).mapInArrow(run, _FEATURES)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """The band keys of (id, bands), dealt to ``parts`` partitions by key.

    One row per batch and partition holds its keys, their bands and their ids, the ids
    as distances from the least one and in planes of bytes: about six bytes an entry,
    where a row of its own would take three times as many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = b.column(0).to_numpy()
            least = ids.min()
            away = ids.view(np.uint64) - least.view(np.uint64)
            kind = np.uint32 if away.max() < 2**32 else np.uint64
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(n, BANDS).T.ravel()  # band by band
            slot = (keys.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 2**16 else np.uint32)
            order = np.argsort(slot, kind="stable")
            ends = np.searchsorted(slot[order], np.arange(parts + 1))
            keys, bands, away = keys[order], (order // n).astype(np.uint8), away.astype(kind)[order % n]
            used = [i for i in range(parts) if ends[i] < ends[i + 1]]
            cut = lambda x: [x[ends[i] : ends[i + 1]] for i in used]  # noqa: E731, B023
            planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in cut(away)]
            cols = [pa.array(used, pa.int32()), pa.array([least] * len(used), pa.int64())]
            cols += [pa.array([x.tobytes() for x in cut(keys)], pa.binary()), pa.array([x.tobytes() for x in cut(bands)], pa.binary()), pa.array(planes, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["slot", "least", "keys", "bands", "away"])

    return rows.select("id", "bands").mapInArrow(run, "slot int, least long, keys binary, bands binary, away binary").repartitionById(parts, "slot")


def _entries(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (band and key) and ids of a partition of ``_dealt``."""
    buckets, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b in batches:
        for r in b.to_pylist():
            n = len(r["bands"])
            width = len(r["away"]) // n
            away = np.ascontiguousarray(np.frombuffer(r["away"], np.uint8).reshape(width, n).T).view(f"u{width}").ravel()
            ids.append((away.astype(np.uint64) + np.array([r["least"]], np.int64).view(np.uint64)).view(np.int64))
            buckets.append(np.frombuffer(r["bands"], np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(r["keys"], np.uint32))
    return np.concatenate(buckets), np.concatenate(ids)


def _changes(*cols: np.ndarray) -> np.ndarray:
    """True where a row of the sorted columns differs from the one before; true at the first row."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _met(dealt: DataFrame, hot: int) -> DataFrame:
    """(a, b, null), a < b, of ids that share a bucket; of a bucket of more than ``hot`` ids (id, null, bucket)."""
    names = ["a", "b", "bucket"]

    def pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = _changes(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(int(new.sum()), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, ids = _entries(batches)
        order = np.argsort(buckets, kind="stable")
        buckets, ids = buckets[order], ids[order]
        new = _changes(buckets)
        shared = ~new | ~np.append(new[1:], True)[: len(new)]
        buckets, ids = buckets[shared], ids[shared]
        order = np.lexsort((ids, buckets))
        buckets, ids = buckets[order], ids[order]
        new = _changes(buckets, ids)
        buckets, ids = buckets[new], ids[new]
        starts = np.flatnonzero(_changes(buckets))
        sizes = np.diff(np.append(starts, len(buckets)))
        held, n_held = [], 0
        for n in np.unique(sizes).tolist():
            at = starts[sizes == n]
            if n > hot:
                for i in at.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + n]), pa.nulls(n, pa.int64()), pa.array(buckets[i : i + n].view(np.int64))], names=names)
                continue
            x, y = np.triu_indices(n, 1)
            step = max(1, HELD // max(1, len(x)))
            for i in range(0, len(at) if n > 1 else 0, step):
                some = at[i : i + step, None]
                held.append((ids[some + x].ravel(), ids[some + y].ravel()))
                n_held += len(held[-1][0])
                if n_held >= HELD:
                    yield pairs(held)
                    held, n_held = [], 0
        if held:
            yield pairs(held)

    return dealt.mapInArrow(run, "a long, b long, bucket long")


def _exact(rows: DataFrame, size: int, min_words: int, threshold: float) -> DataFrame:
    """Exact similarity of the pairs of each group; those below the threshold go.

    ``rows``: (g, id, b, text), sorted by g with the texts (b null) before the pairs (id, b).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets, group = _WordHashes(), {}, None
        for whole in batches:
            for lo, hi in slices(whole.column(3)):
                b = whole.slice(lo, hi - lo)
                out: tuple[list, list, list] = ([], [], [])
                made = _shingles(b.column(3).to_pylist(), size, min_words, known)
                for g, x, y, own in zip(*(b.column(i).to_pylist() for i in range(3)), made, strict=True):
                    if g != group:
                        sets, group = {}, g
                    if y is None:
                        sets[x] = own
                        continue
                    m = np.concatenate((sets[x], sets[y]))
                    m.sort(kind="stable")
                    both = int(np.count_nonzero(m[1:] == m[:-1]))
                    # threshold compared in whole numbers where it is a decimal fraction
                    if both * 1_000_000 >= round(threshold * 1_000_000) * (len(m) - both):
                        for to, v in zip(out, (x, y, both / (len(m) - both)), strict=True):
                            to.append(v)
                types = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


class NearDuplicates:
    """The stages of one run; each property is a staged or lazy table.

    ``members``: (id, rep, copies) of every text long enough; ``pairs``: (a, b,
    similarity) of representatives of different classes.  What is shuffled shrinks step
    by step: band keys packed, pairs of ids, pairs with bit signatures, and only for
    pairs that pass those the texts themselves, each about once per family.  Files that
    no later step reads are removed as soon as that is so.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int = 5, min_words: int = 5, threshold: float = 0.8):
        self.ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
        feats, total = staged_counting(features(df, id_col, text_col, size, min_words), F.lit(True), "features")
        self.members, copies = staged_counting(self._members(feats, total), F.col("id") != F.col("rep"), "members")
        met, held = staged_counting(self._buckets(feats, copies, total), F.col("bucket").isNotNull(), "met")
        let_go(df.sparkSession)  # the shuffled band keys
        likely = self._likely(feats, met, held, threshold)
        unstage(feats)
        unstage(met)
        let_go(df.sparkSession)
        self.pairs = staged(self._checked(_texts(df, id_col, text_col), likely, size, min_words, threshold), "pairs")
        unstage(likely)
        let_go(df.sparkSession)

    @staticmethod
    def _members(feats: DataFrame, total: int) -> DataFrame:
        rows = feats.select("id", "cls").distinct()
        sizes = rows.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        return join_unique(rows, sizes, "cls", "copies", max(1, total)).select("id", "rep", "copies")

    def _buckets(self, feats: DataFrame, copies: int, total: int) -> DataFrame:
        """The representatives that share buckets, as ``_met`` gives them."""
        others = self.members.where("id <> rep").select("id")
        # a checked size; beyond it they meet by shuffle
        reps = feats.select("id", "bands").join(F.broadcast(others) if copies <= CHECKED else others, "id", "left_anti")
        parts = max(feats.sparkSession.sparkContext.defaultParallelism, -(-total * BANDS // SORTED))
        return _met(_dealt(reps, parts), HOT_PAIRED)

    @staticmethod
    def _likely(feats: DataFrame, met: DataFrame, held: int, threshold: float) -> DataFrame:
        """Candidates whose bit signatures may reach the threshold."""
        candidates = met.where("bucket is null").select("a", "b")
        if held:
            candidates = candidates.unionByName(self_pairs(met.where("bucket is not null"), "bucket", "a", held))
        bits = feats.select("id", *_BITS).dropDuplicates(["id"])
        side = lambda x: bits.select(F.col("id").alias(x), *(F.col(i).alias(f"{x}_{i}") for i in _BITS))
        apart = F.lit(0)
        for i in _BITS:
            apart = apart + F.bit_count(F.col(f"a_{i}").bitwiseXOR(F.col(f"b_{i}")))
        # similarity estimated from the share of equal bits: 2 * share - 1
        most = int(HASHES * (1 - (1 + threshold - SLACK) / 2))
        return staged(candidates.distinct().join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b"), "likely")

    @staticmethod
    def _checked(texts: DataFrame, likely: DataFrame, size: int, min_words: int, threshold: float) -> DataFrame:
        """The likely pairs that reach the threshold.

        Pairs meet under the least partner of their smaller id, which is one for all
        of a family whose texts are alike, so that a text is sent about once.  A family
        of many texts is cut into blocks, and each block meets each other one by itself.
        """
        least = likely.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("__m"))
        tied = likely.join(least, "a", "left").select(F.coalesce("__m", "a").alias("__f"), "a", "b")
        # distinct b, so that a family's blocks follow its texts and not its pairs
        cut = tied.select("__f", "b").distinct().groupBy("__f").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__n")).where("__n > 1")
        block = lambda x: F.coalesce(F.pmod(F.xxhash64(x), "__n"), F.lit(0))
        grouped = staged(tied.join(cut, "__f", "left").select(F.xxhash64("__f", block("a"), block("b")).alias("g"), "a", "b"), "tied")
        asked, n = staged_counting(grouped.select("g", F.explode(F.array("a", "b")).alias("id")).distinct(), F.lit(True), "asked")
        found = texts.join(F.broadcast(asked) if n <= CHECKED else asked, "id")
        none = lambda kind: F.lit(None).cast(kind)
        rows = found.select("g", "id", none("long").alias("b"), "text").unionByName(grouped.select("g", F.col("a").alias("id"), "b", none("string").alias("text")))
        return _exact(rows.repartition("g").sortWithinPartitions("g", F.col("b").asc_nulls_first()), size, min_words, threshold)

    def links(self) -> DataFrame:
        """(a, b, similarity), a < b: every pair of class representatives that reaches the threshold."""
        return self.pairs

    def classes(self) -> DataFrame:
        """(id, rep, copies) of every text long enough, in classes of equal run sets."""
        return self.members

    def all_pairs(self) -> DataFrame:
        """(a, b), a < b, of ids: every pair, however large the classes are."""
        return class_pairs(self.members.withColumnRenamed("id", "item"), self.pairs).select("a", "b")

    def groups(self) -> DataFrame:
        """One row per id: class (rep), family (least id of the component), links, group ids.

        ``n_links`` counts the different classes tied to the id's class; ids without a
        long enough text are classes and families of their own.
        """
        fam = connected_components(self.pairs, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("__fam"))
        links = self.pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        byrep = self.members.select("rep").distinct().join(fam, "rep", "left").join(links, "rep", "left")
        known = self.members.join(byrep, "rep")
        rows = self.ids.distinct().join(known, "id", "left")
        rep = F.coalesce("rep", "id")
        family = F.coalesce("__fam", rep)
        gid = lambda p, c: F.concat(F.lit(p), F.substring(F.sha2(c.cast("string"), 256), 1, 16))
        return rows.select(
            "id", rep.alias("class_id"), family.alias("family_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
            gid("dup:", rep).alias("duplicate_group"), gid("fam:", family).alias("family_group"),
        )


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, size: int = 5, min_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of class representatives; ``near_duplicate_groups`` tells each id's class.

    The same form at every class size: with the classes it says as much as all pairs of
    ids, without their number.
    """
    return NearDuplicates(df, id_col, text_col, size, min_words, threshold).links()


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, size: int = 5, min_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(a, b), a < b, of ids: every pair, however large the classes are."""
    return NearDuplicates(df, id_col, text_col, size, min_words, threshold).all_pairs()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, size: int = 5, min_words: int = 5, threshold: float = 0.8) -> DataFrame:
    return NearDuplicates(df, id_col, text_col, size, min_words, threshold).groups()
