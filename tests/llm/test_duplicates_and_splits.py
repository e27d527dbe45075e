import random
import re
from collections import defaultdict

import pytest
from caseloom.llm import near_duplicates as nd
from caseloom.llm import tied_splits as ts
from pyspark.sql import functions as F


def brute(rows, size, least, threshold):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if k is not None and len(w) >= max(least, size):
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) * 10 >= round(threshold * 10) * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out, k = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(12, 90))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(0, 2)] = [f"x{rng.randrange(99)}"]
            out.append((k := k + 1, " ".join(w)))
        out.append((k := k + 1, "  ".join(base).upper() + "!"))
    return out + [(901, None), (902, ""), (903, "one two"), (904, "q " * 50_000), (905, "q " * 40_000), (None, "a b c d e f g h i j k l m n"), out[0]]


@pytest.mark.parametrize("checked", [500_000, 0])
def test_pairs_equal_brute_force(spark, rows, monkeypatch, checked):
    monkeypatch.setattr(nd, "CHECKED", checked)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id long, text string, rep int")  # a clashing extra column
    got = [(r["a"], r["b"]) for r in nd.near_duplicate_pairs(df, "id", "text", 3, 12, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 12, 0.6) and (904, 905) in got


def test_groups_are_the_components(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in nd.near_duplicate_groups(df, "id", "text", 3, 12, 0.6).collect()}
    parent = {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 3, 12, 0.6):
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert {k: r["family_id"] for k, r in got.items()} == {k: root(k) for k in parent}
    assert got[901]["class_id"] == 901 and got[901]["n_links"] == 0 and got[904]["class_id"] == 904 == got[905]["class_id"]
    assert re.fullmatch("dup:[0-9a-f]{16}", got[901]["duplicate_group"])


@pytest.mark.parametrize("n", [65, 1_000, 10_000])
def test_classes_and_links_say_the_same_at_every_size(spark, n):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(n).selectExpr("id", f"'{text}' AS text").union(spark.createDataFrame([(n, text + " end")], "id long, text string"))
    assert [(r["a"], r["b"]) for r in nd.near_duplicate_links(df, "id", "text", 3, 12, 0.6).collect()] == [(0, n)]
    groups = nd.near_duplicate_groups(df, "id", "text", 3, 12, 0.6)
    got = groups.groupBy("class_id", "family_id", "n_links").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, n), (n, 0, 1, 1)]
    if n <= 1_000:  # all pairs, of copies and across
        assert nd.near_duplicate_pairs(df, "id", "text", 3, 12, 0.6).distinct().count() == n * (n + 1) // 2


def test_documents_recall(spark, data):
    """Five words, 0.8: the pairs that banding gives are those of brute force."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {(r["a"], r["b"]) for r in nd.near_duplicate_pairs(docs, "doc_id", "text", 5, 5, 0.8).collect()}
    want = brute([tuple(r) for r in docs.collect()], 5, 5, 0.8)
    assert got == want and want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert nd.near_duplicate_pairs(df, "id", "text").count() == 0 and nd.near_duplicate_groups(df, "id", "text").count() == 0
    cases = spark.createDataFrame([], "n long, d string, f string, s string")
    tied = ts.tied_records(cases, "n", [F.col("d"), F.col("f")])
    assert tied.count() == 0 and ts.assign_splits(tied, "key", ["a", "b"], [1, 1]).count() == 0


def _cases():
    rng = random.Random(9)
    rows = []
    for i in range(1, 400):
        d = rng.choice([None, "", "dup:tbd", f"dup:{rng.randrange(150):016x}", f" DUP:{rng.randrange(150):016X} "])
        f = rng.choice([None, "none", f"fam:{rng.randrange(120):016x}", f"fam:{rng.randrange(120):016x}", "fam:" + "0" * 15])
        rows.append((i, d, f, rng.choice(["train", "Test ", " validation", None])))
    rows += [(500 + i, None, "fam:" + "f" * 16, "train") for i in range(200)]  # a third of all rows in one group
    rows += [(800 + i, f"dup:{1000 + i:016x}", f"fam:{1000 + i:016x}", "train") for i in range(12)] + [(830 + i, f"dup:{1000 + i:016x}", f"fam:{1001 + i:016x}", "test") for i in range(11)]  # a long chain
    return rows + rows[:5] + [(None, "dup:" + "1" * 16, None, "test")]


@pytest.mark.parametrize("list_size", [10_000, 3])
def test_tied_sets_equal_union_find(spark, monkeypatch, list_size):
    monkeypatch.setattr(ts, "LIST_SIZE", list_size)
    monkeypatch.setattr(ts, "hot_limit", lambda total: list_size)
    rows = _cases()
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, d, f, _ in rows:
        if k is None:
            continue
        root(k)
        for v, p in ((d, "dup"), (f, "fam")):
            v = (v or "").strip().lower()
            if re.fullmatch(f"{p}:[0-9a-f]{{16}}", v):
                parent[root(v)] = root(k)
    sets, said = defaultdict(set), defaultdict(set)
    for k, _, _, s in rows:
        if k is not None:
            sets[root(k)].add(k)
            if s:
                said[root(k)].add(s.strip().lower())
    want = {(k, min(m)) for c, m in sets.items() if len(said[c]) > 1 for k in m}
    df = spark.createDataFrame(rows, "n long, d string, f string, s string")
    tied = ts.tied_records(df, "n", [ts.group_value(F.col("d"), "dup"), ts.group_value(F.col("f"), "fam")])
    got = [(r["key"], r["root"]) for r in ts.conflicting_sets(tied, df, "n", "s").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    split = {r["key"]: r["split"] for r in ts.assign_splits(tied, "key", ["train", "validation", "test"], [0.7, 0.15, 0.15]).collect()}
    assert set(split) == {k for m in sets.values() for k in m}
    assert all(len({split[k] for k in m}) == 1 for m in sets.values())
    share = sum(v == "train" for v in split.values()) / len(split)
    assert 0.62 < share < 0.78
