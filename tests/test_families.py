"""Near pairs and families do not depend on how many other records hold a text."""

import random

from caseloom.operators import families
from pyspark.sql import functions as F


def brute(rows, similarity):
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows if len(w := (t or "").lower().split()) >= 5}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}


def test_text_posted_forty_times_and_edited(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words)) for k in range(1, 41)] + [(41, " ".join(words[:-1] + ["end"])), (42, "other words that nobody else ever wrote here")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = [(r["a"], r["b"]) for r in families.near_pairs(df, "k", F.col("t")).collect()]
    assert len(got) == len(set(got)) == 41 * 20 and set(got) == brute(rows, 0.85)
    assert {r["k"]: (r["family"], r["family_size"]) for r in families.families(df, "k", F.col("t")).collect()} == {k: (1, 41) for k in range(1, 42)} | {42: (42, 1)}


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(families, "hot_limit", lambda total, least=None: 20)  # blocks for most shared runs
    rng = random.Random(3)
    rows, foot = [], [f"f{i}" for i in range(30)]
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 80))]
        for _ in range(rng.randrange(1, 60)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(w + foot)))
    df = spark.createDataFrame(rows + [(9_001, None), (9_002, "")], "k long, t string")
    for similarity in (0.85, 0.6):
        members, sets = families.run_classes(df, "k", F.col("t"))
        pairs = families.class_pairs(members, families.rep_pairs(sets, similarity, per_task=7), per_task=7)
        got = [(r["a"], r["b"]) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, similarity)
