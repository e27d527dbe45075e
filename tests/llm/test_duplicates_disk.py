"""Problem 1 keeps within four times its input on disk, and its blocks lose no pair."""

import random
from pathlib import Path

import pytest
from caseloom.llm import near_duplicates as nd
from caseloom.plans.staging import staging_dir


def _written(spark):
    """Bytes of shuffle and of files that each stage so far has written, by stage."""
    sc, none = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm.java.util.ArrayList()
    sc.listenerBus().waitUntilEmpty()
    no_quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)
    stages = sc.statusStore().stageList(none, False, False, no_quantiles, none)
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() + s.outputBytes() for i in range(stages.size())}


def test_disk_follows_the_input(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.randrange(65_536):04x}" for _ in range(100))) for k in range(6_000)]
    rows += [(6_000 + k, t + " end") for k, t in rows[:1_000]]
    spark.createDataFrame(rows, "id long, text string").write.option("compression", "zstd").parquet(str(tmp_path / "t"))
    before = _written(spark)
    got = nd.near_duplicate_links(spark.read.parquet(str(tmp_path / "t")), "id", "text", 3, 12, 0.6).collect()
    assert {(r["a"], r["b"]) for r in got} == {(k, 6_000 + k) for k in range(1_000)}
    wrote = sum(n for k, n in _written(spark).items() if k not in before)
    assert wrote < 4 * sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert not [p for p in Path(staging_dir(spark).removeprefix("file:")).glob("features-*/*.parquet")]


@pytest.mark.parametrize("hot", [3, 2_000])
def test_blocks_lose_no_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(nd, "HOT_PAIRED", hot)
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "SORTED", 500)
    monkeypatch.setattr(nd, "HELD", 7)
    words = [f"w{i}" for i in range(60)]
    ids = [-(2**62), -5, *range(20), 2**62]  # far apart: ids of eight bytes
    df = spark.createDataFrame([(k, " ".join([*words[:-1], f"x{k}"])) for k in ids] + [(99, "a b c")], "id long, text string")
    got = [(r["a"], r["b"]) for r in nd.near_duplicate_pairs(df, "id", "text", 3, 12, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in ids for b in ids if a < b}
