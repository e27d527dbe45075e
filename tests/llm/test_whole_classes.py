"""p1_found lists every pair of a text sent many times, exact copy or not."""

from caseloom.llm import queries


def test_large_classes_are_listed_pairwise(spark, tmp_path):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words) if i % 2 else " ".join(words).upper() + "!" for i in range(70)] + [" ".join(words[:-1] + ["end"])] * 2 + ["see attached"]
    df = spark.createDataFrame(list(enumerate(texts)), "part_key long, text string")
    df.write.parquet(str(tmp_path / "text_parts.parquet"))
    got = [(r["part_a"], r["part_b"]) for r in queries.queries()["p1_found"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for b in range(72) for a in range(b)}
