import pandas as pd
from caseloom.streaming import quotas


def _events():
    base = pd.Timestamp("2024-01-01 23:59:00")
    gaps = [0, 10, 20, 30, 40, 60, 61, 5000, 5001, 90000]
    return [("a", i, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for i, s in enumerate(gaps)] + [("b", 99, base.to_pydatetime())]


def test_batch_rule(spark):
    df = spark.createDataFrame(_events(), "key string, event_id long, ts timestamp")
    got = {r["event_id"]: r["reason"] for r in quotas.admission_batch(df, 4, 60, 500).collect()}
    assert got[3] is None and got[4] == "window" and got[5] is None and got[6] == "window" and got[99] is None
    day = {r["event_id"]: r["reason"] for r in quotas.admission_batch(df, 100, 60, 2).collect()}
    assert day[2] == "day" and day[5] is None and day[7] == "day" and day[9] is None


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_events(), "key string, event_id long, ts timestamp")
    for n in (0, 1):  # two files, one micro-batch each, in time order
        df.where(f"{'not' if n else ''} (event_id < 5)").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = quotas.admission_stream(src, 4, 60, 500).writeStream.format("memory").queryName("adm").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["event_id"], r["admitted"]) for r in rows)
    assert key(spark.table("adm").collect()) == key(quotas.admission_batch(df, 4, 60, 500).collect())


def test_first_requests_and_windows(spark, tmp_path):
    df = spark.createDataFrame(_events() + _events()[:3], "key string, event_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = quotas.first_requests(src, ["key", "event_id"], "ts").writeStream.format("memory").queryName("first").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("first").count() == len(_events())
    w = quotas.windowed_counts(src, "ts", "key").writeStream.outputMode("complete").format("memory").queryName("win").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("win").groupBy().sum("n").first()[0] == len(_events()) + 3
