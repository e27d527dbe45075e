"""Plans keep to what they promise: pruned scans, pushed filters, no needless exchange."""

from caseloom import registry
from caseloom.plans import staging
from compare import plan


def test_scans_are_pruned(spark, data):
    q = registry.queries()
    p = plan(q["fingerprint_docs"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p and "Exchange" not in p
    p = plan(q["stripped_parts"](spark, data))
    assert "PushedFilters: [IsNotNull(mime_type), EqualTo(mime_type,text/html)]" in p and "Exchange" not in p
    p = plan(q["order_rollup"](spark, data))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double,l_tax:double>" in p
    p = plan(q["smoke_sample"](spark, data))
    assert "ReadSchema: struct<sample_id:string,normalized_label:string>" in p and "IsNotNull(normalized_label)" in p


def test_top_k_is_cut_before_the_exchange(spark, data):
    p = plan(registry.queries()["stratified_split"](spark, data))
    assert "WindowGroupLimit" in p


def test_no_query_crosses_tables(spark, data):
    for name, q in registry.queries().items():
        if name not in ("family_stats",):
            p = plan(q(spark, data))
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_sweep_removes_intermediates(spark):
    df = staging.staged(spark.range(5).toDF("x"), "sweep")
    path = df.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    from pathlib import Path

    assert Path(path).exists() and staging.sweep(spark) >= 1 and not Path(path).exists()
