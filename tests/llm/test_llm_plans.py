import pytest
from caseloom.llm import queries
from compare import plan


@pytest.mark.parametrize("name,schema", [("p6_ids", "doc_id:bigint,text:string"), ("p8_pieces", "doc_id:bigint,text:string"), ("p3_restored", "part_key:bigint,text:string")])
def test_map_only_queries(spark, data, name, schema):
    p = plan(queries.queries()[name](spark, data))
    assert f"ReadSchema: struct<{schema}>" in p and p.count("Exchange (") + p.count("* Exchange") <= (2 if name == "p3_restored" else 0)


def test_terms_are_broadcast_by_size_only(spark, data):
    p = plan(queries.queries()["p4_found"](spark, data))
    assert "CartesianProduct" not in p and "NestedLoop" not in p
