"""p5_found sees every address entry that p5_masked sees."""

from caseloom.llm import personal as pi


def test_phones_in_mailboxes_are_found(spark):
    model = pi.learned(spark.createDataFrame([("Jane", "Doe"), ("John", "Smith")], "g string, f string"), "g", "f")
    entries = ["+1-202-555-0105@sms.oxbow.test", "415.555.0176@x.example", "jane@x.example", "Doe,Jane<jd@x.example>", '"Jane.Doe"<jd@x.example>']
    df = spark.createDataFrame([("from", i, e) for i, e in enumerate(entries)], "place string, row_id long, text string")
    found = {(r["row_id"], r["kind"]) for r in pi.found_kinds(df, model).collect()}
    changed = {r["row_id"] for r in pi.masked(df, model).collect() if r["text"] != entries[r["row_id"]]}
    assert (0, "phone") in found and (1, "phone") in found and {i for i, _ in found} == changed
