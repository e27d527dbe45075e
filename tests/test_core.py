import pandas as pd
import pytest
from caseloom.functions import text as tx
from caseloom.functions import urls as u
from caseloom.operators import facts, families, keyed, metrics, payloads, retrieval, sequences, splits
from caseloom.operators.components import connected_components
from pyspark.sql import functions as F


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,host,normal",
    [
        ("HTTPS://User:pw@Example.COM:443/A?b=C#d", "example.com", "https://example.com/A?b=C"),
        ("http://a.b:8080/x", "a.b", "http://a.b:8080/x"), ("mailto:x@y.z", None, None), (None, None, None), ("", None, None),
    ],
)
def test_urls(spark, url, host, normal):
    assert one(spark, u.http_host(F.col("v")), v=url) == host
    assert one(spark, u.normalize_url(F.col("v")), v=url) == normal


@pytest.mark.parametrize(
    "url,why",
    [("ftp://a.b/", "scheme"), ("http://u@a.b/", "userinfo"), ("http://x.test/", "reserved_suffix"), ("http://10.0.0.1/", "not_public"),
     ("https://a.org/?token=1", "credential"), ("https://a.org/u/a@b.cc", "personal"), ("https://a.org/x", None), (None, "scheme")],
)
def test_first_refusal(spark, url, why):
    assert one(spark, u.send_refusal(F.col("v")), v=url) == why


def test_text_functions(spark):
    assert one(spark, tx.squash(F.col("v")), v="  A\t b\n") == "a b"
    assert one(spark, tx.content_hash(F.col("v")), v="") == ""
    assert one(spark, tx.word_count(F.col("v")), v=" \n") == 0
    assert one(spark, tx.fingerprint_text_udf(F.col("v")), v="ﬁ  Straße") == "fi strasse"
    assert one(spark, F.size(tx.shingles(F.col("v"))), v="a b c d") == 0
    assert one(spark, F.size(tx.shingles(F.col("v"))), v="a b c d e f") == 2
    assert one(spark, F.size(tx.shingles(F.col("v"))), v=None) == 0
    assert one(spark, tx.http_date(F.col("v")).cast("string"), v="Tue, 02 Jan 2024 02:56:51 -0000") == "2024-01-02 02:56:51"
    assert one(spark, tx.http_date(F.col("v")), v="soon") is None
    assert one(spark, tx.iso_datetime_ok(F.col("v")), v="2024-01-02T03:04:05Z") is True
    assert one(spark, tx.iso_datetime_ok(F.col("v")), v="2024-13-02T03:04:05Z") is False
    assert one(spark, tx.mask_secrets(F.col("v")), v="api_key=abc123 x") == "api_key=[secret] x"
    assert one(spark, tx.merge_notes(F.col("a"), F.col("b")), a="", b="n") == "n"
    assert one(spark, payloads.fenced_json(F.col("v")), v="x ```json\n{\"a\":1}\n``` y") == '{"a":1}'
    assert one(spark, payloads.fenced_json(F.col("v")), v="```1``` ```2```") is None


def test_masking_reaches_nested_leaves(spark):
    df = spark.createDataFrame([(["token=abcdef"], {"k": "token=abcdef"}, ("token=abcdef", 1))], "a array<string>, m map<string,string>, s struct<x:string,n:int>")
    r = tx.mask_secrets_everywhere(df).first()
    assert r["a"] == ["token=[secret]"] and r["m"] == {"k": "token=[secret]"} and r["s"]["x"] == "token=[secret]" and r["s"]["n"] == 1


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, 8), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 200 + i) for i in range(50)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e, "a", "b").collect()}
    assert got[3] == 1 and got[9] == 8 and got[5] == 5 and got[140] == 100 and got[249] == 7 and 4 not in got
    assert connected_components(e.limit(0), "a", "b").count() == 0


def test_families(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:-1] + ["end"])), (4, long), (5, "short text"), (6, "Short  TEXT"), (7, None), (8, "")]
    got = {r["k"]: r["family"] for r in families.families(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}


def test_registry_and_conflicts(spark):
    rows = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 2), (None, "x", 4)], "k string, role string, pos long")
    got = {r["k"]: (r["roles"], r["occurrences"]) for r in keyed.registry(rows, ["k"], "role", ["pos"]).collect()}
    assert got["a"] == (["y", "x"], 3) and got[None] == (["x"], 1)
    p = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v long")
    q = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, v long")
    merged, bad = keyed.keyed_union([p, q], "k", ["v"])
    assert {r["k"] for r in merged.collect()} == {"a", "c"} and {r["k"] for r in bad.collect()} == {"b"}
    assert {r["k"] for r in keyed.dangling(p, "v", q, "v").collect()} == {"b"}
    assert keyed.first_by(rows.where("k = 'a'"), ["k"], ["pos"]).first()["pos"] == 1


def test_hand_metric_table(spark):
    """Fourteen rows: fraude 3 of 4 found and 1 called so wrongly, spam 1 of 3, menace never said, legitime 4 of 5."""
    rows = [("fraude", "fraude")] * 3 + [("fraude", "spam"), ("spam", "spam"), ("spam", None), ("spam", "legitime")] + [("menace", None), ("menace", "legitime")]
    rows += [("legitime", "legitime")] * 4 + [("legitime", "fraude"), (None, "spam"), ("other", "spam")]
    df = spark.createDataFrame(rows, "t string, p string")
    r = {x["label"]: x for x in metrics.classification(df, "t", "p").collect()}
    got = {k: (x["support"], x["predicted"], x["hits"], x["abstained"], x["precision"], x["recall"], x["f1"]) for k, x in r.items()}
    assert got["fraude"] == (4, 4, 3, 0, 0.75, 0.75, 0.75) and got["spam"] == (3, 2, 1, 1, 0.5, 0.333333, 0.4)
    assert got["menace"] == (2, 0, 0, 1, 0.0, 0.0, 0.0) and got["legitime"] == (5, 6, 4, 0, 0.666667, 0.8, 0.727273)
    assert got["phishing"] == (0, 0, 0, 0, None, None, None)
    m = metrics.macro_f1(metrics.classification(df, "t", "p")).first()
    assert m["supported"] == 4 and m["macro_f1_all"] is None and m["macro_f1_supported"] == pytest.approx((0.75 + 0.4 + 0 + 0.727273) / 4, abs=1e-6)
    c = {x["truth"]: x for x in metrics.confusion(df, "t", "p").collect()}
    assert len(c) == 6 and (c["menace"]["abstained"], c["menace"]["as_legitime"], c["spam"]["as_spam"]) == (1, 1, 1)
    e = metrics.classification(df.limit(0), "t", "p").collect()
    assert len(e) == 6 and all(x["precision"] is None for x in e)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 21)] + [("g", None), ("h", 5.0)], "g string, v double")
    got = {r["g"]: r["p95"] for r in metrics.nearest_rank(df, ["g"], "v", 0.95, "p95").collect()}
    assert got == {"g": 19.0, "h": 5.0}


@pytest.mark.parametrize("vector,ok", [((0.5, 0.5, 0, 0, 0, 0), True), ((0.5, 0.4, 0, 0, 0, 0), False), ((1.5, -0.5, 0, 0, 0, 0), False), ((None, 1, 0, 0, 0, 0), False), ((float("nan"), 1, 0, 0, 0, 0), False)])
def test_vectors(spark, vector, ok):
    names = [f"p{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in vector)], ", ".join(f"{n} double" for n in names))
    label, _, margin = metrics.verdict(names)
    r = df.select(metrics.vector_ok(names).alias("ok"), label.alias("l"), margin.alias("m")).first()
    assert r["ok"] is ok
    if ok:
        assert r["l"] == "spear_phishing" and r["m"] == 0.0  # a tie goes to the earlier label


def test_budgets(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([60, 50, 30, 10])] + [(2, 0, None)], "k long, i long, c long")
    kept = sequences.prefix_budget(df, ["k"], ["i"], F.col("c"), 100).where("k = 1").collect()
    assert [r["i"] for r in kept] == [0] and kept[0]["truncated"]
    g = {r["k"]: (r["kept"], r["used"]) for r in sequences.greedy_budget(df, ["k"], ["i"], "i", "c", 100).collect()}
    assert g == {1: ([0, 2, 3], 100), 2: ([0], 0)}
    calls = spark.createDataFrame([(1, 1, "vt", "a"), (1, 2, "vt", "a"), (1, 3, "urlscan", "b"), (1, 4, "urlscan", "c"), (1, 5, "vt", "d"), (1, 6, "vt", "e")], "r long, n long, tool string, o string")
    out = sequences.call_budget(calls, "r", ["n"], ["tool", "o"], F.col("tool") == "urlscan", 3, 1).orderBy("n").collect()
    assert [r["outcome"] for r in out] == ["ok", "duplicate", "ok", "special_budget", "ok", "budget"]


def test_windows(spark):
    base = pd.Timestamp("2024-01-01")
    df = spark.createDataFrame([("a", i, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for i, s in enumerate([0, 30, 60, 61])], "k string, i long, ts timestamp")
    got = [r["n"] for r in sequences.sliding_count(df, "k", "ts", 60, "n").orderBy("i").collect()]
    assert got == [1, 2, 2, 3]  # the window is half open: a row exactly 60 s old is out
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["From a", "x", "From b", "", "From c", "y"])], "f string, n long, line string")
    assert [(r["line"], r["message_no"]) for r in sequences.sections(lines, "f", "n", "line").orderBy("n").collect()] == [("x", 1), ("From b", 1), ("", 1), ("y", 2)]


def test_splits(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (4, "q")], "k long, h string")
    b = spark.createDataFrame([(1, "x", "p"), (2, None, "p"), (3, "w", "p"), (5, "v", "p")], "k long, h string, l string")
    rows, bad = splits.guarded_join(a, b, "k", ["h"])
    assert {r["k"] for r in rows.collect()} == {1, 2} and {(r["k"], r["problem"]) for r in bad.collect()} == {(3, "different"), (4, "missing_right"), (5, "missing_left")}
    assert {r["k"] for r in splits.complement(a, b, ["h"]).collect()} == {2, 3, 4}
    s1, s2 = (splits.seal(a.repartition(n), ["k", "h"], "k").first() for n in (1, 3))
    assert s1 == s2 and s1["rows"] == 4 and splits.seal(a.where("k < 4"), ["k", "h"], "k").first()["digest"] != s1["digest"]
    many = spark.createDataFrame([(f"s{i}", f"f{i % 7}", "spam") for i in range(30)], "k string, f string, l string")
    got = splits.stratified_select(many, "f", "k", "l", {"spam": 5}).collect()
    assert len(got) == 5 and sorted(r["split"] for r in got) == ["dev", "dev", "test", "test", "test"]


def test_retrieval(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.9, 0.1], "b"), (4, [0.0, 1.0], "c"), (5, [0.8, 0.2], None), (6, None, "d"), (7, [0.0, 0.0], "e")]
    df = spark.createDataFrame(rows, "k long, v array<double>, f string")
    got = [(r["query"], r["k"], r["rank"]) for r in retrieval.nearest_per_family(df, df.where("k = 1"), "k", "v", "f", 3, 0.4).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 5, 2)]
    assert retrieval.nearest_per_family(df, df.limit(0), "k", "v", "f").count() == 0
    blocks = retrieval.nearest_per_family(df, df, "k", "v", "f", 3, 0.4, block=2).count()
    assert blocks == retrieval.nearest_per_family(df, df, "k", "v", "f", 3, 0.4).count()
    index = spark.createDataFrame([("x", "fa", "t")], "id string, fam string, txt string")
    new = spark.createDataFrame([("x", "fa", "t"), ("x", "fa", "u"), ("y", "fa", "t"), ("z", "fz", "t"), ("zz", "fz", "t")], "id string, fam string, txt string")
    ok, no = retrieval.add_cases(index, new, "id", "fam", ["fam", "txt"])
    assert [r["id"] for r in ok.collect()] == ["z"] and {(r["id"], r["reason"]) for r in no.collect()} == {("x", "divergent"), ("y", "family_present"), ("zz", "family_repeated")}


def test_facts(spark):
    html = "<a href='http://a.org/x'>http://b.org</a> <a href=\"http://a.org\">text</a><form action='/go'><img src='cid:1'> see http://c.org/y."
    df = spark.createDataFrame([(1, "text/html", html), (2, "text/plain", "go http://d.org/, now"), (3, "text/plain", None)], "k long, m string, t string")
    got = {(r["k"], r["role"], r["value"]) for r in facts.part_links(df, ["k"], "t", "m").collect()}
    assert (1, "href", "http://a.org/x") in got and (1, "form_action", "/go") in got and (1, "remote_resource", "cid:1") in got and (2, "visible_url", "http://d.org/") in got
    assert one(spark, facts.display_mismatch(F.col("h"), F.col("d")), h="http://a.org", d="http://b.org") is True
    assert one(spark, facts.display_mismatch(F.col("h"), F.col("d")), h="http://a.org", d="click") is False
    o = {(r["type"], r["value"]) for r in facts.text_observables(spark.createDataFrame([(1, "A@b.cc 192.0.2.1. 10.0.0.1 300.1.1.1")], "k long, t string"), ["k"], "t").collect()}
    assert o == {("email", "a@b.cc"), ("ip", "192.0.2.1")}
    c = spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":1,"y":2}'), ("c", "[]"), ("d", "{}"), ("e", None)], "k string, j string")
    bad = {r["k"]: (r["extra"], r["missing"], r["broken"]) for r in facts.closed_keys(c, "k", "j", ["x"], ["x"]).collect()}
    assert bad["b"] == ("y", "", False) and bad["c"][2] and bad["d"] == ("", "x", False) and "e" not in bad and "a" not in bad
    l = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v long")
    r = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4)], "k string, v long")
    assert {(x["k"], x["change"]) for x in facts.table_diff(l, r, "k", "v").collect()} == {("b", "changed"), ("d", "added")}
    hops = spark.sql("select array(named_struct('from','a','to','b'), named_struct('from','b','to','c'), named_struct('from','c','to','a'), named_struct('from','c','to','d')) h")
    assert hops.select(facts.chain_walk(F.col("h"), F.lit("a")).alias("x")).first()["x"] == ["a", "b", "c", "d"]


def test_payloads(spark):
    body = '{"data":{"attributes":{"last_analysis_stats":{"malicious":2,"harmless":5,"odd":1},"url":"http://x.org"}}}'
    df = spark.createDataFrame([(1, body), (2, "broken")], "k long, b string")
    got = {(r["k"], r["predicate"]): r["value"] for r in payloads.engine_verdicts(df, ["k"], "b").collect()}
    assert got[(1, "engine_malicious")] == "2" and got[(1, "engine_total")] == "8" and not any(k == 2 for k, _ in got)
    codes = spark.createDataFrame([("reputation", 404), ("sandbox", 404), ("graph", 404), ("graph", 503), ("graph", 200)], "k string, c int")
    assert [r["s"] for r in codes.select(payloads.http_status(F.col("k"), F.col("c")).alias("s")).collect()] == ["not_found", "pending", "api_error", "server_error", "ok"]
    reg = '{"events":[{"eventAction":"registration","eventDate":"2001"},{"eventAction":"registration","eventDate":"2002"}],"nameservers":[{"ldhName":"NS1"}],"status":["ok"],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["fn",{},"text","Reg Co"]]]}]}'
    f = {r["predicate"]: r["value"] for r in payloads.registration_facts(spark.createDataFrame([(1, reg)], "k long, b string"), ["k"], "b").collect()}
    assert f == {"registered": "2001", "name_servers": "ns1", "statuses": "ok", "registrar": "Reg Co"}
    dns = spark.createDataFrame([(1, "A", i, f"192.0.2.{i}") for i in range(12)] + [(1, "TXT", 0, "x" * 600), (1, "PTR", 0, "y")], "k long, t string, p long, v string")
    d = payloads.dns_facts(dns, ["k"], "t", "p", "v").groupBy("predicate").count().collect()
    assert {r["predicate"]: r["count"] for r in d} == {"dns_a": 10, "dns_txt_omitted": 1}
    g = '{"data":{"observables":{"edges":[{"node":{"id":"n0","observable_value":"other"}},{"node":{"id":"n1","observable_value":"EVIL.org","x_score":80,"labels":["b","a"]}}]}}}'
    m = payloads.graph_matches(spark.createDataFrame([(1, g)], "k long, b string"), ["k"], F.lit("evil.org"), "b").first()
    assert (m["node_id"], m["score"], m["labels"]) == ("n1", 80, "a,b")
    dom = payloads.dom_facts(spark.createDataFrame([(1, "<title>T</title><script>no</script><p>yes<input type=password name=p>"), (2, None)], "k long, h string"), "k", "h").orderBy("k").collect()
    assert (dom[0]["title"], dom[0]["visible_text"], dom[0]["form_fields"]) == ("T", "yes", ["password:p"]) and dom[1]["visible_text"] == ""


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from caseloom.plans import skew

    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(900)] + [(None, -1)], "k string, v long")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.join(sizes, "k").collect()))
    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    assert sorted(map(tuple, skew.join_unique(rows, sizes, "k", "n", 900).collect())) == want
    monkeypatch.setattr(skew, "HOT_PAIRED", 5)
    small = rows.where("v < 120 and v >= 0")
    got = {(r["a"], r["b"]) for r in skew.self_pairs(small, "k", "v", 120, per_task=7).collect()}
    by = {}
    for r in small.collect():
        by.setdefault(r["k"], []).append(r["v"])
    assert got == {(a, b) for m in by.values() for a in m for b in m if a < b}
    ranks = skew.dense_rank_rows(rows.where("k is not null"), "k", F.xxhash64("v"), "r", 8).collect()
    assert all(sorted(x["r"] for x in ranks if x["k"] == k) == list(range(sum(x["k"] == k for x in ranks))) for k in ("hot", "k1"))


def test_json_checks(spark):
    from caseloom.operators.jsonchecks import forbidden_keys, schema_violations

    df = spark.createDataFrame([(1, '{"a":{"Secret":null},"b":[{"SECRET":1}]}'), (2, "{"), (3, None), (4, "{}")], "k long, j string")
    assert sorted((r["k"], r["problem"]) for r in forbidden_keys(df, "k", "j", ["secret"]).collect()) == [(1, "$.a.Secret"), (1, "$.b[0].SECRET"), (2, "$: does not parse")]
    schema = {
        "type": "object", "required": ["p"], "additionalProperties": False, "$defs": {"p": {"type": "number", "minimum": 0, "maximum": 1}},
        "properties": {"p": {"$ref": "#/$defs/p"}, "l": {"anyOf": [{"type": "null"}, {"enum": ["x", "y"]}]}, "a": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 1}}},
    }
    rows = [(1, '{"p":0.5,"l":null,"a":["q"]}'), (2, '{"p":2,"l":"z","a":["","b","c"],"o":1}'), (3, '{"p":true}'), (4, "[]"), (5, "{}")]
    got = {}
    for r in schema_violations(spark.createDataFrame(rows, "k long, j string"), "k", "j", schema).collect():
        got.setdefault(r["k"], []).append(r["problem"])
    assert 1 not in got and len(got[2]) == 5 and got[3] == ["$.p: is no number"] and got[4] == ["$: is no object"] and got[5] == ["$: lacks p"]


def test_streaks_over_days(spark):
    import random

    rng = random.Random(2)
    base = pd.Timestamp("2024-01-01")
    rows = [(k, i, (base + pd.Timedelta(hours=rng.randrange(24 * 9))).to_pydatetime(), rng.random() < 0.75) for k in ("a", "b") for i in range(60)]
    rows += [("c", i, (base + pd.Timedelta(days=i)).to_pydatetime(), True) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i long, ts timestamp, bad boolean")
    got = {(r["k"], r["i"]): r["streak"] for r in sequences.failure_streaks(df, "k", ["ts", "i"], F.col("bad"), "streak").collect()}
    run: dict = {}
    for k, i, _, bad in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        run[k] = run.get(k, 0) + 1 if bad else 0
        assert got[(k, i)] == run[k]


def test_sliding_over_spans(spark):
    import random

    rng = random.Random(4)
    base = pd.Timestamp("2024-01-01")
    secs = [rng.randrange(4000) for _ in range(200)]
    df = spark.createDataFrame([("a", i, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for i, s in enumerate(secs)], "k string, i long, ts timestamp")
    for span in (300, 10_000):
        got = {r["i"]: r["n"] for r in sequences.sliding_count(df, "k", "ts", 300, "n", span).collect()}
        assert got == {i: sum(s - 300 < x <= s for x in secs) for i, s in enumerate(secs)}
    e = sequences.elapsed_ms(df.unionByName(df.limit(1).withColumn("k", F.lit(None).cast("string"))), "k", "ts", "ms").where("k is not null").collect()
    assert {r["i"]: r["ms"] for r in e} == {i: (s - min(secs)) * 1000.0 for i, s in enumerate(secs)}


def test_ordinals(spark):
    df = spark.createDataFrame([(g, i) for i in range(40) for g in ("a", "b")], "g string, i long")
    got = {(r["g"], r["i"]): r["o"] for r in keyed.ordinals(df.repartition(5), "g", ["i"], "o").collect()}
    assert got == {(g, i): f"{g}_{i + 1:05d}" for i in range(40) for g in ("a", "b")}
