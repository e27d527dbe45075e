import io
import json
import tarfile

import pytest
from caseloom.functions import mime
from caseloom.sources import messages, sinks, tables
from pyspark.sql import types as T

PNG = "iVBORw0KGgo="
RAW = (
    "Received: from a ([203.0.113.9]) by b (10.0.0.1)\r\nAuthentication-Results: mx; spf=pass (ok; fine) smtp.mailfrom=a.test; dkim=fail header.d=b.test; spf=fail\r\n"
    "From: =?utf-8?q?Andr=C3=A9?= <a@a.test>\r\nTo: b@b.test, C <c@c.test>\r\nSubject: =?utf-8?b?w4k=?=\r\nDate: Tue, 02 Jan 2024 02:56:51 +0000\r\nMessage-ID: <1@a.test>\r\n"
    'MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="x"\r\n\r\n--x\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ncaf=E9\r\n'
    f'--x\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<img src="data:image/png;base64,{PNG}">\r\n'
    '--x\r\nContent-Type: application/pdf; name="f.pdf"\r\nContent-Transfer-Encoding: base64\r\n\r\naGVsbG8=\r\n--x\r\nContent-Type: text/plain; charset=x-unknown\r\n\r\nz\r\n--x--\r\n'
).encode()


def test_message():
    m = mime.parse_message(RAW)
    assert m["failure"] is None and m["subject"] == "É" and m["from_addresses"] == ["a@a.test"] and m["to_addresses"] == ["b@b.test", "c@c.test"]
    assert [p["text"].strip() for p in m["parts"]][0] == "café" and "[embedded-image:" in m["parts"][1]["text"] and m["parts"][2]["defects"]
    assert [(a["part_id"], a["filename"], a["size"]) for a in m["attachments"]] == [("part_0004", "f.pdf", 5)]
    assert [(i["part_id"], i["size"], i["embedded"]) for i in m["images"]] == [("part_0003_img_01", 8, True)]
    assert m["attachments"][0]["sha256"].startswith("2cf24dba") and [p["part_id"] for p in m["parts"]] == ["part_0002", "part_0003", "part_0005"]
    assert [(a["mechanism"], a["result"], a["identity"]) for a in m["authentication"]] == [("spf", "pass", "a.test"), ("dkim", "fail", "b.test")]
    assert m["transport_ips"] == ["203.0.113.9"]


@pytest.mark.parametrize("raw,failure", [(None, "empty"), (b"", "empty"), (b"\xff\xfe\x00", "no headers")])
def test_broken_messages_are_rows(raw, failure):
    assert mime.parse_message(raw)["failure"] == failure


def test_bounds():
    parts = "".join("--x\r\nContent-Type: application/pdf; name=f.pdf\r\n\r\nq\r\n" for _ in range(30))
    m = mime.parse_message(f'From: a@b.c\r\nContent-Type: multipart/mixed; boundary="x"\r\n\r\n{parts}--x--'.encode())
    assert len(m["attachments"]) == 20 and m["content_limits"] == ["attachments"]
    bad = mime.parse_message(b"From: a@b.c\r\nContent-Type: application/pdf; name=f.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\n!!!")
    assert bad["attachments"][0]["sha256"] is None


def _mail(body: str, kind: str) -> dict:
    return mime.parse_message(f"From: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: {kind}\r\n\r\n{body}".encode())


def test_containers_are_numbered_too():
    inner = '--y\r\nContent-Type: text/plain\r\n\r\na\r\n--y\r\nContent-Type: text/html\r\n\r\n<p>b\r\n--y--\r\n'
    m = _mail(f'--x\r\nContent-Type: multipart/alternative; boundary="y"\r\n\r\n{inner}--x--', 'multipart/mixed; boundary="x"')
    assert [p["part_id"] for p in m["parts"]] == ["part_0003", "part_0004"]


def test_depth_ends_the_walk():
    body = "Content-Type: text/plain\r\n\r\ndeep\r\n"
    for i in range(25):
        body = f'Content-Type: multipart/mixed; boundary="b{i}"\r\n\r\n--b{i}\r\n{body}\r\n--b{i}--\r\n'
    m = mime.parse_message(f'From: a@b.c\r\nContent-Type: multipart/mixed; boundary="t"\r\n\r\n--t\r\n{body}--t\r\nContent-Type: text/plain\r\n\r\nafter\r\n--t--'.encode())
    assert m["content_limits"] == ["depth"] and m["parts"] == []


def test_leaves():
    parts = ("text/calendar", "x"), ("image/png", "x"), ("text/plain", "words"), ("message/rfc822", "From: z@z.z\r\n\r\ninner")
    body = "".join(f"--x\r\nContent-Type: {k}\r\n\r\n{b}\r\n" for k, b in parts)
    m = _mail(body + "--x--", 'multipart/mixed; boundary="x"')
    assert m["attachments"] == [] and [i["part_id"] for i in m["images"]] == ["part_0003"] and [p["part_id"] for p in m["parts"]] == ["part_0004", "part_0006"]
    assert "part_0002: unread leaf text/calendar" in m["defects"] and "part_0005: embedded message" in m["defects"]


@pytest.mark.parametrize(
    "value,want",
    [
        ("mx; dkim=pass smtp.mailfrom=evil.example", [("dkim", "pass", None)]), ("mx; dkim=pass header.i=@a.test header.d=B.test", [("dkim", "pass", "b.test")]),
        ("mx; spf=pass smtp.helo=h.test smtp.mailfrom=<@m.test>; dmarc=fail header.from=f.test", [("spf", "pass", "m.test"), ("dmarc", "fail", "f.test")]),
        ("mx; (spf=fail smtp.mailfrom=x) none", []), ("spf=neutral", [("spf", "neutral", None)]),
    ],
)
def test_identity_belongs_to_its_mechanism(value, want):
    assert [(a["mechanism"], a["result"], a["identity"]) for a in mime.authentication_results(0, value)] == want


def test_nested_comments():
    assert mime.without_comments('a (b (c) d) e "(kept)"') == 'a  e "(kept)"'


def test_parsed_table(spark):
    df = spark.createDataFrame([(1, bytearray(RAW)), (2, None)], "id long, content binary")
    rows = {r["id"]: r for r in mime.message_flags(mime.parse_messages(df, "content")).collect()}
    assert rows[1]["has_text"] and rows[1]["has_full_headers"] and rows[1]["has_images"] and rows[1]["attachment_representation"] == "bytes" and rows[1]["essential_visual_content"]
    assert rows[2]["message"]["failure"] == "empty"


def test_archives(spark, tmp_path):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:bz2") as t:
        for name in ("b.eml", "a.eml", "../up.eml", "skip.eml"):
            i = tarfile.TarInfo(name)
            i.size = 3
            t.addfile(i, io.BytesIO(b"abc"))
    (tmp_path / "s.tar.bz2").write_bytes(buf.getvalue())
    (tmp_path / "m.mbox").write_bytes(b"From x\nA: 1\n\nbody\nFrom inside\n\nFrom y\nB: 2\n")
    (tmp_path / "bad.tar").write_bytes(b"no tar")
    reg = tmp_path / "sources.json"
    entries = [
        {"id": "t", "kind": "tar.bz2", "path": str(tmp_path / "s.tar.bz2"), "status": "acquired", "exclude_members": ["skip.eml"]},
        {"id": "m", "kind": "mbox", "path": str(tmp_path / "m.mbox"), "status": "acquired"},
        {"id": "x", "kind": "tar", "path": str(tmp_path / "bad.tar"), "status": "acquired"},
        {"id": "n", "kind": "mbox", "path": "nowhere", "status": "planned"},
    ]
    reg.write_text(json.dumps({"sources": entries}))
    got = messages.archive_messages(spark, messages.registry(spark, str(reg))).collect()
    by = {(r["source_id"], r["member"]): r for r in got}
    assert by[("t", "../up.eml")]["error"] == "unsafe name" and by[("t", "a.eml")]["ordinal"] == "t_00002" and ("t", "skip.eml") not in by
    assert bytes(by[("m", "0001")]["content"]) == b"A: 1\n\nbody\nFrom inside\n\n" and ("m", "0002") in by
    assert by[("x", None)]["error"]
    reg.write_text(json.dumps({"sources": [entries[0], entries[0]]}))
    with pytest.raises(ValueError):
        messages.registry(spark, str(reg))
    assert list(messages.mbox_messages(b"hello"))[0][2] == "no separator"


def test_eml_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.eml").write_bytes(RAW)
    (tmp_path / "b.txt").write_bytes(b"x")
    assert messages.eml_files(spark, str(tmp_path)).count() == 1


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k":"a","n":1}\n\n{"k":"b","n":1,"z":2}\n[1]\n{"k":"c"}\n{"k":"a","n":2}\n')
    good, bad = tables.strict_jsonl(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())]), "k")
    assert good.count() == 2 and sorted(r["problem"] for r in bad.collect()) == ["missing keys", "not an object", "repeated key", "unknown keys"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "token=abcdef"), ("a", None)], "k string, v string")
    for _ in range(2):
        sinks.replace_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_once(df, str(tmp_path / "once"))
    assert "[secret]" in "".join(p.read_text() for p in (tmp_path / "once").glob("*.json"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_once(df, str(tmp_path / "once"))
    sinks.sorted_jsonl(df, str(tmp_path / "j"), ["k"])
    assert spark.read.text(str(tmp_path / "j")).count() == 2
    sinks.write_index(df, str(tmp_path / "i"), "f1")
    assert tables.open_index(spark, str(tmp_path / "i"), "f1").count() == 2
    with pytest.raises(ValueError):
        tables.open_index(spark, str(tmp_path / "i"), "f2")
    with pytest.raises(ValueError):
        tables.exact_table(spark, str(tmp_path / "p"), T.StructType([T.StructField("v", T.StringType())]))
    for n, v in ((1, "x"), (2, "y")):
        (tmp_path / "runs/r1").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"runs/r1/attempt_{n}.json").write_text(json.dumps({"s": v}))
    last = tables.last_attempts(spark, str(tmp_path / "runs/*/*.json"), T.StructType([T.StructField("s", T.StringType())])).first()
    assert (last["run"], last["attempt"], last["s"]) == ("r1", 2, "y")
