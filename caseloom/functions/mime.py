"""Raw messages to nested rows: one Arrow function per batch, the standard library's parser inside.

The parser itself is tolerant; this module adds bounds (depth, parts, attachments,
decoded bytes), per-part defects, and never raises: what cannot be read becomes a row
with a ``failure`` and nulls.
"""

from __future__ import annotations

import base64
import binascii
import email
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from email.header import decode_header
from email.message import Message
from email.utils import getaddresses

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of one message.
LIMITS = {"bytes": 26_214_400, "depth": 20, "parts": 200, "attachments": 20, "part_bytes": 20_971_520, "all_bytes": 41_943_040, "embedded_images": 64}
_ADDRESS_FIELDS = (("from", "from_addresses"), ("to", "to_addresses"), ("cc", "cc_addresses"), ("reply-to", "reply_to"), ("return-path", "return_path"))

_HEADER = pa.struct([("index", pa.int32()), ("name", pa.string()), ("raw_value", pa.string()), ("decoded_value", pa.string())])
_PART = pa.struct([("part_id", pa.string()), ("mime_type", pa.string()), ("charset", pa.string()), ("text", pa.string()), ("defects", pa.list_(pa.string()))])
_ATTACHMENT = pa.struct(
    [("part_id", pa.string()), ("filename", pa.string()), ("mime_type", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("sha1", pa.string()), ("md5", pa.string())]
)
_IMAGE = pa.struct([("part_id", pa.string()), ("mime_type", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("embedded", pa.bool_())])
_AUTH = pa.struct([("header_index", pa.int32()), ("mechanism", pa.string()), ("result", pa.string()), ("identity", pa.string())])
MESSAGE = pa.struct(
    [("failure", pa.string()), ("subject", pa.string()), ("date_raw", pa.string()), ("message_id", pa.string())]
    + [(c, pa.list_(pa.string())) for _, c in _ADDRESS_FIELDS]
    + [("headers", pa.list_(_HEADER)), ("parts", pa.list_(_PART)), ("attachments", pa.list_(_ATTACHMENT)), ("images", pa.list_(_IMAGE)), ("authentication", pa.list_(_AUTH)),
       ("transport_ips", pa.list_(pa.string())), ("defects", pa.list_(pa.string())), ("content_limits", pa.list_(pa.string()))]
)
_DDL = (
    "struct<failure:string,subject:string,date_raw:string,message_id:string,from_addresses:array<string>,to_addresses:array<string>,"
    "cc_addresses:array<string>,reply_to:array<string>,return_path:array<string>,"
    "headers:array<struct<index:int,name:string,raw_value:string,decoded_value:string>>,"
    "parts:array<struct<part_id:string,mime_type:string,charset:string,text:string,defects:array<string>>>,"
    "attachments:array<struct<part_id:string,filename:string,mime_type:string,size:bigint,sha256:string,sha1:string,md5:string>>,"
    "images:array<struct<part_id:string,mime_type:string,size:bigint,sha256:string,embedded:boolean>>,"
    "authentication:array<struct<header_index:int,mechanism:string,result:string,identity:string>>,"
    "transport_ips:array<string>,defects:array<string>,content_limits:array<string>>"
)


def decoded_header(raw: str) -> str:
    """Encoded words decoded; the raw value where that fails."""
    try:
        return "".join(x.decode(c or "ascii", "replace") if isinstance(x, bytes) else x for x, c in decode_header(raw))
    except (LookupError, ValueError, binascii.Error):
        return raw


def without_comments(value: str) -> str:
    """A structured header without its parenthesised comments, nested ones too."""
    out, depth, quoted = [], 0, False
    for ch in value:
        if ch == '"' and not depth:
            quoted = not quoted
        if not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")" and depth:
            depth -= 1
            continue
        if not depth:
            out.append(ch)
    return "".join(out)


_RESULT = re.compile(r"\b(spf|dkim|dmarc)\s*=\s*([a-z]+)", re.I)
#: The property of each mechanism that names who was checked, by preference.
_WHO = {"spf": ("smtp.mailfrom", "smtp.helo"), "dkim": ("header.d",), "dmarc": ("header.from",)}
_PROPERTY = re.compile(r"([a-z]+\.[a-z]+)\s*=\s*([^\s;]+)", re.I)


def authentication_results(index: int, value: str) -> list[dict]:
    """The first result of each mechanism of one header, with the identity its own clause names by its own property."""
    out: dict[str, dict] = {}
    for clause in without_comments(value).split(";"):
        m = _RESULT.search(clause)
        if not m or m[1].lower() in out:
            continue
        name, said = m[1].lower(), {}
        for p in _PROPERTY.finditer(clause, m.end()):
            said.setdefault(p[1].lower(), p[2].strip("<>").lstrip("@").lower())
        who = next((said[p] for p in _WHO[name] if said.get(p)), None)
        out[name] = {"header_index": index, "mechanism": name, "result": m[2].lower(), "identity": who}
    return list(out.values())


_IP = re.compile(r"(?<![\w.:])((?:\d{1,3}\.){3}\d{1,3}|(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})(?![\w:])")
#: The networks reserved for documentation.
_DOCUMENTATION = [ipaddress.ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32")]


def transport_addresses(values: list[str]) -> list[str]:
    """Public and documentation addresses of transport headers, each once, in order."""
    out: dict[str, None] = {}
    for v in values:
        for m in _IP.finditer(v):
            try:
                ip = ipaddress.ip_address(m[1])
            except ValueError:
                continue
            if ip.is_global or any(ip in n for n in _DOCUMENTATION if n.version == ip.version):
                out.setdefault(str(ip))
    return list(out)


_SRC = re.compile(r"<img\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bsrc\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_DATA = re.compile(r"data:image/(png|jpe?g);base64,(.*)$", re.I | re.S)


class _Walk:
    """Visits the parts of a message in order; every node, containers too, has the next number.

    A limit that is passed ends the walk and is recorded.  Leaves: attachments (by
    disposition, or with a name unless images), images (kept as metadata), plain and HTML
    text; any other leaf and any message within the message leaves a defect.
    """

    def __init__(self) -> None:
        self.parts: list[dict] = []
        self.attachments: list[dict] = []
        self.images: list[dict] = []
        self.limits: list[str] = []
        self.defects: list[str] = []
        self.bytes = 0

    def run(self, root: Message) -> None:
        waiting, no = [(root, 0)], 0
        while waiting and not self.limits:
            m, depth = waiting.pop()
            no += 1
            if depth > LIMITS["depth"] or no > LIMITS["parts"]:
                self.limits.append("depth" if depth > LIMITS["depth"] else "parts")
                break
            pid = f"part_{no:04d}"
            self.defects += [f"{pid}: {type(d).__name__}" for d in m.defects]
            inner = m.get_payload() if m.is_multipart() else None
            if m.get_content_type() == "message/rfc822":
                self.defects.append(f"{pid}: embedded message")
                inner = inner[:1] if inner else []
            if inner is None:
                self.leaf(m, pid)
            else:
                waiting += [(child, depth + 1) for child in reversed(inner)]

    def leaf(self, m: Message, pid: str) -> None:
        kind, name = m.get_content_type(), m.get_filename()
        image = kind.startswith("image/")
        attached = m.get_content_disposition() == "attachment" or name is not None and not image
        if not attached and not image and kind not in ("text/plain", "text/html"):
            self.defects.append(f"{pid}: unread leaf {kind}")
            return
        faults: list[str] = []
        data = m.get_payload(decode=True)
        if str(m.get("content-transfer-encoding", "")).strip().lower() == "base64":
            try:
                base64.b64decode(re.sub(r"\s", "", str(m.get_payload())), validate=True)
            except (binascii.Error, ValueError) as e:
                faults.append(f"{pid}: transfer decode error: {e}")
        if data is None:
            data = b""
            faults.append(f"{pid}: payload not decodable")
        size = len(data)
        over = "part_bytes" if size > LIMITS["part_bytes"] else "all_bytes" if self.bytes + size > LIMITS["all_bytes"] else None
        if over:  # what is over a limit is never kept
            self.defects += [*faults, f"{pid}: over {over}"]
            if over == "all_bytes":
                self.limits.append(over)
            return
        self.bytes += size
        if attached:
            self.defects += faults
            self.attach(pid, name, kind, data, not faults)
            if len(self.attachments) >= LIMITS["attachments"]:
                self.limits.append("attachments")
        elif image:
            self.defects += faults
            self.image(pid, kind, data, False)
        else:
            self.text(m, pid, kind, data, faults)

    def image(self, pid: str, kind: str, data: bytes, embedded: bool) -> None:
        self.images.append({"part_id": pid, "mime_type": kind, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "embedded": embedded})

    def attach(self, pid: str, name: str | None, kind: str, data: bytes, whole: bool) -> None:
        h = lambda a: hashlib.new(a, data).hexdigest() if whole else None
        self.attachments.append(
            {"part_id": pid, "filename": decoded_header(name) if name else None, "mime_type": kind, "size": len(data), "sha256": h("sha256"), "sha1": h("sha1"), "md5": h("md5")}
        )

    def text(self, m: Message, pid: str, kind: str, data: bytes, defects: list[str]) -> None:
        charset = m.get_content_charset()
        try:
            text = data.decode(charset or "utf-8")
        except (LookupError, UnicodeError) as e:
            defects.append(f"{pid}: charset error ({charset!r}): {e}")
            text = data.decode("utf-8", "replace")
        if kind == "text/html":
            text = self.pictures(text, pid)
        self.parts.append({"part_id": pid, "mime_type": kind, "charset": charset, "text": text, "defects": defects})

    def pictures(self, text: str, pid: str) -> str:
        """Images written into HTML become rows of their own, up to a bound; a placeholder stays in the text."""

        def one(m: re.Match) -> str:
            d = _DATA.match(m[1].strip("\"'"))
            if not d:
                return m[0]
            try:
                data = base64.b64decode(re.sub(r"\s", "", d[2]), validate=True)
            except (binascii.Error, ValueError):
                return m[0].replace(m[1], '"[embedded-image:broken]"')
            seen = sum(i["embedded"] for i in self.images)
            if seen >= LIMITS["embedded_images"] or self.bytes + len(data) > LIMITS["all_bytes"]:
                self.defects.append(f"{pid}: embedded image over a limit")
                return m[0].replace(m[1], '"[embedded-image:omitted]"')
            self.bytes += len(data)
            eid = f"{pid}_img_{seen + 1:02d}"
            self.image(eid, f"image/{d[1].lower()}", data, True)
            return m[0].replace(m[1], f'"[embedded-image:{eid}]"')

        return _SRC.sub(one, text)


def parse_message(data: bytes | None) -> dict:
    """One raw message as a nested row; never raises."""
    if data is None or len(data) == 0:
        return {"failure": "empty"}
    if len(data) > LIMITS["bytes"]:
        return {"failure": "oversize"}
    try:
        m = email.message_from_bytes(data)
        headers = [
            {"index": i, "name": k, "raw_value": str(v), "decoded_value": decoded_header(str(v))} for i, (k, v) in enumerate(m.raw_items())
        ]
        if not headers:
            return {"failure": "no headers"}
        named = lambda n: [h for h in headers if h["name"].lower() == n]
        first = lambda n: next((h["decoded_value"] for h in named(n)), None)
        w = _Walk()
        w.run(m)
        row: dict = {"failure": None, "subject": first("subject"), "date_raw": first("date"), "message_id": first("message-id")}
        for n, c in _ADDRESS_FIELDS:
            row[c] = [a for _, a in getaddresses([h["decoded_value"] for h in named(n)]) if a]
        counts = {n: len(named(n)) for n in ("from", "to", "subject", "date", "message-id")}
        repeated = [f"duplicate header: {n}" for n, k in counts.items() if k > 1]
        row |= {
            "headers": headers, "parts": w.parts, "attachments": w.attachments, "images": w.images, "content_limits": w.limits,
            "authentication": [a for h in named("authentication-results") for a in authentication_results(h["index"], h["raw_value"])],
            "transport_ips": transport_addresses([h["raw_value"] for h in named("received")]),
            "defects": w.defects + repeated,
        }
        return row
    except Exception as e:  # noqa: BLE001 - any broken message is a row, not an end of the job
        return {"failure": f"{type(e).__name__}: {e}"[:200]}


def parse_messages(raw: DataFrame, content: str) -> DataFrame:
    """``raw`` with a column ``message`` (nested row) in place of the bytes; rows are kept.

    Sort or repartition beforehand if single files are large: a batch holds its messages' bytes.
    """
    keep = [c for c in raw.columns if c != content]
    kinds = {f.name: f.dataType.simpleString() for f in raw.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_message(x) for x in b.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, MESSAGE)], names=[*keep, "message"])

    return raw.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"message {_DDL}"]))


def message_flags(parsed: DataFrame) -> DataFrame:
    """Presence flags of a parsed message: parts, links, attachments, headers, authentication."""
    m = F.col("message")
    has = lambda n: F.exists(m["headers"], lambda h: (F.lower(F.trim(h["name"])) == n) & (F.trim(h["decoded_value"]) != ""))
    kind = lambda t: F.exists(m["parts"], lambda p: (p["mime_type"] == t) & p["text"].rlike("\\S"))
    needed = ("from", "to", "date", "subject", "message-id", "received", "authentication-results")
    full = has(needed[0])
    for n in needed[1:]:
        full = full & has(n)
    plain = F.array_join(F.transform(F.filter(m["parts"], lambda p: p["mime_type"] == "text/plain"), lambda p: p["text"]), "")
    pictures = (F.size(m["images"]) > 0) | F.exists(m["attachments"], lambda a: a["mime_type"].startswith("image/"))
    return parsed.withColumns({
        "has_text": kind("text/plain"), "has_html": kind("text/html"), "has_received": has("received"),
        "has_authentication_results": has("authentication-results"), "has_full_headers": full,
        "has_attachments": F.size(m["attachments"]) > 0, "has_images": pictures,
        "header_integrity": F.when(full, "full").when(F.size(m["headers"]) > 0, "partial").otherwise("none"),
        "attachment_representation": F.when(F.exists(m["attachments"], lambda a: a["sha256"].isNotNull()), "bytes")
        .when(F.exists(m["attachments"], lambda a: a["filename"].isNotNull()), "filename").otherwise("absent"),
        "essential_visual_content": pictures & (F.length(F.regexp_replace(plain, r"^\s+|\s+$", "")) < 80),
    })
