"""Raw messages: written from the tables' rows, parsed back, and compared with them by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import mime
from caseloom.queries.base import t

Q = {}


def _raw(s, d):
    """One multipart message an e-mail: its headers and, part by part, its texts (base64 of UTF-8).

    A message's parts are gathered in one row, as in any message; a third of all parts in
    one message would be a message of that size.
    """
    mails = t(s, d, "parsed_emails").select("email_id", "subject", "from_addresses", "message_id").dropDuplicates(["email_id"])
    parts = t(s, d, "text_parts").where("email_id is not null and text is not null and mime_type is not null").select("email_id", "part_key", "mime_type", "text").distinct()
    body = F.concat(
        F.lit("--edge\r\nContent-Type: "), F.col("mime_type"), F.lit("; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode("text", "UTF-8")), F.lit("\r\n")
    )
    inner = parts.groupBy("email_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_key", body.alias("b")))), lambda x: x["b"]), "").alias("parts"))
    word = F.concat(F.lit("=?utf-8?b?"), F.regexp_replace(F.base64(F.encode(F.coalesce("subject", F.lit("")), "UTF-8")), "\\s", ""), F.lit("?="))
    head = F.concat(
        F.lit("From: desk@relay.example\r\nReceived: from relay ([203.0.113."), (F.col("email_id") % 250).cast("string"), F.lit("]) by inner (10.0.0.1)\r\nAuthentication-Results: mx; spf=pass smtp.mailfrom=m"),
        (F.col("email_id") % 7).cast("string"), F.lit(".example; dkim=fail smtp.mailfrom=other.example\r\nSubject: "), word,
        F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=edge\r\n\r\n"),
    )
    file = F.concat(F.lit("--edge\r\nContent-Type: application/octet-stream; name=id.bin\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode(F.col("email_id").cast("string"), "UTF-8")), F.lit("\r\n--edge--\r\n"))
    whole = F.concat(head, F.coalesce("parts", F.lit("")), file)
    return mails.where("email_id is not null").join(inner, "email_id", "left").select("email_id", F.encode(whole, "UTF-8").alias("content"))


def _parsed(s, d):
    return mime.parse_messages(_raw(s, d), "content")


_MAILS = "m AS (SELECT DISTINCT email_id FROM parsed_emails WHERE email_id IS NOT NULL)"
_ORDER = """o AS (SELECT email_id, mime_type, text, row_number() OVER (PARTITION BY email_id ORDER BY part_key) AS r
   FROM (SELECT DISTINCT email_id, part_key, mime_type, text FROM text_parts WHERE text IS NOT NULL AND mime_type IS NOT NULL) JOIN m USING (email_id))"""


def message_parts(s, d):
    """Text parts of the parsed messages: number, type, length and print of the text."""
    p = _parsed(s, d).select("email_id", F.explode("message.parts").alias("p"))
    return p.select("email_id", "p.part_id", "p.mime_type", F.length("p.text").cast("long").alias("chars"), F.sha2("p.text", 256).alias("print"))


Q["message_parts"] = (message_parts, f"""WITH {_MAILS}, {_ORDER}
  SELECT email_id, 'part_' || lpad((r + 1)::VARCHAR, 4, '0') AS part_id, mime_type, length(text) AS chars, sha256(text) AS print FROM o""")


def message_attachments(s, d):
    a = _parsed(s, d).select("email_id", F.explode("message.attachments").alias("a"))
    return a.select("email_id", "a.part_id", "a.filename", "a.size", "a.sha256", "a.md5")


Q["message_attachments"] = (message_attachments, f"""WITH {_MAILS}, {_ORDER}
  SELECT email_id, 'part_' || lpad((coalesce(max(r), 0) + 2)::VARCHAR, 4, '0') AS part_id, 'id.bin' AS filename, length(email_id::VARCHAR) AS size, sha256(email_id::VARCHAR) AS sha256, md5(email_id::VARCHAR) AS md5
  FROM m LEFT JOIN o USING (email_id) GROUP BY email_id""")


def message_auth(s, d):
    a = _parsed(s, d).select("email_id", F.explode("message.authentication").alias("a"))
    return a.select("email_id", "a.mechanism", "a.result", "a.identity")


Q["message_auth"] = (message_auth, f"""WITH {_MAILS} SELECT email_id, 'spf' AS mechanism, 'pass' AS result, 'm' || (email_id % 7) || '.example' AS identity FROM m
  UNION ALL SELECT email_id, 'dkim', 'fail', NULL FROM m""")


def message_ips(s, d):
    return _parsed(s, d).select("email_id", F.explode("message.transport_ips").alias("ip"))


Q["message_ips"] = (message_ips, f"WITH {_MAILS} SELECT email_id, '203.0.113.' || (email_id % 250) AS ip FROM m")


def message_flags(s, d):
    f = mime.message_flags(_parsed(s, d))
    return f.select("email_id", "has_text", "has_html", "has_received", "has_authentication_results", "has_attachments", "has_images", "header_integrity", "attachment_representation")


Q["message_flags"] = (message_flags, f"""WITH {_MAILS}, {_ORDER}
  SELECT email_id, coalesce(bool_or(mime_type = 'text/plain' AND regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')), false) AS has_text, coalesce(bool_or(mime_type = 'text/html' AND regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')), false) AS has_html,
   true AS has_received, true AS has_authentication_results, true AS has_attachments, false AS has_images, 'partial' AS header_integrity, 'bytes' AS attachment_representation
  FROM m LEFT JOIN o USING (email_id) GROUP BY email_id""")
