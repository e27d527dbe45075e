"""Text, address and identity expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.functions import urls as u
from caseloom.queries.base import HOST, SCHEME, SQUASH, t

Q = {}


def fingerprint_docs(s, d):
    body = tx.squash(F.col("text"))
    return t(s, d, "documents").select("doc_id", tx.content_hash(body).alias("print"), tx.word_count(F.col("text")).alias("words"))


_SQ = SQUASH.format("text")
Q["fingerprint_docs"] = (fingerprint_docs, f"""
  SELECT doc_id, CASE WHEN {_SQ} = '' THEN '' ELSE sha256({_SQ}) END AS print,
         CASE WHEN {_SQ} = '' THEN 0 ELSE len(string_split({_SQ}, ' ')) END::BIGINT AS words FROM documents""")


def normalized_prints(s, d):
    p = tx.fingerprint_text_udf(F.col("text"))
    return t(s, d, "text_parts").select("part_key", tx.content_hash(p).alias("print")).distinct()


Q["normalized_prints"] = (normalized_prints, None)


def stripped_parts(s, d):
    rich = t(s, d, "text_parts").where("mime_type = 'text/html'")
    return rich.select("part_key", F.length(tx.strip_tags(F.col("text"))).cast("long").alias("chars"), F.sha2(tx.strip_tags(F.col("text")), 256).alias("print"))


Q["stripped_parts"] = (stripped_parts, """
  SELECT part_key, length(regexp_replace(text, '<[^>]+>', ' ', 'g'))::BIGINT AS chars,
         sha256(regexp_replace(text, '<[^>]+>', ' ', 'g')) AS print FROM text_parts WHERE mime_type = 'text/html'""")


def message_bodies(s, d):
    """Body chosen per message: its plain parts, else its stripped HTML parts (parts in order of their key)."""
    parts = t(s, d, "text_parts").select("part_key", "email_id", "mime_type", "text").distinct()
    pick = lambda m: F.transform(F.array_sort(F.collect_list(F.when(F.col("mime_type") == m, F.struct("part_key", "text")))), lambda x: F.coalesce(x["text"], F.lit("")))
    by = parts.groupBy("email_id").agg(pick("text/plain").alias("p"), pick("text/html").alias("h"))
    body = tx.squash(tx.choose_body(F.col("p"), F.col("h")))
    return by.select("email_id", tx.content_hash(body).alias("body_print"), tx.word_count(body).alias("words"))


_J = SQUASH.format("CASE WHEN len(list_filter(p, lambda x: trim(x) <> '')) > 0 THEN array_to_string(list_filter(p, lambda x: trim(x) <> ''), chr(10)) ELSE array_to_string(list_transform(list_filter(h, lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '<[^>]+>', ' ', 'g')), chr(10)) END")
Q["message_bodies"] = (message_bodies, f"""
  WITH d AS (SELECT DISTINCT part_key, email_id, mime_type, text FROM text_parts),
  g AS (SELECT email_id,
      coalesce(list(coalesce(text, '') ORDER BY part_key) FILTER (WHERE mime_type = 'text/plain'), []) AS p,
      coalesce(list(coalesce(text, '') ORDER BY part_key) FILTER (WHERE mime_type = 'text/html'), []) AS h FROM d GROUP BY email_id),
  b AS (SELECT email_id, {_J} AS body FROM g)
  SELECT email_id, CASE WHEN body = '' THEN '' ELSE sha256(body) END AS body_print,
         CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END::BIGINT AS words FROM b""")


def link_addresses(s, d):
    raw = F.col("raw_value")
    return t(s, d, "links").select(
        "link_id", u.scheme(raw).alias("scheme"), u.http_host(raw).alias("host"), u.port(raw).cast("long").alias("port"), u.normalize_url(raw).alias("normalized")
    )


_PORT = "coalesce(nullif(regexp_extract(raw_value, '^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]+:([0-9]{1,5})(?:[/?#]|$)', 1), '')::BIGINT, CASE sch WHEN 'https' THEN 443 WHEN 'http' THEN 80 END)"
Q["link_addresses"] = (link_addresses, f"""
  WITH a AS (SELECT link_id, raw_value, {SCHEME.format('raw_value')} AS sch, {HOST.format('raw_value')} AS h FROM links),
  b AS (SELECT *, {_PORT} AS p, regexp_extract(raw_value, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS rest FROM a)
  SELECT link_id, sch AS scheme, h AS host, p AS port,
    CASE WHEN h IS NOT NULL THEN sch || '://' || h || CASE WHEN (sch = 'http' AND p = 80) OR (sch = 'https' AND p = 443) THEN '' ELSE ':' || p::VARCHAR END || rest END AS normalized FROM b""")


def host_counts(s, d):
    links = t(s, d, "links").select("link_id", u.registrable_domain(u.http_host(F.col("raw_value"))).alias("domain")).distinct()
    return links.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_SUFFIX = "('co.uk','org.uk','ac.uk','gov.uk','com.au','co.jp','co.nz','com.br','co.in','com.mx')"
Q["host_counts"] = (host_counts, f"""
  WITH a AS (SELECT DISTINCT link_id, {HOST.format('raw_value')} AS h FROM links),
  b AS (SELECT link_id, h, string_split(h, '.') AS l FROM a)
  SELECT CASE WHEN regexp_matches(h, '^[0-9]+([.][0-9]+){{3}}$') OR len(l) < 2 THEN h
    WHEN array_to_string(l[-2:], '.') IN {_SUFFIX} AND len(l) > 2 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
    count(*) AS n FROM b GROUP BY 1""")


def send_refusals(s, d):
    rows = t(s, d, "links").select("link_id", u.send_refusal(F.col("raw_value")).alias("reason")).distinct()
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_RES = "('example','test','invalid','localhost','local','internal','example.com','example.org','example.net')"
Q["send_refusals"] = (send_refusals, f"""
  WITH a AS (SELECT DISTINCT link_id, raw_value AS v, {SCHEME.format('raw_value')} AS sch, {HOST.format('raw_value')} AS h FROM links),
  b AS (SELECT *, string_split(h, '.') AS l FROM a)
  SELECT CASE WHEN v IS NULL OR sch NOT IN ('http','https') THEN 'scheme'
    WHEN regexp_matches(v, '^[A-Za-z]+://[^/?#]*@') THEN 'userinfo' WHEN h IS NULL THEN 'host'
    WHEN l[-1] IN {_RES} OR array_to_string(l[-2:], '.') IN {_RES} THEN 'reserved_suffix'
    WHEN regexp_matches(h, '^[0-9]+([.][0-9]+){{3}}$') AND (l[1]::INT IN (0, 10, 127) OR l[1]::INT >= 224 OR (l[1]::INT = 169 AND l[2]::INT = 254)
      OR (l[1]::INT = 172 AND l[2]::INT BETWEEN 16 AND 31) OR (l[1]::INT = 192 AND l[2]::INT = 168) OR (l[1]::INT = 100 AND l[2]::INT BETWEEN 64 AND 127)) THEN 'not_public'
    WHEN regexp_matches(v, '(?i)[?&;](?:token|key|secret|password|auth|session|sig|code)=') THEN 'credential'
    WHEN regexp_matches(v, '[^/\\s=]+@[^/\\s&]+\\.[A-Za-z]{{2,}}|%40') THEN 'personal' END AS reason, count(*) AS n FROM b GROUP BY 1""")


def address_domains(s, d):
    mails = t(s, d, "parsed_emails").select("email_id", "to_addresses", "cc_addresses").distinct()
    e = mails.select("email_id", F.explode(F.concat(F.coalesce("to_addresses", F.array().cast("array<string>")), F.coalesce("cc_addresses", F.array().cast("array<string>")))).alias("e"))
    return e.groupBy(u.address_domain(F.col("e")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(u.addr_spec(F.col("e"))).alias("mailboxes"))


Q["address_domains"] = (address_domains, """
  WITH m AS (SELECT DISTINCT email_id, to_addresses, cc_addresses FROM parsed_emails),
  e AS (SELECT email_id, unnest(list_concat(coalesce(to_addresses, []), coalesce(cc_addresses, []))) AS e FROM m)
  SELECT CASE WHEN contains(e, '@') THEN lower(rtrim(string_split(e, '@')[-1], '.> ')) END AS domain, count(*) AS n,
    count(DISTINCT nullif(lower(regexp_extract(e, '([^\\s<>,;"''()]+@[^\\s<>,;"''()]+)', 1)), '')) AS mailboxes FROM e GROUP BY 1""")


def masked_notes(s, d):
    rows = t(s, d, "corpus_manifest").select("sample_id", tx.merge_notes(F.col("transformation_notes"), F.col("notes")).alias("n")).distinct()
    return rows.select("sample_id", tx.first_words(tx.mask_secrets(F.col("n")), 12).alias("note"), tx.escaped_excerpt(F.col("n"), 80).alias("excerpt"))


Q["masked_notes"] = (masked_notes, r"""
  WITH a AS (SELECT DISTINCT sample_id, concat_ws('; ', nullif(transformation_notes, ''), nullif(notes, '')) AS n FROM corpus_manifest),
  m AS (SELECT sample_id, n, regexp_replace(regexp_replace(regexp_replace(n, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}', '\1[secret]', 'g'),
     '(?i)((?:api[_-]?key|token|password|passwd|secret)\s*[=:]\s*)[^\s&;,"'']+', '\1[secret]', 'g'), '(https?://)[^/@\s:]+:[^/@\s]+@', '\1[secret]@', 'g') AS k FROM a)
  SELECT sample_id, array_to_string(regexp_split_to_array(trim(k), ' +')[1:12], ' ') AS note,
    replace(replace(replace(replace(n[1:80], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS excerpt FROM m""")


def date_styles(s, d):
    """How many raw dates parse, and how many agree with the recorded time to the second."""
    m = t(s, d, "parsed_emails").select("email_id", "date_raw", "sent_at").distinct()
    when = tx.http_date(F.col("date_raw"))
    return m.agg(
        F.count(F.lit(1)).alias("n"), F.count("date_raw").alias("dated"), F.count_if(when.isNotNull() & F.col("sent_at").isNotNull()).alias("parsed_and_sent"),
        F.count_if(F.date_trunc("second", when).cast("timestamp_ntz") == F.date_trunc("second", "sent_at").cast("timestamp_ntz")).alias("agree"),
    )


Q["date_styles"] = (date_styles, None)


def content_ids(s, d):
    links = t(s, d, "links").select("link_id", "email_id", "part_id", "role", "raw_value").distinct()
    key = F.concat_ws("|", F.col("email_id").cast("string"), F.coalesce("part_id", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("raw_value", F.lit("")))
    return links.select("link_id", F.concat(F.lit("lnk_"), F.substring(F.sha2(key, 256), 1, 24)).alias("id"))


Q["content_ids"] = (content_ids, """
  SELECT DISTINCT link_id, 'lnk_' || sha256(concat_ws('|', email_id::VARCHAR, coalesce(part_id, ''), coalesce(role, ''), coalesce(raw_value, '')))[1:24] AS id FROM links""")


def stub_vectors(s, d):
    from caseloom.operators.retrieval import stub_embedding

    rows = t(s, d, "rag_source_cases").where("text_excerpt is not null").select("case_no", "text_excerpt").distinct()
    v = rows.select("case_no", stub_embedding(F.col("text_excerpt")).alias("v"))
    return v.select("case_no", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"))


Q["stub_vectors"] = (stub_vectors, """
  SELECT DISTINCT case_no, 16::BIGINT AS dim, 1.0::DOUBLE AS norm2 FROM rag_source_cases WHERE text_excerpt IS NOT NULL""")
