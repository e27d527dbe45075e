"""Registries, integrity, links, observables, checks and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import urls as u
from caseloom.operators import facts, keyed
from caseloom.queries.base import HOST, t

Q = {}


def first_results(s, d):
    r = t(s, d, "tool_results").where("query_observable_id is not null")
    one = keyed.first_by(r.select("tool", "query_observable_id", "result_id", "status", "archived_at"), ["tool", "query_observable_id"], ["archived_at", "result_id"])
    return one.select("tool", "query_observable_id", "result_id", "status")


Q["first_results"] = (first_results, """
  SELECT tool, query_observable_id, result_id, status FROM (SELECT DISTINCT tool, query_observable_id, result_id, status, archived_at,
    row_number() OVER (PARTITION BY tool, query_observable_id ORDER BY archived_at NULLS FIRST, result_id) AS r FROM tool_results WHERE query_observable_id IS NOT NULL) WHERE r = 1""")


def last_results(s, d):
    r = t(s, d, "tool_results").where("query_observable_id is not null").select("tool", "query_observable_id", "result_id", "status")
    return keyed.last_by(r, ["tool", "query_observable_id"], "result_id")


Q["last_results"] = (last_results, """
  SELECT tool, query_observable_id, result_id, status FROM (SELECT tool, query_observable_id, result_id, status,
    row_number() OVER (PARTITION BY tool, query_observable_id ORDER BY result_id DESC) AS r FROM tool_results WHERE query_observable_id IS NOT NULL) WHERE r = 1""")


def host_registry(s, d):
    rows = t(s, d, "links").where("hostname is not null").select("hostname", "role", "link_id").distinct()
    r = keyed.registry(rows, ["hostname"], "role", ["link_id"])
    return r.select("hostname", F.array_join("roles", ",").alias("roles"), F.col("first_at.link_id").alias("first_link"), "occurrences")


Q["host_registry"] = (host_registry, """
  WITH l AS (SELECT DISTINCT hostname, role, link_id FROM links WHERE hostname IS NOT NULL),
  r AS (SELECT hostname, role, min(link_id) AS f, count(*) AS n FROM l GROUP BY ALL)
  SELECT hostname, array_to_string(list(role ORDER BY f), ',') AS roles, min(f) AS first_link, sum(n)::BIGINT AS occurrences FROM r GROUP BY hostname""")


def merged_evidence(s, d):
    """Keyed union of link targets by content id from two projections; equal content merges."""
    links = t(s, d, "links").select(F.col("id").alias("key"), F.col("normalized_value").alias("value"), F.col("hostname").alias("host"))
    a, b = links.where("host is not null"), links.where("value is not null")
    merged, _ = keyed.keyed_union([a, b], "key", ["value", "host"])
    return merged.select("key", "value", "host", F.col("source_no").cast("long").alias("source_no"))


Q["merged_evidence"] = (merged_evidence, """
  WITH u AS (SELECT id AS key, normalized_value AS value, hostname AS host, 0 AS part FROM links WHERE hostname IS NOT NULL
    UNION ALL SELECT id, normalized_value, hostname, 1 FROM links WHERE normalized_value IS NOT NULL)
  SELECT key, any_value(value) AS value, any_value(host) AS host, min(part)::BIGINT AS source_no FROM u GROUP BY key
  HAVING count(DISTINCT (coalesce(value, '<null>'), coalesce(host, '<null>'))) = 1""")


def merge_conflicts(s, d):
    """Cases under one group with different labels: keyed union's conflicts."""
    c = t(s, d, "rag_source_cases").where("campaign_id is not null").select(F.col("campaign_id").alias("key"), F.col("validated_label").alias("label"))
    _, bad = keyed.keyed_union([c], "key", ["label"])
    return bad


Q["merge_conflicts"] = (merge_conflicts, """
  SELECT campaign_id AS key, count(*) AS copies FROM rag_source_cases WHERE campaign_id IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT coalesce(validated_label, '<null>')) > 1""")


def dangling_refs(s, d):
    mails = t(s, d, "parsed_emails")
    one = lambda n, k: keyed.dangling(t(s, d, n).select(F.lit(n).alias("source"), F.col(k).alias("key"), "email_id"), "email_id", mails, "email_id")
    m = keyed.dangling(t(s, d, "corpus_manifest").select(F.lit("corpus_manifest").alias("source"), "sample_id", "raw_sha256"), "raw_sha256", mails, "email_sha256")
    rows = one("links", "link_id").unionByName(one("tool_results", "result_id")).unionByName(one("text_parts", "part_key"))
    return rows.groupBy("source").agg(F.count_distinct("key").alias("n")).unionByName(m.groupBy("source").agg(F.count_distinct("sample_id").alias("n")))


Q["dangling_refs"] = (dangling_refs, """
  SELECT 'links' AS source, count(DISTINCT link_id) AS n FROM links WHERE email_id IS NOT NULL AND email_id NOT IN (SELECT email_id FROM parsed_emails) HAVING count(*) > 0
  UNION ALL SELECT 'tool_results', count(DISTINCT result_id) FROM tool_results WHERE email_id IS NOT NULL AND email_id NOT IN (SELECT email_id FROM parsed_emails) HAVING count(*) > 0
  UNION ALL SELECT 'text_parts', count(DISTINCT part_key) FROM text_parts WHERE email_id IS NOT NULL AND email_id NOT IN (SELECT email_id FROM parsed_emails) HAVING count(*) > 0
  UNION ALL SELECT 'corpus_manifest', count(DISTINCT sample_id) FROM corpus_manifest WHERE raw_sha256 IS NOT NULL AND raw_sha256 NOT IN (SELECT email_sha256 FROM parsed_emails WHERE email_sha256 IS NOT NULL) HAVING count(*) > 0""")


def uncovered_messages(s, d):
    mails = t(s, d, "parsed_emails").select("email_id", "email_sha256").distinct()
    return mails.join(t(s, d, "corpus_manifest").select(F.col("raw_sha256").alias("email_sha256")), "email_sha256", "left_anti").select("email_id")


Q["uncovered_messages"] = (uncovered_messages, """
  SELECT DISTINCT email_id FROM parsed_emails p WHERE NOT EXISTS (SELECT 1 FROM corpus_manifest m WHERE m.raw_sha256 = p.email_sha256)""")


def source_numbers(s, d):
    m = t(s, d, "corpus_manifest").select("source_id", "sample_id").distinct()
    return keyed.ordinals(m, "source_id", ["sample_id"], "ordinal")


Q["source_numbers"] = (source_numbers, """
  SELECT source_id, sample_id, source_id || '_' || lpad(row_number() OVER (PARTITION BY source_id ORDER BY sample_id)::VARCHAR, 5, '0') AS ordinal
  FROM (SELECT DISTINCT source_id, sample_id FROM corpus_manifest)""")


def part_links(s, d):
    parts = t(s, d, "text_parts").select("part_key", "mime_type", "text").distinct()
    rows = facts.part_links(parts, ["part_key"], "text", "mime_type").where("role = 'href'")
    return rows.select("part_key", F.col("pos").cast("long").alias("pos"), "value", "display", facts.display_mismatch(F.col("value"), F.col("display")).alias("mismatch"))


_AN = r"(?is)<a\b[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
Q["part_links"] = (part_links, f"""
  WITH p AS (SELECT DISTINCT part_key, text FROM text_parts WHERE mime_type = 'text/html'),
  x AS (SELECT part_key, regexp_extract_all(text, '{_AN}', 1) AS h, regexp_extract_all(text, '{_AN}', 2) AS d FROM p),
  y AS (SELECT part_key, unnest(range(len(h))) AS pos, unnest(h) AS value, trim(regexp_replace(unnest(d), '<[^>]+>', '', 'g')) AS display FROM x)
  SELECT part_key, pos::BIGINT AS pos, value, display,
    coalesce({HOST.format('trim(display)')} <> {HOST.format('value')}, false) AS mismatch FROM y""")


def links_by_role(s, d):
    parts = t(s, d, "text_parts").select("part_key", "mime_type", "text").distinct()
    return facts.part_links(parts, ["part_key"], "text", "mime_type").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("targets"))


Q["links_by_role"] = (links_by_role, None)


def observables(s, d):
    parts = t(s, d, "text_parts").select("part_key", "text").distinct()
    found = facts.text_observables(parts, ["part_key"], "text").where("type in ('email', 'ip')")
    r = facts.observable_registry(found, ["part_key", "pos"])
    return r.select("id", "type", "value", F.col("first_at.part_key").alias("first_part"), "occurrences", F.array_join("roles", ",").alias("roles"))


Q["observables"] = (observables, r"""
  WITH p AS (SELECT DISTINCT part_key, text FROM text_parts),
  r AS (SELECT part_key, 'email' AS type, 'mailbox' AS role, lower(unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1))) AS value FROM p
    UNION ALL SELECT part_key, 'ip', 'transport', m FROM (SELECT part_key, rtrim(unnest(regexp_extract_all(text, '[0-9.]+', 0)), '.') AS m FROM p)
      WHERE regexp_full_match(m, '(?:[0-9]{1,3}\.){3}[0-9]{1,3}')),
  f AS (SELECT * FROM r WHERE type = 'email' OR (list_max(list_transform(string_split(value, '.'), lambda x: x::INT)) < 256 AND NOT (string_split(value, '.')[1]::INT IN (0, 10, 127) OR string_split(value, '.')[1]::INT >= 224
      OR (string_split(value, '.')[1]::INT = 169 AND string_split(value, '.')[2]::INT = 254) OR (string_split(value, '.')[1]::INT = 172 AND string_split(value, '.')[2]::INT BETWEEN 16 AND 31) OR (string_split(value, '.')[1]::INT = 192 AND string_split(value, '.')[2]::INT = 168) OR (string_split(value, '.')[1]::INT = 100 AND string_split(value, '.')[2]::INT BETWEEN 64 AND 127))))
  SELECT 'obs_' || sha256(type || '|' || value)[1:16] AS id, type, value, min(part_key) AS first_part, count(*) AS occurrences, any_value(role) AS roles FROM f GROUP BY type, value""")


def evidence_facts(s, d):
    links = t(s, d, "links")
    mails = t(s, d, "parsed_emails")
    e = facts.evidence({
        "url_found": (links.where("normalized_value is not null"), F.col("id"), F.col("normalized_value")),
        "href_display_mismatch": (links.where("href_display_mismatch"), F.col("id"), F.col("display_text")),
        "header_value": (mails.where("subject is not null"), F.concat(F.lit("subject:"), F.col("email_id").cast("string")), F.col("subject")),
    })
    return e.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("least"))


_EV = "'ev_' || sha256(predicate || '|' || source_ref || '|' || coalesce(value, ''))[1:16]"
Q["evidence_facts"] = (evidence_facts, f"""
  WITH e AS (SELECT 'url_found' AS predicate, id AS source_ref, normalized_value AS value FROM links WHERE normalized_value IS NOT NULL
    UNION SELECT 'href_display_mismatch', id, display_text FROM links WHERE href_display_mismatch
    UNION SELECT 'header_value', 'subject:' || email_id::VARCHAR, subject FROM parsed_emails WHERE subject IS NOT NULL)
  SELECT predicate, count(*) AS n, count(DISTINCT {_EV}) AS ids, min({_EV}) AS least FROM e GROUP BY predicate""")


def priority_targets(s, d):
    links = t(s, d, "links").select("link_id", "email_id", "role", "hostname", "normalized_value", "href_display_mismatch").distinct()
    bucket = (
        F.when(F.col("href_display_mismatch"), 1).when(u.http_host(F.col("normalized_value")).isNotNull() & F.col("role").isin("href", "visible_url"), 2)
        .when(F.col("hostname").isNotNull(), 3)
    )
    return facts.priority_targets(links, "email_id", bucket, ["link_id"], 4).select("email_id", "link_id", F.col("bucket").cast("long").alias("bucket"), F.col("place").cast("long").alias("place"))


Q["priority_targets"] = (priority_targets, f"""
  WITH l AS (SELECT DISTINCT link_id, email_id, role, hostname, normalized_value, href_display_mismatch FROM links),
  b AS (SELECT *, CASE WHEN href_display_mismatch THEN 1 WHEN {HOST.format('normalized_value')} IS NOT NULL AND role IN ('href', 'visible_url') THEN 2 WHEN hostname IS NOT NULL THEN 3 END AS bucket FROM l)
  SELECT email_id, link_id, bucket::BIGINT AS bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY bucket, link_id) AS place FROM b WHERE bucket IS NOT NULL) WHERE place <= 4""")


def manifest_issues(s, d):
    m = t(s, d, "corpus_manifest").distinct()
    c = F.col
    rules = [
        ("label_outside_taxonomy", "error", c("normalized_label").isNotNull() & ~c("normalized_label").isin("spear_phishing", "phishing", "fraude", "menace", "spam", "legitime")),
        ("confirmed_without_label", "critical", (c("label_status") == "confirmed") & c("normalized_label").isNull()),
        ("bad_raw_hash", "error", ~c("raw_sha256").rlike("^[0-9a-f]{64}$")),
        ("text_without_body_hash", "warning", c("has_text") & (F.coalesce(c("body_sha256"), F.lit("")) == "")),
        ("confirmed_without_reviewer", "warning", (c("label_status") == "confirmed") & (F.coalesce(c("reviewer_ref"), F.lit("")) == "")),
        ("bad_source_url", "error", ~c("source_url").rlike("^https?://")),
    ]
    i = facts.issues(m, "sample_id", rules)
    return keyed.collapse_issues(i, ["code", "severity"], "rule_no").select("code", "severity", F.col("first_pos").cast("long").alias("rule_no"), F.col("repeats").alias("n"))


Q["manifest_issues"] = (manifest_issues, """
  WITH m AS (SELECT DISTINCT * FROM corpus_manifest),
  i AS (SELECT unnest([
    CASE WHEN normalized_label NOT IN ('spear_phishing','phishing','fraude','menace','spam','legitime') THEN {'r': 0, 'c': 'label_outside_taxonomy', 's': 'error'} END,
    CASE WHEN label_status = 'confirmed' AND normalized_label IS NULL THEN {'r': 1, 'c': 'confirmed_without_label', 's': 'critical'} END,
    CASE WHEN NOT regexp_full_match(raw_sha256, '[0-9a-f]{64}') THEN {'r': 2, 'c': 'bad_raw_hash', 's': 'error'} END,
    CASE WHEN has_text AND coalesce(body_sha256, '') = '' THEN {'r': 3, 'c': 'text_without_body_hash', 's': 'warning'} END,
    CASE WHEN label_status = 'confirmed' AND coalesce(reviewer_ref, '') = '' THEN {'r': 4, 'c': 'confirmed_without_reviewer', 's': 'warning'} END,
    CASE WHEN NOT regexp_matches(source_url, '^https?://') THEN {'r': 5, 'c': 'bad_source_url', 's': 'error'} END]) AS x FROM m)
  SELECT x.c AS code, x.s AS severity, min(x.r)::BIGINT AS rule_no, count(*) AS n FROM i WHERE x IS NOT NULL GROUP BY 1, 2""")


def closed_headers(s, d):
    m = t(s, d, "corpus_manifest").select("sample_id", "header_presence").distinct()
    return facts.closed_keys(m, "sample_id", "header_presence", ["from", "received", "subject"], ["from", "received", "subject", "to"])


Q["closed_headers"] = (closed_headers, """
  WITH m AS (SELECT DISTINCT sample_id, header_presence FROM corpus_manifest WHERE header_presence IS NOT NULL),
  k AS (SELECT sample_id, CASE WHEN json_valid(header_presence) THEN json_keys(header_presence) END AS k FROM m),
  d AS (SELECT sample_id, k, list_sort(list_filter(k, lambda x: x NOT IN ('from','received','subject'))) AS extra, list_sort(list_filter(['from','received','subject','to'], lambda x: NOT list_contains(k, x))) AS missing FROM k)
  SELECT sample_id, array_to_string(extra, ',') AS extra, array_to_string(missing, ',') AS missing, k IS NULL AS broken FROM d WHERE k IS NULL OR len(extra) > 0 OR len(missing) > 0""")


def props_keys(s, d):
    e = t(s, d, "events").select(F.col("event_id"), F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select(F.explode("m").alias("k", "v")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("top"))


Q["props_keys"] = (props_keys, """
  SELECT 'k' AS k, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS top FROM events WHERE props->>'$.k' IS NOT NULL""")


def recomputed_diff(s, d):
    """Host counts from the recorded hostname and from the raw address: keys added, missing, changed."""
    links = t(s, d, "links").select("link_id", "hostname", "raw_value").distinct()
    a = links.where("hostname is not null").groupBy(F.lower("hostname").alias("host")).agg(F.count(F.lit(1)).alias("n"))
    b = links.select(u.http_host(F.col("raw_value")).alias("host")).where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return facts.table_diff(a, b, "host", "n")


Q["recomputed_diff"] = (recomputed_diff, f"""
  WITH l AS (SELECT DISTINCT link_id, hostname, raw_value FROM links),
  a AS (SELECT lower(hostname) AS host, count(*) AS n FROM l WHERE hostname IS NOT NULL GROUP BY 1),
  b AS (SELECT {HOST.format('raw_value')} AS host, count(*) AS n FROM l GROUP BY 1 HAVING host IS NOT NULL)
  SELECT coalesce(a.host, b.host) AS host, CASE WHEN a.host IS NULL THEN 'added' WHEN b.host IS NULL THEN 'missing' ELSE 'changed' END AS change, a.n AS was, b.n AS "is"
  FROM a FULL OUTER JOIN b ON a.host = b.host WHERE a.n IS DISTINCT FROM b.n""")


def recipients_known(s, d):
    """Copied mailboxes that also stand in the to list of another message: a semi-join of address sets."""
    m = t(s, d, "parsed_emails").select("email_id", "to_addresses", "cc_addresses").distinct()
    cc = m.select(F.explode("cc_addresses").alias("e")).select(u.addr_spec(F.col("e")).alias("mailbox")).where("mailbox is not null")
    to = m.select(F.explode("to_addresses").alias("e")).select(u.addr_spec(F.col("e")).alias("mailbox")).where("mailbox is not null").distinct()
    return cc.join(to, "mailbox", "left_semi").groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"))


_SPEC = """nullif(lower(regexp_extract({0}, '([^\\s<>,;"''()]+@[^\\s<>,;"''()]+)', 1)), '')"""
Q["recipients_known"] = (recipients_known, f"""
  WITH m AS (SELECT DISTINCT email_id, to_addresses, cc_addresses FROM parsed_emails),
  c AS (SELECT {_SPEC.format('e')} AS mailbox FROM (SELECT unnest(cc_addresses) AS e FROM m)),
  o AS (SELECT DISTINCT {_SPEC.format('e')} AS mailbox FROM (SELECT unnest(to_addresses) AS e FROM m))
  SELECT mailbox, count(*) AS n FROM c WHERE mailbox IN (SELECT mailbox FROM o WHERE mailbox IS NOT NULL) GROUP BY mailbox""")


def forbidden_keys(s, d):
    from caseloom.operators.jsonchecks import forbidden_keys as check

    e = t(s, d, "corpus_manifest").select("sample_id", "header_presence").distinct()
    return check(e, "sample_id", "header_presence", ["Received", "bcc"])


Q["forbidden_keys"] = (forbidden_keys, "SELECT DISTINCT sample_id, '$.received' AS problem FROM corpus_manifest WHERE list_contains(json_keys(header_presence), 'received')")


def schema_violations(s, d):
    from caseloom.operators.jsonchecks import schema_violations as check

    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 80}}}
    bad = check(t(s, d, "events").select("event_id", "props"), "event_id", "props", schema)
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


Q["schema_violations"] = (schema_violations, "SELECT '$.k: above 80' AS problem, count(*) AS n FROM events WHERE (props->>'$.k')::BIGINT > 80 HAVING count(*) > 0")


def retrieval_texts(s, d):
    """What a message is searched by: subject and texts in order of their keys, cut to 500 characters."""
    m = t(s, d, "parsed_emails").select("email_id", "subject").distinct()
    p = t(s, d, "text_parts").select("email_id", "part_key", "text").distinct().where("text <> ''")
    texts = p.groupBy("email_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_key", "text"))), lambda x: x["text"]), "\n").alias("body"))
    q = m.join(texts, "email_id", "left").select("email_id", F.substring(F.concat_ws("\n", "subject", "body"), 1, 500).alias("q"))
    return q.select("email_id", F.length("q").cast("long").alias("chars"), F.sha2("q", 256).alias("print"))


Q["retrieval_texts"] = (retrieval_texts, """
  WITH m AS (SELECT DISTINCT email_id, subject FROM parsed_emails), p AS (SELECT DISTINCT email_id, part_key, text FROM text_parts WHERE text <> ''),
  b AS (SELECT email_id, string_agg(text, chr(10) ORDER BY part_key) AS body FROM p GROUP BY email_id),
  q AS (SELECT email_id, substring(concat_ws(chr(10), subject, body), 1, 500) AS q FROM m LEFT JOIN b USING (email_id))
  SELECT email_id, length(q)::BIGINT AS chars, sha256(q) AS print FROM q""")


def input_audit(s, d):
    """What a message brings: parts, characters, links, distinct targets, results asked for."""
    p = t(s, d, "text_parts").select("email_id", "part_key", F.length("text").alias("n")).distinct().groupBy("email_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("chars"))
    l = t(s, d, "links").select("email_id", "link_id", "normalized_value").distinct().groupBy("email_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("normalized_value").alias("targets"))
    r = t(s, d, "tool_results").select("email_id", "result_id", "requests_sent").distinct().groupBy("email_id").agg(F.count(F.lit(1)).alias("results"), F.sum("requests_sent").alias("requests"))
    m = t(s, d, "parsed_emails").select("email_id").distinct()
    full = m.join(p, "email_id", "left").join(l, "email_id", "left").join(r, "email_id", "left")
    return full.na.fill(0, ["parts", "chars", "links", "targets", "results", "requests"])


Q["input_audit"] = (input_audit, """
  SELECT email_id, coalesce(parts, 0) AS parts, coalesce(chars, 0)::BIGINT AS chars, coalesce(links, 0) AS links, coalesce(targets, 0) AS targets, coalesce(results, 0) AS results, coalesce(requests, 0)::BIGINT AS requests
  FROM (SELECT DISTINCT email_id FROM parsed_emails)
  LEFT JOIN (SELECT email_id, count(*) AS parts, sum(n) AS chars FROM (SELECT DISTINCT email_id, part_key, length(text) AS n FROM text_parts) GROUP BY 1) USING (email_id)
  LEFT JOIN (SELECT email_id, count(*) AS links, count(DISTINCT normalized_value) AS targets FROM (SELECT DISTINCT email_id, link_id, normalized_value FROM links) GROUP BY 1) USING (email_id)
  LEFT JOIN (SELECT email_id, count(*) AS results, sum(requests_sent) AS requests FROM (SELECT DISTINCT email_id, result_id, requests_sent FROM tool_results) GROUP BY 1) USING (email_id)""")


def bounded_targets(s, d):
    """Up to 20 distinct targets of a message in order, cut before they are collected."""
    from pyspark.sql import Window

    one = t(s, d, "links").select("email_id", "normalized_value").where("normalized_value is not null").distinct()
    top = one.withColumn("r", F.row_number().over(Window.partitionBy("email_id").orderBy("normalized_value"))).where("r <= 20")
    return top.groupBy("email_id").agg(F.array_join(F.array_sort(F.collect_list("normalized_value")), " ").alias("targets"))


Q["bounded_targets"] = (bounded_targets, """
  WITH o AS (SELECT DISTINCT email_id, normalized_value AS v FROM links WHERE normalized_value IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY v) AS n FROM o) SELECT email_id, string_agg(v, ' ' ORDER BY v) AS targets FROM r WHERE n <= 20 GROUP BY email_id""")
