"""Records against what they were made from: evidence, references, rows of two tables, times, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.operators import integrity
from caseloom.queries.base import t

Q = {}


def evidence_matches(s, d):
    """Evidence of each observable: its least archived response, or the observable's own id where there is none."""
    r = t(s, d, "tool_results").select("query_observable_id", "response_sha256", "status").distinct()
    e = r.where("query_observable_id is not null").groupBy("query_observable_id").agg(F.coalesce(F.min(F.when(F.col("status") != "not_found", F.col("response_sha256"))), F.lit("none")).alias("response_sha256"))
    return integrity.evidence_matches(e, r, "query_observable_id", "response_sha256", F.col("status") == "ok")


Q["evidence_matches"] = (evidence_matches, """
  WITH r AS (SELECT DISTINCT query_observable_id AS k, response_sha256 AS c, status FROM tool_results WHERE query_observable_id IS NOT NULL),
  e AS (SELECT k, coalesce(min(c) FILTER (WHERE status <> 'not_found'), 'none') AS c FROM r GROUP BY k)
  SELECT k AS query_observable_id, c AS response_sha256, CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND status = 'ok') THEN 'no_usable' WHEN EXISTS (SELECT 1 FROM r WHERE r.k = e.k AND status = 'ok' AND r.c IS NOT DISTINCT FROM e.c) THEN 'match' ELSE 'differs' END AS outcome FROM e""")


def typed_references(s, d):
    """Each link's part: there, there with another type than the role needs, or missing."""
    links = t(s, d, "links").select("link_id", F.concat_ws("/", "email_id", "part_id").alias("ref"), F.when(F.col("role") == "href", "text/html").otherwise("text/plain").alias("needs")).distinct()
    parts = t(s, d, "text_parts").select(F.concat_ws("/", "email_id", "part_id").alias("part"), "mime_type")
    return integrity.typed_references(links, "ref", "needs", parts, "part", "mime_type").select("link_id", "check")


Q["typed_references"] = (typed_references, """
  WITH l AS (SELECT DISTINCT link_id, concat_ws('/', email_id, part_id) AS ref, CASE WHEN role = 'href' THEN 'text/html' ELSE 'text/plain' END AS needs FROM links), p AS (SELECT DISTINCT concat_ws('/', email_id, part_id) AS part, mime_type FROM text_parts)
  SELECT link_id, CASE WHEN EXISTS (SELECT 1 FROM p WHERE part = ref AND mime_type = needs) THEN 'ok' WHEN EXISTS (SELECT 1 FROM p WHERE part = ref) THEN 'type' ELSE 'missing' END AS "check" FROM l""")


def link_references(s, d):
    links = t(s, d, "links").select("link_id", "id", "email_id", "part_id").distinct()
    parts = t(s, d, "text_parts").select("email_id", "part_id", "mime_type").where("email_id is not null").distinct()
    got = links.join(parts, ["email_id", "part_id"])
    return got.select("link_id", "mime_type", integrity.link_reference(F.col("part_id"), F.col("id")).alias("source_ref"))


Q["link_references"] = (link_references, """
  SELECT link_id, mime_type, part_id || ':link:' || substr(regexp_replace(id, '^[a-z]+_', ''), 1, 16) AS source_ref
  FROM (SELECT DISTINCT link_id, id, email_id, part_id FROM links) JOIN (SELECT DISTINCT email_id, part_id, mime_type FROM text_parts) USING (email_id, part_id)""")


def record_agreement(s, d):
    """Retrieval cases against the manifest, by the record's hash: dataset and campaign."""
    a = t(s, d, "rag_source_cases").select(F.col("record_sha256").alias("hash"), "dataset", "campaign_id")
    b = t(s, d, "corpus_manifest").select(F.col("raw_sha256").alias("hash"), F.col("source_dataset").alias("dataset"), "campaign_id")
    return integrity.agreement(a, b, "hash", ["dataset", "campaign_id"])


Q["record_agreement"] = (record_agreement, """
  WITH a AS (SELECT h, count(*) AS n, min(x) AS x, min(c) AS c FROM (SELECT DISTINCT record_sha256 AS h, dataset AS x, campaign_id AS c FROM rag_source_cases WHERE record_sha256 IS NOT NULL) GROUP BY h),
  b AS (SELECT h, count(*) AS n, min(x) AS x, min(c) AS c FROM (SELECT DISTINCT raw_sha256 AS h, source_dataset AS x, campaign_id AS c FROM corpus_manifest WHERE raw_sha256 IS NOT NULL) GROUP BY h),
  j AS (SELECT coalesce(a.h, b.h) AS hash, a.n AS an, b.n AS bn, a.x AS ax, b.x AS bx, a.c AS ac, b.c AS bc FROM a FULL JOIN b ON a.h = b.h)
  SELECT hash, 'missing_left' AS problem FROM j WHERE an IS NULL UNION ALL SELECT hash, 'missing_right' FROM j WHERE bn IS NULL UNION ALL SELECT hash, 'repeated_left' FROM j WHERE an > 1 UNION ALL SELECT hash, 'repeated_right' FROM j WHERE bn > 1
  UNION ALL SELECT hash, 'dataset' FROM j WHERE an = 1 AND bn = 1 AND ax IS DISTINCT FROM bx UNION ALL SELECT hash, 'campaign_id' FROM j WHERE an = 1 AND bn = 1 AND ac IS DISTINCT FROM bc""")


def timing_problems(s, d):
    """Seconds from sending to taking in, as a total, against the seconds its results took to be archived."""
    m = t(s, d, "parsed_emails").select("email_id", "sent_at", "ingested_at").dropDuplicates(["email_id"])
    sec = lambda a, b: F.unix_micros(F.col(a).cast("timestamp")) / 1e6 - F.unix_micros(F.col(b).cast("timestamp")) / 1e6
    r = t(s, d, "tool_results").select("result_id", "email_id", "collected_at", "archived_at").distinct().groupBy("email_id").agg(F.sum(sec("archived_at", "collected_at")).alias("archive"))
    x = m.select("email_id", F.round(sec("ingested_at", "sent_at"), 3).alias("total")).join(r.select("email_id", F.round("archive", 3).alias("archive")), "email_id", "left")
    return integrity.timing_problems(x, "email_id", "total", ["archive"], 0.02)


Q["timing_problems"] = (timing_problems, """
  WITH m AS (SELECT DISTINCT email_id, round(epoch_us(ingested_at) / 1e6 - epoch_us(sent_at) / 1e6, 3) AS total FROM parsed_emails),
  r AS (SELECT email_id, round(sum(epoch_us(archived_at) / 1e6 - epoch_us(collected_at) / 1e6), 3) AS archive FROM (SELECT DISTINCT result_id, email_id, collected_at, archived_at FROM tool_results) GROUP BY 1),
  x AS (SELECT m.email_id, total, archive FROM m LEFT JOIN r ON r.email_id = m.email_id)
  SELECT email_id, 'no_total' AS problem FROM x WHERE total IS NULL UNION ALL SELECT email_id, 'negative' FROM x WHERE coalesce(total < 0, false) OR coalesce(archive < 0, false) UNION ALL SELECT email_id, 'below_phases' FROM x WHERE total + 0.02 < coalesce(archive, 0)""")


def canonical_results(s, d):
    r = t(s, d, "tool_results").select("result_id", "email_id", "tool", "query_observable_id", "status").distinct()
    ranks = {"virustotal": 0, "urlscan": 1, "opencti": 2, "rag": 3}
    return integrity.canonical_order(r, "email_id", "tool", ranks, "query_observable_id", ["result_id", "email_id", "tool", "query_observable_id", "status"]).select("result_id", "position")


Q["canonical_results"] = (canonical_results, """
  SELECT result_id, row_number() OVER (PARTITION BY email_id ORDER BY CASE tool WHEN 'virustotal' THEN 0 WHEN 'urlscan' THEN 1 WHEN 'opencti' THEN 2 WHEN 'rag' THEN 3 ELSE 4 END, coalesce(query_observable_id, ''),
    to_json({email_id: email_id, query_observable_id: query_observable_id, result_id: result_id, status: status, tool: tool})::VARCHAR) AS position FROM (SELECT DISTINCT result_id, email_id, tool, query_observable_id, status FROM tool_results)""")


def gold_records(s, d):
    """Manifest rows that have a case, with its label, and the first 1,200 characters of the plain text, else of the HTML."""
    m = t(s, d, "corpus_manifest").select("sample_id", F.col("raw_sha256").alias("hash"), "source_dataset", "normalized_label").distinct()
    c = t(s, d, "rag_source_cases").select(F.col("record_sha256").alias("hash"), "validated_label").where("hash is not null").groupBy("hash").agg(F.min("validated_label").alias("validated_label"))
    e = t(s, d, "parsed_emails").select("email_id", F.col("email_sha256").alias("hash")).where("hash is not null").groupBy("hash").agg(F.min("email_id").alias("email_id"))
    p = t(s, d, "text_parts").where("text is not null and email_id is not null").select("email_id", "part_key", "mime_type", F.substring(F.trim("text"), 1, 1200).alias("excerpt"))
    first = p.groupBy("email_id").agg(F.min_by("excerpt", F.struct(F.when(F.col("mime_type") == "text/plain", 0).otherwise(1), "part_key")).alias("excerpt"))
    got = m.join(c, "hash").join(e, "hash", "left").join(first, "email_id", "left")
    return got.select("sample_id", "source_dataset", F.coalesce("validated_label", "normalized_label").alias("label"), F.sha2("excerpt", 256).alias("print"))


Q["gold_records"] = (gold_records, """
  WITH m AS (SELECT DISTINCT sample_id, raw_sha256 AS h, source_dataset, normalized_label FROM corpus_manifest), c AS (SELECT record_sha256 AS h, min(validated_label) AS v FROM rag_source_cases WHERE record_sha256 IS NOT NULL GROUP BY 1),
  e AS (SELECT email_sha256 AS h, min(email_id) AS email_id FROM parsed_emails WHERE email_sha256 IS NOT NULL GROUP BY 1),
  p AS (SELECT email_id, substring(trim(text, ' '), 1, 1200) AS x, row_number() OVER (PARTITION BY email_id ORDER BY (mime_type <> 'text/plain' OR mime_type IS NULL)::INT, part_key) AS r FROM (SELECT DISTINCT email_id, part_key, mime_type, text FROM text_parts WHERE text IS NOT NULL))
  SELECT sample_id, source_dataset, coalesce(v, normalized_label) AS label, sha256(x) AS print FROM m JOIN c USING (h) LEFT JOIN e USING (h) LEFT JOIN p ON p.email_id = e.email_id AND p.r = 1""")
