"""Metrics, coverage, sequences, selections, duplicates and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.operators import families, metrics, retrieval, sequences, splits
from caseloom.queries.base import SQUASH, t

Q = {}
_TAX = "('spear_phishing','phishing','fraude','menace','spam','legitime')"


def _labelled(s, d):
    """Labels beside a rule's prediction; the rule abstains where the message has no links flag."""
    m = t(s, d, "corpus_manifest").select("sample_id", "normalized_label", "has_urls", "has_attachments", "has_html", "original_label").distinct()
    guess = (
        F.when(F.col("has_urls").isNull() | F.col("has_html").isNull(), None).when(F.col("has_urls") & F.col("has_html"), "phishing")
        .when(F.col("has_attachments"), "fraude").when(F.col("original_label") == "spam", "spam").when(F.col("original_label") == "ham", "legitime")
    )
    other = F.when(F.col("has_urls"), "phishing").when(~F.col("has_urls"), "legitime")
    return m.withColumn("guess", guess).withColumn("other", other)


_LAB = """l AS (SELECT DISTINCT sample_id, normalized_label AS t, has_urls, has_attachments, has_html, original_label,
   CASE WHEN has_urls IS NULL OR has_html IS NULL THEN NULL WHEN has_urls AND has_html THEN 'phishing' WHEN has_attachments THEN 'fraude'
        WHEN original_label = 'spam' THEN 'spam' WHEN original_label = 'ham' THEN 'legitime' END AS p,
   CASE WHEN has_urls THEN 'phishing' WHEN NOT has_urls THEN 'legitime' END AS o FROM corpus_manifest),
  v AS (SELECT * FROM l WHERE t IN """ + _TAX + "),\n  labels AS (SELECT unnest(['spear_phishing','phishing','fraude','menace','spam','legitime']) AS label)"


def confusion_matrix(s, d):
    return metrics.confusion(_labelled(s, d), "normalized_label", "guess")


Q["confusion_matrix"] = (confusion_matrix, "WITH " + _LAB + " SELECT label AS truth, " + ", ".join(
    f"count(*) FILTER (WHERE p = '{x}') AS as_{x}" for x in metrics.LABELS) + ", count(*) FILTER (WHERE t IS NOT NULL AND p IS NULL) AS abstained FROM labels LEFT JOIN v ON t = label GROUP BY label")


def classification_report(s, d):
    return metrics.classification(_labelled(s, d), "normalized_label", "guess")


_CLS = "WITH " + _LAB + """,
  c AS (SELECT label, (SELECT count(*) FROM v WHERE t = label) AS s, (SELECT count(*) FROM v WHERE p = label) AS q,
   (SELECT count(*) FROM v WHERE t = label AND p = label) AS h, (SELECT count(*) FROM v WHERE t = label AND p IS NULL) AS a FROM labels),
  f AS (SELECT label, s AS support, q AS predicted, h AS hits, a AS abstained,
   round(CASE WHEN s = 0 THEN NULL WHEN q = 0 THEN 0.0 ELSE h / nullif(q, 0) END::DOUBLE, 6) AS precision, round((h / nullif(s, 0))::DOUBLE, 6) AS recall,
   round(CASE WHEN s = 0 THEN NULL WHEN h = 0 THEN 0.0 ELSE 2 * h / nullif(s + q, 0) END::DOUBLE, 6) AS f1 FROM c) """
Q["classification_report"] = (classification_report, _CLS + "SELECT * FROM f")


def macro_f1(s, d):
    return metrics.macro_f1(metrics.classification(_labelled(s, d), "normalized_label", "guess"))


Q["macro_f1"] = (macro_f1, _CLS + """SELECT count(*) FILTER (WHERE support > 0) AS supported, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1_supported,
  round(CASE WHEN count(*) FILTER (WHERE support > 0) = 6 THEN avg(f1) END, 6) AS macro_f1_all, CASE WHEN count(*) FILTER (WHERE support > 0) < 6 THEN 'labels without support' END AS reason FROM f""")


def false_positives(s, d):
    return metrics.false_positives(_labelled(s, d), "normalized_label", "guess")


Q["false_positives"] = (false_positives, "WITH " + _LAB + """ SELECT count(*) AS support, count(*) FILTER (WHERE p <> 'legitime') AS not_legitime,
  count(*) FILTER (WHERE p IN ('spear_phishing','phishing','fraude','menace')) AS malicious, count(*) FILTER (WHERE p IS NULL) AS abstained,
  round(count(*) FILTER (WHERE p <> 'legitime') / nullif(count(*), 0), 6) AS strict_rate,
  round(count(*) FILTER (WHERE p IN ('spear_phishing','phishing','fraude','menace')) / nullif(count(*), 0), 6) AS malicious_rate,
  round(count(*) FILTER (WHERE p IS NULL) / nullif(count(*), 0), 6) AS abstention_rate FROM v WHERE t = 'legitime'""")


def paired_buckets(s, d):
    return metrics.paired(_labelled(s, d), "normalized_label", "guess", "other")


Q["paired_buckets"] = (paired_buckets, "WITH " + _LAB + """, b AS (SELECT coalesce(p = t, false) AS br, coalesce(o = t, false) AS ar, p, o FROM v)
  SELECT count(*) FILTER (WHERE br AND ar) AS rr, count(*) FILTER (WHERE br AND NOT ar) AS rw, count(*) FILTER (WHERE NOT br AND ar) AS wr,
  count(*) FILTER (WHERE NOT br AND NOT ar) AS ww, count(*) FILTER (WHERE br <> ar) AS n_changed, count(*) FILTER (WHERE p IS DISTINCT FROM o) AS n_verdict_diff FROM b""")


def latency_by_kind(s, d):
    e = t(s, d, "events")
    base = e.groupBy("event_type").agg(*metrics.stats(F.col("value")))
    middle = metrics.medians(e, ["event_type"], "value")
    return base.join(middle, "event_type", "left").join(metrics.nearest_rank(e, ["event_type"], "value", 0.95, "p95"), "event_type", "left")


Q["latency_by_kind"] = (latency_by_kind, """
  SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS max, round(sum(value), 4) AS total,
  quantile_disc(value, 0.95) AS p95 FROM (SELECT event_type, CASE WHEN value >= 0 THEN value END AS value FROM events) GROUP BY event_type""")


def delay_by_tool(s, d):
    """Milliseconds from collection to archiving, by tool and over all."""
    r = t(s, d, "tool_results").select("result_id", "tool", "collected_at", "archived_at").distinct()
    ms = r.withColumn("ms", (F.unix_micros(F.col("archived_at").cast("timestamp")) - F.unix_micros(F.col("collected_at").cast("timestamp"))) / 1000.0)
    sides = ms.select("ms", F.explode(F.array(F.struct("tool", F.lit(0).alias("all")), F.struct(F.lit(None).cast("string").alias("tool"), F.lit(1).alias("all")))).alias("x")).select("ms", "x.*")
    base = sides.groupBy("tool", "all").agg(*metrics.stats(F.col("ms")))
    middle = metrics.medians(sides, ["tool", "all"], "ms").select(F.col("tool").alias("t"), F.col("all").alias("a"), "median")
    return base.join(middle, F.col("tool").eqNullSafe(F.col("t")) & (F.col("all") == F.col("a")), "left").drop("t", "a", "all")


Q["delay_by_tool"] = (delay_by_tool, """
  WITH r AS (SELECT DISTINCT result_id, tool, collected_at, archived_at FROM tool_results), m AS (SELECT tool, CASE WHEN x >= 0 THEN x END AS ms FROM (SELECT tool, (epoch_us(archived_at) - epoch_us(collected_at)) / 1000.0 AS x FROM r))
  SELECT tool, count(ms) AS n, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, max(ms) AS max, round(sum(ms), 4) AS total FROM m GROUP BY GROUPING SETS ((tool), ())""")


def tool_coverage(s, d):
    r = t(s, d, "tool_results").select("result_id", "tool", "status", "reason", "requests_sent").distinct()
    return metrics.tool_coverage(r, "tool", "status", "reason", "requests_sent")


Q["tool_coverage"] = (tool_coverage, """
  WITH r AS (SELECT DISTINCT result_id, tool, status, reason, requests_sent FROM tool_results)
  SELECT tool, 'tool' AS level, NULL AS value, count(*) AS n, sum(requests_sent)::BIGINT AS requests, count(*) FILTER (WHERE status = 'ok') AS ok FROM r GROUP BY tool
  UNION ALL SELECT tool, 'status', status, count(*), sum(requests_sent)::BIGINT, count(*) FILTER (WHERE status = 'ok') FROM r GROUP BY tool, status
  UNION ALL SELECT tool, 'reason', reason, count(*), sum(requests_sent)::BIGINT, count(*) FILTER (WHERE status = 'ok') FROM r GROUP BY tool, reason""")


def overall_status(s, d):
    r = t(s, d, "tool_results").select("result_id", "email_id", "status").distinct()
    return metrics.overall_status(r, ["email_id"], "status")


Q["overall_status"] = (overall_status, """
  SELECT email_id, CASE WHEN bool_or(status = 'ok') THEN 'ok' WHEN bool_or(status = 'unavailable') THEN 'unavailable' WHEN bool_and(status = 'not_found') THEN 'not_found' ELSE 'skipped' END AS overall,
  count(*) AS n FROM (SELECT DISTINCT result_id, email_id, status FROM tool_results) GROUP BY email_id""")


def corpus_counters(s, d):
    m = t(s, d, "corpus_manifest").distinct()
    flags = ("has_text", "has_html", "has_urls", "has_attachments", "has_images", "has_received", "is_synthetic", "public_source")
    return m.rollup("source_dataset").agg(F.count(F.lit(1)).alias("rows_n"), *(F.count_if(F.col(f)).alias(f) for f in flags), F.count("normalized_label").alias("labelled"), F.grouping("source_dataset").cast("long").alias("is_total"))


Q["corpus_counters"] = (corpus_counters, """
  SELECT source_dataset, count(*) AS rows_n, """ + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in ("has_text", "has_html", "has_urls", "has_attachments", "has_images", "has_received", "is_synthetic", "public_source"))
  + ", count(normalized_label) AS labelled, grouping(source_dataset)::BIGINT AS is_total FROM (SELECT DISTINCT * FROM corpus_manifest) GROUP BY ROLLUP (source_dataset)")


def order_rollup(s, d):
    """Runs and their calls: known and unknown amounts, the status, the mean over known and over all."""
    li = t(s, d, "lineitem")
    known = F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    per = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("calls"), F.count(known).alias("known"), F.sum(known).alias("amount"))
    status = F.when(F.col("known") == 0, "unknown").when(F.col("known") < F.col("calls"), "partial").otherwise("complete")
    return per.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("calls").alias("calls"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.avg("amount"), 4).alias("mean_known"),
        F.round(F.when(F.min("known") == F.max("calls"), F.avg("amount")), 4).alias("mean_if_all_known"),
    )


Q["order_rollup"] = (order_rollup, """
  WITH p AS (SELECT l_orderkey, count(*) AS calls, count(k) AS known, sum(k) AS amount FROM (SELECT l_orderkey, CASE WHEN l_tax > 0.01 THEN l_extendedprice * (1 - l_discount) END AS k FROM lineitem) GROUP BY 1)
  SELECT CASE WHEN known = 0 THEN 'unknown' WHEN known < calls THEN 'partial' ELSE 'complete' END AS status, count(*) AS runs, sum(calls)::BIGINT AS calls, round(sum(amount), 2) AS amount, round(avg(amount), 4) AS mean_known,
  round(CASE WHEN min(known) = max(calls) THEN avg(amount) END, 4) AS mean_if_all_known FROM p GROUP BY 1""")


def prefix_budget(s, d):
    links = t(s, d, "links").select("email_id", "link_id", "raw_value").distinct()
    kept = sequences.prefix_budget(links, ["email_id"], ["link_id"], F.length("raw_value"), 200)
    return kept.select("email_id", "link_id", "running", "truncated")


Q["prefix_budget"] = (prefix_budget, """
  WITH l AS (SELECT DISTINCT email_id, link_id, raw_value FROM links), r AS (SELECT email_id, link_id, sum(coalesce(length(raw_value), 0)) OVER (PARTITION BY email_id ORDER BY link_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM l)
  SELECT email_id, link_id, running, truncated FROM (SELECT *, max(running) OVER (PARTITION BY email_id) > 200 AS truncated FROM r) WHERE running <= 200""")


def truncating_budget(s, d):
    parts = t(s, d, "text_parts").select("email_id", "part_key", "text").distinct()
    kept = sequences.truncating_budget(parts, ["email_id"], ["part_key"], "text", 900)
    return kept.select("email_id", "part_key", "kept_chars", F.sha2("text", 256).alias("print"))


Q["truncating_budget"] = (truncating_budget, """
  WITH p AS (SELECT DISTINCT email_id, part_key, text FROM text_parts),
  r AS (SELECT *, greatest(0, 900 - (sum(length(coalesce(text, ''))) OVER (PARTITION BY email_id ORDER BY part_key ROWS UNBOUNDED PRECEDING) - length(coalesce(text, '')))) AS remain FROM p),
  k AS (SELECT *, least(length(coalesce(text, '')), remain)::BIGINT AS kept_chars FROM r)
  SELECT email_id, part_key, kept_chars, sha256(substring(text, 1, kept_chars)) AS print FROM k WHERE kept_chars > 0""")


def greedy_budget(s, d):
    links = t(s, d, "links").select("email_id", "link_id", F.length("raw_value").alias("n")).distinct()
    g = sequences.greedy_budget(links, ["email_id"], ["link_id"], "link_id", "n", 150)
    return g.select("email_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "used")


Q["greedy_budget"] = (greedy_budget, """
  WITH RECURSIVE l AS (SELECT email_id, link_id, coalesce(length(raw_value), 0) AS n, row_number() OVER (PARTITION BY email_id ORDER BY link_id) AS r FROM (SELECT DISTINCT email_id, link_id, raw_value FROM links)),
  w AS (SELECT email_id, r, CASE WHEN n <= 150 THEN n ELSE 0 END AS used, CASE WHEN n <= 150 THEN [link_id] ELSE [] END AS kept FROM l WHERE r = 1
    UNION ALL SELECT l.email_id, l.r, CASE WHEN used + n <= 150 THEN used + n ELSE used END, CASE WHEN used + n <= 150 THEN list_append(kept, link_id) ELSE kept END FROM w JOIN l ON l.email_id IS NOT DISTINCT FROM w.email_id AND l.r = w.r + 1)
  SELECT email_id, array_to_string(arg_max(kept, r), ',') AS kept, arg_max(used, r)::BIGINT AS used FROM w GROUP BY email_id""")


def call_outcomes(s, d):
    r = t(s, d, "tool_results").select("result_id", "email_id", "tool", "query_observable_id").distinct().where("email_id is not null")
    b = sequences.call_budget(r, "email_id", ["result_id"], ["tool", "query_observable_id"], F.col("tool") == "urlscan", 4, 1)
    return b.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("result_id").alias("ids"))


Q["call_outcomes"] = (call_outcomes, None)


def sliding_rate(s, d):
    e = t(s, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    c = sequences.sliding_count(e, "event_type", "ts", 600, "within")
    return c.select("event_id", "within", (F.col("within") > 4).alias("over_limit"))


Q["sliding_rate"] = (sliding_rate, """
  SELECT event_id, within, within > 4 AS over_limit FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS within FROM events)""")


def daily_quota(s, d):
    e = t(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    c = sequences.daily_count(e, "user_id", "ts", ["event_id"], "of_day")
    return c.groupBy("user_id").agg(F.max("of_day").cast("long").alias("busiest"), F.count_if(F.col("of_day") > 2).alias("beyond"))


Q["daily_quota"] = (daily_quota, """
  SELECT user_id, max(n) AS busiest, count(*) FILTER (WHERE n > 2) AS beyond FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id""")


def failure_streaks(s, d):
    e = t(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    f = sequences.failure_streaks(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "streak")
    return f.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") >= 2).alias("in_row"))


Q["failure_streaks"] = (failure_streaks, """
  WITH a AS (SELECT *, (event_type = 'error')::INT AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events),
  b AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM a)
  SELECT user_id, max(s) AS longest, count(*) FILTER (WHERE s >= 2) AS in_row FROM b GROUP BY user_id""")


def elapsed(s, d):
    e = t(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sequences.elapsed_ms(e, "user_id", "ts", "t_ms").select("event_id", F.round("t_ms", 3).alias("t_ms"))


Q["elapsed"] = (elapsed, "SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000, 3) AS t_ms FROM events")


def guarded_labels(s, d):
    m = t(s, d, "corpus_manifest").select("sample_id", "raw_sha256").distinct().withColumnRenamed("raw_sha256", "hash")
    c = t(s, d, "rag_source_cases").select(F.col("record_sha256").alias("hash"), "validated_label").where("hash is not null")
    c = c.groupBy("hash").agg(F.min("validated_label").alias("validated_label"))
    _, bad = splits.guarded_join(m.select("hash").where("hash is not null").distinct().withColumn("one", F.lit(1)), c.withColumn("one", F.lit(1)), "hash", ["one"])
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


Q["guarded_labels"] = (guarded_labels, """
  WITH m AS (SELECT DISTINCT raw_sha256 AS h FROM corpus_manifest WHERE raw_sha256 IS NOT NULL), c AS (SELECT DISTINCT record_sha256 AS h FROM rag_source_cases WHERE record_sha256 IS NOT NULL)
  SELECT CASE WHEN c.h IS NULL THEN 'missing_right' ELSE 'missing_left' END AS problem, count(*) AS n FROM m FULL OUTER JOIN c ON m.h = c.h WHERE m.h IS NULL OR c.h IS NULL GROUP BY 1""")


def uncased_samples(s, d):
    m = t(s, d, "corpus_manifest").select("sample_id", "campaign_id", F.col("raw_sha256").alias("hash")).distinct()
    taken = t(s, d, "rag_source_cases").select("campaign_id", F.col("record_sha256").alias("hash"))
    return splits.complement(m, taken, ["hash", "campaign_id"]).select("sample_id")


Q["uncased_samples"] = (uncased_samples, """
  SELECT DISTINCT sample_id FROM corpus_manifest m WHERE NOT EXISTS (SELECT 1 FROM rag_source_cases c WHERE c.record_sha256 = m.raw_sha256)
   AND NOT EXISTS (SELECT 1 FROM rag_source_cases c WHERE c.campaign_id = m.campaign_id)""")


def stratified_split(s, d):
    m = t(s, d, "corpus_manifest").select("sample_id", "source_dataset", "normalized_label").distinct()
    return splits.stratified_select(m, "source_dataset", "sample_id", "normalized_label", {x: 10 for x in metrics.LABELS}).withColumn("rank", F.col("rank").cast("long"))


Q["stratified_split"] = (stratified_split, f"""
  WITH o AS (SELECT normalized_label, source_dataset, min(sample_id) AS sample_id FROM corpus_manifest WHERE normalized_label IN {_TAX} GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY normalized_label ORDER BY sha256(concat_ws('|', '42', source_dataset)), source_dataset) AS rank FROM o),
  k AS (SELECT * FROM r WHERE rank <= 10)
  SELECT normalized_label, source_dataset, sample_id, rank, CASE WHEN rank <= count(*) OVER (PARTITION BY normalized_label) // 2 THEN 'dev' ELSE 'test' END AS split FROM k""")


def split_leaks(s, d):
    c = t(s, d, "rag_source_cases").select("family_group", F.lower(F.trim("split")).alias("split"))
    return splits.shared_values(c.where("split is not null"), "family_group", "split")


Q["split_leaks"] = (split_leaks, """
  SELECT family_group, count(DISTINCT lower(trim(split))) AS sides FROM rag_source_cases WHERE split IS NOT NULL AND family_group IS NOT NULL GROUP BY 1 HAVING sides > 1""")


def label_deficits(s, d):
    c = t(s, d, "rag_source_cases").select("case_no", "validated_label").distinct()
    return splits.deficits(c, "validated_label", {x: 60 for x in metrics.LABELS})


Q["label_deficits"] = (label_deficits, """
  WITH c AS (SELECT validated_label AS l, count(*) AS n FROM (SELECT DISTINCT case_no, validated_label FROM rag_source_cases) GROUP BY 1)
  SELECT x AS validated_label, 60::BIGINT AS target, coalesce(n, 0) AS actual, greatest(0, 60 - coalesce(n, 0))::BIGINT AS deficit
  FROM (SELECT unnest(['spear_phishing','phishing','fraude','menace','spam','legitime']) AS x) LEFT JOIN c ON l = x""")


def smoke_sample(s, d):
    return splits.first_per_label(t(s, d, "corpus_manifest").select("sample_id", "normalized_label").distinct(), "normalized_label", "sample_id")


Q["smoke_sample"] = (smoke_sample, "SELECT normalized_label, min(sample_id) AS sample_id, count(DISTINCT sample_id) AS support FROM corpus_manifest WHERE normalized_label IS NOT NULL GROUP BY 1")


def seal_counts(s, d):
    m = t(s, d, "corpus_manifest").select("sample_id", "raw_sha256", "normalized_label").distinct()
    return splits.seal(m, ["sample_id", "raw_sha256", "normalized_label"], "sample_id").select("rows", "digest")


Q["seal_counts"] = (seal_counts, """
  WITH r AS (SELECT sha256(to_json({sample_id: sample_id, raw_sha256: raw_sha256, normalized_label: normalized_label})::VARCHAR) AS h FROM (SELECT DISTINCT sample_id, raw_sha256, normalized_label FROM corpus_manifest)),
  b AS (SELECT substr(h, 1, 3) AS b, count(*) AS n, sum(('0x' || substr(h, 4, 12))::BIGINT)::HUGEINT AS s FROM r GROUP BY 1), x AS (SELECT n, b || ':' || n || ':' || s AS x FROM b)
  SELECT coalesce(sum(n), 0)::BIGINT AS rows, sha256(string_agg(x, ',' ORDER BY x)) AS digest FROM x""")


def exact_dup_groups(s, d):
    return families.exact_groups(t(s, d, "documents"), "doc_id", tx.squash(F.col("text"))).select("hash", "size", "first")


_SQ = SQUASH.format("text")
Q["exact_dup_groups"] = (exact_dup_groups, f"SELECT sha256({_SQ}) AS hash, count(*) AS size, min(doc_id) AS first FROM documents WHERE {_SQ} <> '' GROUP BY 1 HAVING count(*) > 1")

_RUNS = f"""w AS (SELECT doc_id, string_split({_SQ}, ' ') AS w FROM documents WHERE text IS NOT NULL),
  g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS r FROM w WHERE len(w) >= 5)"""


def run_frequencies(s, d):
    f = families.run_frequencies(t(s, d, "documents"), "doc_id", F.col("text"))
    return f.groupBy(F.least("df", F.lit(40)).alias("df")).agg(F.count(F.lit(1)).alias("runs"))


Q["run_frequencies"] = (run_frequencies, f"WITH {_RUNS}, f AS (SELECT r, count(*) AS df FROM g GROUP BY r) SELECT least(df, 40) AS df, count(*) AS runs FROM f GROUP BY 1")


def near_dup_pairs(s, d):
    return families.near_pairs(t(s, d, "documents"), "doc_id", F.col("text")).select("a", "b", F.round("similarity", 6).alias("similarity"))


_PAIRS = f"""{_RUNS}, f AS (SELECT r FROM g GROUP BY r HAVING count(*) BETWEEN 2 AND 32), k AS (SELECT g.* FROM g JOIN f USING (r)),
  c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y ON x.r = y.r AND x.doc_id < y.doc_id),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  i AS (SELECT a, b, (SELECT count(*) FROM g x JOIN g y ON x.r = y.r WHERE x.doc_id = a AND y.doc_id = b) AS shared_n FROM c),
  pairs AS (SELECT a, b, shared_n / (na.n + nb.n - shared_n) AS sim FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared_n / (na.n + nb.n - shared_n) >= 0.85)"""
Q["near_dup_pairs"] = (near_dup_pairs, f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM pairs")


def family_components(s, d):
    return families.families(t(s, d, "documents"), "doc_id", F.col("text"))


_FAM = f"""WITH RECURSIVE {_PAIRS}, h AS (SELECT doc_id, sha256({_SQ}) AS h FROM documents WHERE {_SQ} <> ''),
  e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.h = y.h AND x.doc_id <> y.doc_id UNION SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach AS (SELECT doc_id AS n, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n),
  fam AS (SELECT n AS doc_id, min(r) AS family FROM reach GROUP BY n)"""
Q["family_components"] = (family_components, _FAM + " SELECT doc_id, family, count(*) OVER (PARTITION BY family) AS family_size FROM fam")


def family_stats(s, d):
    docs = t(s, d, "documents")
    return families.family_stats(families.families(docs, "doc_id", F.col("text")).join(docs.select("doc_id", "source"), "doc_id"), "family", "source")


Q["family_stats"] = (family_stats, _FAM + """, p AS (SELECT family, count(*) AS n, count(DISTINCT source) AS s FROM fam JOIN documents USING (doc_id) GROUP BY family)
  SELECT count(*) AS families, count(*) FILTER (WHERE n > 1) AS multi_member, max(n) AS largest, count(*) FILTER (WHERE s > 1) AS across_datasets FROM p""")


def nearest_cases(s, d):
    e = t(s, d, "embeddings")
    got = retrieval.nearest_per_family(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", "label", 3, 0.95)
    return got.select(F.col("query").alias("query_id"), "vec_id", F.col("label").cast("long").alias("label"), "distance", F.col("rank").cast("long").alias("rank"))


Q["nearest_cases"] = (nearest_cases, """
  WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
  c AS (SELECT query_id, vec_id, label, round(1 - list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS distance FROM q, embeddings e WHERE e.vec_id <> query_id AND e.label IS DISTINCT FROM ql),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS r FROM c WHERE distance <= 0.95),
  k AS (SELECT query_id, vec_id, label, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM o WHERE r = 1)
  SELECT query_id, vec_id, label::BIGINT AS label, distance, rank FROM k WHERE rank <= 3""")


def isolated_cases(s, d):
    c = t(s, d, "rag_source_cases").select("case_no", "family_group", "duplicate_group", "campaign_id", "split").distinct()
    test = c.where(F.lower(F.trim("split")) == "test")
    return retrieval.exclude(c.where(F.lower(F.trim("split")) == "train"), test, ["family_group", "duplicate_group", "campaign_id"]).select("case_no")


Q["isolated_cases"] = (isolated_cases, """
  WITH x AS (SELECT * FROM rag_source_cases WHERE lower(trim(split)) = 'test')
  SELECT DISTINCT case_no FROM rag_source_cases c WHERE lower(trim(split)) = 'train' AND NOT EXISTS (SELECT 1 FROM x WHERE x.family_group = c.family_group)
   AND NOT EXISTS (SELECT 1 FROM x WHERE x.duplicate_group = c.duplicate_group) AND NOT EXISTS (SELECT 1 FROM x WHERE x.campaign_id = c.campaign_id)""")


def probability_vectors(s, d):
    """Vectors made from document hashes: validity, verdict, confidence and margin."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    part = [F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("double") for i in range(6)]
    total = part[0] + part[1] + part[2] + part[3] + part[4] + part[5]
    names = [f"p_{x}" for x in metrics.LABELS]
    rows = t(s, d, "documents").select("doc_id", *(F.round(p / total, 6).alias(n) for p, n in zip(part, names, strict=True)))
    label, top, margin = metrics.verdict(names)
    return rows.select("doc_id", metrics.vector_ok(names).alias("valid"), label.alias("verdict"), F.round(top, 6).alias("confidence"), F.round(margin, 6).alias("margin"))


_P = ", ".join(f"('0x' || sha256(doc_id::VARCHAR)[{4 * i + 1}:{4 * i + 4}])::BIGINT::DOUBLE AS a{i}" for i in range(6))
_PN = ", ".join(f"round(a{i} / (a0 + a1 + a2 + a3 + a4 + a5), 6) AS p{i}" for i in range(6))
_WHEN = " ".join(f"WHEN p{i} = m THEN '{x}'" for i, x in enumerate(metrics.LABELS))
Q["probability_vectors"] = (probability_vectors, f"""
  WITH a AS (SELECT doc_id, {_P} FROM documents), p AS (SELECT doc_id, {_PN} FROM a),
  m AS (SELECT *, greatest(p0, p1, p2, p3, p4, p5) AS m, list_reverse_sort([p0, p1, p2, p3, p4, p5]) AS o FROM p)
  SELECT doc_id, abs(p0 + p1 + p2 + p3 + p4 + p5 - 1) <= 1e-6 AS valid, CASE {_WHEN} END AS verdict, round(m, 6) AS confidence, round(o[1] - o[2], 6) AS margin FROM m""")


def admissions(s, d):
    from caseloom.streaming.quotas import admission_batch

    e = t(s, d, "events").select(F.col("event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return admission_batch(e, 3, 600, 200).groupBy("key", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


Q["admissions"] = (admissions, None)


def dom_parts(s, d):
    from caseloom.operators.payloads import dom_facts

    rich = t(s, d, "text_parts").where("mime_type = 'text/html'").select("part_key", "text").distinct()
    f = dom_facts(rich, "part_key", "text")
    return f.select("part_key", F.length("visible_text").cast("long").alias("chars"), F.size("form_fields").cast("long").alias("fields"), F.length("title").cast("long").alias("title_chars"))


Q["dom_parts"] = (dom_parts, None)


_PRICES = (0.25, 0.05, 2.20)


def _calls(s, d):
    """Model calls made of order lines: tokens from quantities and prices, some counts missing, some costs reported."""
    li = t(s, d, "lineitem")
    i, o = F.col("l_extendedprice").cast("bigint"), F.when(F.col("l_linenumber") != 5, F.col("l_quantity").cast("bigint"))
    cached = F.col("l_partkey") - 500
    reported = F.when(F.col("l_linenumber") == 3, F.col("l_tax").cast("double"))
    cost, source = metrics.call_cost(i, cached, o, reported, _PRICES)
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", cost.alias("cost"), source.alias("source"))


_CALLS = """c AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount, trunc(l_extendedprice::DOUBLE)::BIGINT AS i, CASE WHEN l_linenumber <> 5 THEN trunc(l_quantity::DOUBLE)::BIGINT END AS o, l_partkey - 500 AS h,
    CASE WHEN l_linenumber = 3 THEN l_tax::DOUBLE END AS r FROM lineitem),
  e AS (SELECT *, least(greatest(h, 0), i) AS k FROM c),
  calls AS (SELECT *, coalesce(r, ((i - k) * 0.25::DOUBLE + k * 0.05::DOUBLE + o * 2.2::DOUBLE) / 1000000) AS cost, CASE WHEN r IS NOT NULL THEN 'provider_reported' WHEN o IS NOT NULL THEN 'estimated' ELSE 'unknown' END AS source FROM e)"""
_RUNS_COST = _CALLS + """, runs AS (SELECT l_orderkey, count(*) AS calls, count(cost) AS known, round(sum(cost), 8) AS amount,
    CASE WHEN count(cost) = 0 THEN 'unknown' WHEN count(cost) < count(*) THEN 'partial' WHEN count(*) FILTER (WHERE source = 'provider_reported') = count(*) THEN 'provider_reported' ELSE 'estimated' END AS status FROM calls GROUP BY 1)"""


def call_costs(s, d):
    return _calls(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


Q["call_costs"] = (call_costs, f"WITH {_CALLS} SELECT source, count(*) AS calls, round(sum(cost), 4) AS cost FROM calls GROUP BY 1")


def run_costs(s, d):
    r = metrics.run_costs(_calls(s, d), "l_orderkey", "cost", "source")
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.sum("calls").alias("calls"), F.sum("known").alias("known"), F.round(F.sum("amount"), 3).alias("amount"))


Q["run_costs"] = (run_costs, f"WITH {_RUNS_COST} SELECT status, count(*) AS runs, sum(calls)::BIGINT AS calls, sum(known)::BIGINT AS known, round(sum(amount), 3) AS amount FROM runs GROUP BY 1")


def cost_total(s, d):
    x = metrics.cost_total(metrics.run_costs(_calls(s, d), "l_orderkey", "cost", "source"))
    return x.select("runs", "with_amount", F.round("amount", 3).alias("amount"), F.round("mean_known", 6).alias("mean_known"), "mean_all", "status")


Q["cost_total"] = (cost_total, f"WITH {_RUNS_COST} " + """SELECT count(*) AS runs, count(amount) AS with_amount, round(sum(amount), 3) AS amount, round(avg(amount), 6) AS mean_known,
  CASE WHEN count(*) FILTER (WHERE status IN ('unknown', 'partial')) = 0 THEN round(sum(amount) / count(*), 8) END AS mean_all,
  CASE WHEN count(amount) = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE status IN ('unknown', 'partial')) = 0 THEN 'complete' ELSE 'partial' END AS status FROM runs""")


def phase_validity(s, d):
    """Order lines as calls of a phase (the rest of the part by 4): the last one of an order and phase decides."""
    c = t(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus").alias("at"), (F.col("l_partkey") % 4).alias("phase"), (F.col("l_linestatus") == "F").alias("valid"), (F.col("l_discount") > 0.05).alias("retry"), F.when(F.col("l_returnflag") == "R", "refused").alias("error"))
    return metrics.phase_validity(c, "l_orderkey", "phase", "at", "valid", "retry", "error")


Q["phase_validity"] = (phase_validity, """
  WITH l AS (SELECT l_orderkey, l_partkey % 4 AS phase, arg_max(l_linestatus = 'F', row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus)) AS ok, count(*) AS calls, count(*) FILTER (WHERE l_discount > 0.05) AS retries, count(*) FILTER (WHERE l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1, 2)
  SELECT phase, count(*) AS runs, count(*) FILTER (WHERE ok) AS valid_runs, round(count(*) FILTER (WHERE ok) / count(*), 6) AS validity, sum(calls)::BIGINT AS calls, sum(retries)::BIGINT AS retries, sum(errors)::BIGINT AS errors FROM l GROUP BY 1""")


def proposal_counts(s, d):
    """Defects of a message as its proposals, its content limits as those refused."""
    m = t(s, d, "parsed_emails").select("email_id", "defects", "content_limits").dropDuplicates(["email_id"])
    return metrics.proposal_counts(m, "email_id", "defects", "content_limits")


Q["proposal_counts"] = (proposal_counts, """
  WITH m AS (SELECT DISTINCT email_id, coalesce(len(defects), 0) AS p, coalesce(len(content_limits), 0) AS i FROM parsed_emails)
  SELECT sum(p)::BIGINT AS proposals, sum(i)::BIGINT AS invalid, count(*) FILTER (WHERE p > 0) AS records_with_any, round(sum(i) / nullif(sum(p), 0), 6) AS invalid_rate FROM m""")


def action_coverage(s, d):
    """Actions by a rule on the message's flags, against the labels."""
    m = _labelled(s, d).withColumn("action", F.when(F.col("guess").isNull(), "review").when(F.col("guess") == "legitime", "deliver").otherwise("hold"))
    return metrics.action_coverage(m, "action", "normalized_label")


Q["action_coverage"] = (action_coverage, "WITH " + _LAB + """, a AS (SELECT CASE WHEN p IS NULL THEN 'review' WHEN p = 'legitime' THEN 'deliver' ELSE 'hold' END AS action, t FROM l)
  SELECT action, count(*) AS rows_n, """ + ", ".join(f"count(*) FILTER (WHERE t = '{x}') AS on_{x}" for x in metrics.LABELS) + f""", count(*) FILTER (WHERE t IS NULL OR t NOT IN {_TAX}) AS unlabelled,
  round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY action""")


def usage_totals(s, d):
    r = t(s, d, "tool_results").select("result_id", "tool", "mode", "requests_sent", (F.col("response_ref").isNotNull()).alias("response"), (F.col("status") == "ok").alias("ok")).distinct()
    return metrics.usage_totals(r, ["tool", "mode"], ["response", "ok"], ["requests_sent"]).withColumn("level", F.col("level").cast("long"))


Q["usage_totals"] = (usage_totals, """
  WITH r AS (SELECT DISTINCT result_id, tool, mode, requests_sent, response_ref IS NOT NULL AS response, status = 'ok' AS ok FROM tool_results)
  SELECT tool, mode, count(*) AS rows_n, count(*) FILTER (WHERE response) AS with_response, count(*) FILTER (WHERE ok) AS with_ok, sum(requests_sent)::BIGINT AS sum_requests_sent,
   count(*) FILTER (WHERE requests_sent IS NULL) AS unknown_requests_sent, grouping(tool, mode)::BIGINT AS level FROM r GROUP BY ROLLUP (tool, mode)""")


def issue_counts(s, d):
    """Decode defects of text parts as issues; those that name a charset weigh more."""
    p = t(s, d, "text_parts").select("part_key", "decode_defects").dropDuplicates(["part_key"]).select(F.explode("decode_defects").alias("x"))
    i = p.select(F.substring_index("x", ":", 1).alias("code"), F.when(F.lower("x").contains("charset"), "critical").otherwise("minor").alias("severity"))
    return metrics.issue_counts(i, "code", "severity", "critical")


Q["issue_counts"] = (issue_counts, """
  WITH p AS (SELECT part_key, any_value(decode_defects) AS d FROM (SELECT DISTINCT part_key, decode_defects FROM text_parts) GROUP BY 1), x AS (SELECT unnest(d) AS x FROM p)
  SELECT split_part(x, ':', 1) AS code, count(*) AS n FROM x WHERE contains(lower(x), 'charset') GROUP BY 1""")


def variant_block(s, d):
    """Three variants of a run (the line's status letters): means over valid lines that are not excluded."""
    li = t(s, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").alias("valid"), (F.col("l_tax") > 0.06).alias("excluded"), F.col("l_discount").cast("double").alias("cost"), F.col("l_quantity").cast("double").alias("latency"))
    return metrics.variant_block(li, "l_returnflag", "valid", "excluded", "cost", "latency")


Q["variant_block"] = (variant_block, """
  SELECT l_returnflag, count(*) AS rows_n, count(*) FILTER (WHERE l_linestatus = 'F' AND NOT l_tax > 0.06) AS used, count(*) FILTER (WHERE l_tax > 0.06) AS excluded_n,
   round(avg(l_discount::DOUBLE) FILTER (WHERE l_linestatus = 'F' AND NOT l_tax > 0.06), 6) AS mean_cost, round(avg(l_quantity::DOUBLE) FILTER (WHERE l_linestatus = 'F' AND NOT l_tax > 0.06), 6) AS mean_latency FROM lineitem GROUP BY 1""")


def limitations(s, d):
    lab = _labelled(s, d)
    synthetic = t(s, d, "corpus_manifest").select("sample_id", "is_synthetic").distinct()
    t1 = lab.agg(F.countDistinct(metrics.restricted(F.col("normalized_label"))).alias("supported"), F.count_if(F.col("guess").isNull()).alias("abstained"))
    t2 = synthetic.agg(F.count_if("is_synthetic").alias("synthetic"), F.lit(0).alias("unknown_cost"))
    names = ("supported", "abstained", "synthetic", "unknown_cost")
    facts = t1.unionByName(t2, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in names))
    return metrics.limitations(facts).withColumn("no", F.col("no").cast("long"))


Q["limitations"] = (limitations, "WITH " + _LAB + """, f AS (SELECT (SELECT count(DISTINCT t) FROM v) AS supported, (SELECT count(*) FROM l WHERE p IS NULL) AS abstained,
   (SELECT count(*) FROM (SELECT DISTINCT sample_id, is_synthetic FROM corpus_manifest) WHERE is_synthetic) AS synthetic)
  SELECT 0::BIGINT AS no, 'labels without support' AS limitation FROM f WHERE supported < 6 UNION ALL SELECT 2, 'some records were not judged' FROM f WHERE abstained > 0 UNION ALL SELECT 3, 'some records are synthetic' FROM f WHERE synthetic > 0""")


def window_counts(s, d):
    e = t(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


Q["window_counts"] = (window_counts, "SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
