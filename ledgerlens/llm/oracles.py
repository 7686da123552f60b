"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
m AS (
  SELECT rid, doc_id, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
         - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines
  FROM w),
g AS (
  SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS p FROM w)),
again AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
r AS (
  SELECT rid, count(DISTINCT p + k)::BIGINT AS n FROM again, range(0, 5) AS o(k) GROUP BY rid),
b AS (
  SELECT m.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         (n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words) AS base_failed
  FROM m LEFT JOIN r USING (rid)),
h AS (
  SELECT source, count(*)::BIGINT AS host_docs, sum(base_failed::INT)::BIGINT AS host_failed FROM b GROUP BY source),
mom AS (
  SELECT avg(host_failed / host_docs) AS m, var_pop(host_failed / host_docs) AS v, avg(host_docs) AS n FROM h),
pr AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN least(n, m * (1 - m) / v - 1) ELSE n END AS weight FROM mom),
hv AS (
  SELECT source, host_docs, host_failed,
         (host_failed + (SELECT m * weight FROM pr)) / (host_docs + (SELECT weight FROM pr)) <= 0.5 AS good FROM h)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
       NOT b.base_failed AND hv.good AS kept, hv.host_docs, hv.host_failed
FROM b JOIN hv ON b.source IS NOT DISTINCT FROM hv.source
"""

ORACLES = {"op2_quality_rules": _OP2}
