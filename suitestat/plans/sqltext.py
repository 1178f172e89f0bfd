"""Pieces of SQL that the twins of several queries share (DuckDB)."""

from __future__ import annotations

from suitestat.plans.views import ENDPOINTS, PARAMS, STEPS

#: Fixed value: CRUD class of a verb.
CRUD = "CASE upper({}) WHEN 'POST' THEN 'create' WHEN 'GET' THEN 'read' WHEN 'HEAD' THEN 'read' WHEN 'PUT' THEN 'update' WHEN 'PATCH' THEN 'update' WHEN 'DELETE' THEN 'delete' END"
OPS = "['create', 'read', 'update', 'delete']"
VERBS = "['GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE']"

SEG = f"""
steps AS ({STEPS}),
seg0 AS (SELECT *, last_value(CASE WHEN kind <> 'response-check' THEN kind END IGNORE NULLS) OVER (PARTITION BY test_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM steps),
seg1 AS (SELECT *, sum(CASE WHEN kind <> 'response-check' AND before_ = 'http-request' THEN 1 ELSE 0 END) OVER (PARTITION BY test_id ORDER BY pos) AS island FROM seg0),
seg2 AS (SELECT *, count(CASE WHEN kind = 'http-request' THEN 1 END) OVER (PARTITION BY test_id, island ORDER BY pos) AS asked, count(CASE WHEN kind = 'http-request' THEN 1 END) OVER (PARTITION BY test_id, island) AS requests FROM seg1),
seg AS (SELECT *, dense_rank() OVER (PARTITION BY test_id ORDER BY island) AS seq, regexp_replace(http_path, '/[0-9]+$', '/{{id}}') AS npath, {CRUD.format("http_method")} AS op FROM seg2 WHERE requests > 0 AND (kind <> 'response-check' OR asked > 0))"""

SEQS = SEG + f""",
seqs AS (SELECT project_id, test_id, seq, count(*) AS length,
  count(*) FILTER (kind = 'request-build') AS builds, count(*) FILTER (kind = 'http-request') AS requests, count(*) FILTER (kind = 'response-check') AS checks,
  count(*) FILTER (kind = 'response-check' AND assertion_role = 'status') AS status_checks, count(*) FILTER (kind = 'response-check' AND assertion_role = 'body') AS body_checks,
  count(*) FILTER (kind = 'response-check' AND assertion_role = 'header') AS header_checks,
  list_filter({OPS}, lambda x: list_contains(coalesce(list(op) FILTER (op IS NOT NULL), []), x)) AS operations,
  list_filter({VERBS}, lambda x: list_contains(coalesce(list(http_method) FILTER (http_method IS NOT NULL), []), x)) AS verbs,
  string_agg(CASE WHEN kind = 'response-check' THEN concat(kind, ':', coalesce(assertion_role, '*')) ELSE concat(kind, ':', coalesce(http_method, '*'), ':', coalesce(npath, '*')) END, '|' ORDER BY pos) AS fingerprint
  FROM seg GROUP BY project_id, test_id, seq)"""

RES = f"""
steps AS ({STEPS}),
rsteps AS (SELECT *, regexp_replace(http_path, '/[0-9]+$', '') AS resource_key, {CRUD.format("http_method")} AS op FROM steps WHERE kind = 'http-request'),
rseqs AS (SELECT project_id, test_id, resource_key, coalesce(string_agg(substr(op, 1, 1), '' ORDER BY pos) FILTER (op IS NOT NULL), '') AS ops, count(*) AS steps,
  list_filter({OPS}, lambda x: list_contains(coalesce(list(op) FILTER (op IS NOT NULL), []), x)) AS exercised,
  list_filter({VERBS}, lambda x: list_contains(coalesce(list(http_method), []), x)) AS verbs
  FROM rsteps GROUP BY project_id, test_id, resource_key)"""

ENDP = f"""
endpoints AS ({ENDPOINTS}),
avail AS (SELECT project_id, resource_key, count(*) AS endpoints, list_filter({OPS}, lambda x: list_contains(coalesce(list(op) FILTER (op IS NOT NULL), []), x)) AS available
  FROM (SELECT project_id, regexp_replace(path_template, '/[{{]id[}}]$', '') AS resource_key, CASE WHEN NOT is_method_wildcard THEN {CRUD.format("http_method")} END AS op FROM endpoints WHERE path_template <> '/**') t
  GROUP BY project_id, resource_key)"""

PAR = f"params AS ({PARAMS})"


def summary(x: str) -> str:
    """The eight summary columns."""
    q = lambda p: f"quantile_cont(CAST({x} AS DOUBLE), {p})"
    return f"count({x}) AS count, CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max, avg(CAST({x} AS DOUBLE)) AS mean, {q(0.25)} AS p25, {q(0.5)} AS p50, {q(0.75)} AS p75, {q(0.9)} AS p90"
