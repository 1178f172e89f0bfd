"""Queries on steps, sequences and resources."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitestat.operators import aggregates as A
from suitestat.operators import sequences as S
from suitestat.operators import stats_sequences as T
from suitestat.plans import views
from suitestat.plans.registry import query
from suitestat.plans.sqltext import OPS, RES, SEG, SEQS, VERBS, summary


def _seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment(views.steps(spark, sf_dir))


def _seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sequences(_seg(spark, sf_dir))


@query(f"WITH {SEG} SELECT project_id, test_id, event_id, pos, kind, CAST(seq AS BIGINT) AS seq FROM seg")
def seq_segmentation(spark, sf_dir):
    return _seg(spark, sf_dir).select("project_id", "test_id", "event_id", "pos", "kind", "seq")


@query(f"WITH {SEQS} SELECT project_id, test_id, seq, length, builds, requests, checks, status_checks, body_checks, header_checks, array_to_string(operations, ',') AS operations, array_to_string(verbs, ',') AS verbs, fingerprint FROM seqs")
def seq_sequences(spark, sf_dir):
    d = _seqs(spark, sf_dir).drop("resolved")
    return d.withColumn("operations", F.array_join("operations", ",")).withColumn("verbs", F.array_join("verbs", ","))


@query(f"""WITH {SEQS},
f AS (SELECT project_id, test_id, fingerprint, count(*) AS n, sum(length) AS steps FROM seqs GROUP BY ALL),
p AS (SELECT project_id, test_id, CAST(sum(n) AS BIGINT) AS sequences, count(*) AS fingerprints, count(*) FILTER (n > 1) AS repeated_fingerprints, CAST(sum(steps) AS BIGINT) AS steps FROM f GROUP BY ALL),
r AS (SELECT project_id, test_id, count(DISTINCT upper(http_method)) AS methods, count(DISTINCT regexp_replace(npath, '/[{{]id[}}]$', '')) AS resources,
  count(DISTINCT concat(http_method, ' ', npath)) AS endpoints, count(*) AS resolved_requests, count(*) AS requests FROM seg WHERE kind = 'http-request' GROUP BY ALL)
SELECT *, repeated_fingerprints > 0 AS has_repeated, resolved_requests > endpoints AS re_dispatches, resolved_requests = requests AS all_resolved FROM p JOIN r USING (project_id, test_id)""")
def seq_summary(spark, sf_dir):
    seg = _seg(spark, sf_dir)
    return S.sequence_summary(seg, S.sequences(seg))


@query(f"""WITH {SEQS}, p AS (SELECT DISTINCT project_id, test_id, fingerprint FROM seqs), n AS (SELECT project_id, fingerprint, count(*) AS n FROM p GROUP BY ALL)
SELECT project_id, test_id, bool_or(n > 1) AS shares_sequence FROM p JOIN n USING (project_id, fingerprint) GROUP BY ALL""")
def seq_shared_fingerprints(spark, sf_dir):
    return S.shared_fingerprints(_seqs(spark, sf_dir))


@query(f"""WITH {SEG}, w AS (SELECT *, count(CASE WHEN kind = 'request-build' THEN 1 END) OVER (PARTITION BY test_id, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fan_in,
  count(CASE WHEN kind = 'response-check' THEN 1 END) OVER (PARTITION BY test_id, seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fan_out FROM seg)
SELECT project_id, test_id, seq, pos, fan_in, fan_out FROM w WHERE kind = 'http-request'""")
def prj_dispatch_fan(spark, sf_dir):
    return S.fan(_seg(spark, sf_dir))


@query(f"""WITH {RES} SELECT project_id, test_id, resource_key, ops, steps, array_to_string(exercised, ',') AS exercised, array_to_string(verbs, ',') AS verbs,
  regexp_matches(ops, '[cud].*r') AS read_after_write, regexp_matches(ops, 'c.*d') AS cleanup_delete,
  CASE WHEN ops = '' THEN 'other' WHEN len(exercised) = 4 THEN 'full-crud' WHEN exercised = ['read'] THEN 'read-only' WHEN exercised = ['create'] THEN 'create-and-trust'
    WHEN exercised = ['create', 'read', 'update'] AND regexp_matches(ops, 'c.*u.*r') THEN 'create-update-verify'
    WHEN exercised = ['create', 'read', 'delete'] AND regexp_matches(ops, 'c.*r.*d') THEN 'create-verify-cleanup'
    WHEN exercised = ['create', 'read'] AND regexp_matches(ops, 'c.*r') THEN 'create-verify' WHEN exercised = ['read', 'delete'] AND regexp_matches(ops, 'd.*r') THEN 'delete-verify'
    WHEN NOT list_contains(exercised, 'read') THEN 'write-only' ELSE 'other' END AS lifecycle FROM rseqs""")
def seq_resource_lifecycle(spark, sf_dir):
    d = S.resource_sequences(S.resource_steps(views.steps(spark, sf_dir))).withColumn("lifecycle", S.lifecycle())
    return d.drop("method_resolved").withColumn("exercised", F.array_join("exercised", ",")).withColumn("verbs", F.array_join("verbs", ","))


_RANGE = "CASE WHEN status_code BETWEEN 100 AND 599 THEN concat(CAST(status_code // 100 AS VARCHAR), 'xx') ELSE 'unknown' END"


@query(f"""WITH {SEG}, c AS (SELECT *, {_RANGE} AS rng FROM steps WHERE kind = 'response-check')
SELECT project_id, test_id, count(*) FILTER (assertion_role = 'status') AS status_checks, count(*) FILTER (assertion_role = 'body') AS body_checks, count(*) FILTER (assertion_role = 'header') AS header_checks,
  {", ".join(f"count(*) FILTER (assertion_role = 'status' AND rng = '{r}') AS n_{r}" for r in ("1xx", "2xx", "3xx", "4xx", "5xx", "unknown"))},
  count(*) FILTER (assertion_role = 'status' AND rng = '4xx') > 0 AS asserts_4xx, count(*) FILTER (assertion_role = 'status' AND rng = '5xx') > 0 AS asserts_5xx FROM c GROUP BY ALL""")
def seq_failure_flags(spark, sf_dir):
    return S.failure_flags(views.steps(spark, sf_dir))


@query(f"WITH {SEG} SELECT project_id, status_code, count(*) AS n FROM steps WHERE kind = 'response-check' AND assertion_role = 'status' AND status_code IS NOT NULL GROUP BY ALL")
def seq_status_codes(spark, sf_dir):
    return S.status_codes(views.steps(spark, sf_dir), "project_id")


@query(f"WITH {SEG} SELECT test_id, pos, CASE kind WHEN 'http-request' THEN 'request' WHEN 'request-build' THEN 'builder' ELSE 'verification' END AS view FROM steps WHERE kind <> 'response-check' OR assertion_role IN ('status', 'body', 'header')")
def seq_interactions(spark, sf_dir):
    return S.interactions(views.steps(spark, sf_dir)).select("test_id", "pos", "view")


# ---- shared aggregates


@query(f"WITH {SEQS} SELECT project_id, {summary('length')} FROM seqs GROUP BY project_id")
def agg_summary(spark, sf_dir):
    return A.summarize(_seqs(spark, sf_dir), "length", "project_id")


@query(f"WITH {SEQS} SELECT count(*) FILTER (checks = 0) AS true_count, count(*) AS total, CAST(count(*) FILTER (checks = 0) AS DOUBLE) / count(*) AS proportion FROM seqs")
def agg_share(spark, sf_dir):
    return _seqs(spark, sf_dir).agg(*A.share(F.col("checks") == 0))


def _top(value: str, source: str, percents: str, cond: str = "") -> str:
    return f"""r AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value} DESC) AS rn, count(*) OVER () AS n, sum({value}) OVER () AS t FROM {source} {cond}),
c AS (SELECT p AS percent, v, rn, n, t, greatest(1, CAST(ceil(n * p / 100.0) AS BIGINT)) AS k FROM r, unnest({percents}) AS u(p))"""


@query(f"WITH {SEQS}, {_top('checks', 'seqs', '[1, 5, 10, 25]')} SELECT percent, max(n) AS item_count, CAST(max(t) AS BIGINT) AS total, max(k) AS top_count, CAST(sum(v) FILTER (rn <= k) AS DOUBLE) / max(t) AS share_of_total FROM c GROUP BY percent")
def agg_concentration(spark, sf_dir):
    return A.concentration(_seqs(spark, sf_dir), "checks")


@query(f"WITH {SEQS}, {_top('status_checks', 'seqs', '[10]', 'WHERE status_checks > 0')} SELECT percent, max(n) AS item_count, CAST(max(t) AS BIGINT) AS total, max(k) AS top_count, CAST(sum(v) FILTER (rn <= k) AS DOUBLE) / max(t) AS share_of_total, CAST(sum(v) FILTER (rn <= k) AS DOUBLE) / max(t) / (CAST(max(k) AS DOUBLE) / max(n)) AS evenness_ratio FROM c GROUP BY percent")
def agg_evenness(spark, sf_dir):
    return A.evenness(_seqs(spark, sf_dir).filter("status_checks > 0"), "status_checks")


_LABELS = ", ".join(f"('{x}')" for x in A.subsets())


@query(f"""WITH {RES}, c AS (SELECT CASE WHEN len(exercised) = 1 THEN concat(exercised[1], '-only') ELSE array_to_string(exercised, '-') END AS combination FROM rseqs WHERE len(exercised) > 0)
SELECT d.combination, count(c.combination) AS n, (SELECT count(*) FROM c) AS total, CAST(count(c.combination) AS DOUBLE) / (SELECT count(*) FROM c) AS proportion
FROM (VALUES {_LABELS}) AS d(combination) LEFT JOIN c USING (combination) GROUP BY d.combination""")
def agg_crud_combinations(spark, sf_dir):
    return A.combination_table(S.resource_sequences(S.resource_steps(views.steps(spark, sf_dir))), "exercised")


@query(f"""WITH {SEG}, c AS (SELECT http_method AS method, count(*) AS n FROM steps WHERE kind = 'http-request' GROUP BY ALL)
SELECT coalesce(d.method, c.method) AS method, coalesce(n, 0) AS n, CAST(coalesce(rank, 4) AS INT) AS rank FROM (VALUES (0, 'GET'), (1, 'POST'), (2, 'TRACE'), (3, 'DELETE')) AS d(rank, method) FULL JOIN c USING (method)""")
def agg_observed_and_canonical(spark, sf_dir):
    counts = views.steps(spark, sf_dir).filter("kind = 'http-request'").groupBy(F.col("http_method").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return A.observed_and_canonical(counts, "method", ["GET", "POST", "TRACE", "DELETE"])


# ---- statistics on sequences

_PAIRS = SEQS + """,
pairs AS (SELECT CASE WHEN len({0}) = 1 THEN {0}[1] END AS source, lead(CASE WHEN len({0}) = 1 THEN {0}[1] ELSE '' END) OVER (PARTITION BY test_id ORDER BY seq) AS target FROM seqs),
mapped AS (SELECT source, target FROM pairs WHERE source IS NOT NULL AND target IS NOT NULL AND target <> ''),
total AS (SELECT count(*) AS n FROM mapped)"""


@query(f"""WITH {_PAIRS.replace("{0}", "operations")},
d AS (SELECT a AS source, b AS target FROM unnest({OPS}) AS x(a), unnest({OPS}) AS y(b))
SELECT d.source, d.target, count(m.source) AS n, (SELECT n FROM total) AS total, CAST(count(m.source) AS DOUBLE) / (SELECT n FROM total) AS proportion FROM d LEFT JOIN mapped m ON d.source = m.source AND d.target = m.target GROUP BY d.source, d.target""")
def st1_crud_transitions(spark, sf_dir):
    return T.transitions(_seqs(spark, sf_dir), "operations", A.CRUD)


@query(f"""WITH {_PAIRS.replace("{0}", "verbs")},
d AS (SELECT a AS source, b AS target FROM unnest({VERBS}) AS x(a), unnest({VERBS}) AS y(b))
SELECT d.source, d.target, count(m.source) AS n, (SELECT n FROM total) AS total, CAST(count(m.source) AS DOUBLE) / (SELECT n FROM total) AS proportion FROM d LEFT JOIN mapped m ON d.source = m.source AND d.target = m.target GROUP BY d.source, d.target""")
def st1_verb_transitions(spark, sf_dir):
    return T.transitions(_seqs(spark, sf_dir), "verbs", A.VERBS)


@query(f"""WITH {_PAIRS.replace("{0}", "operations")},
m AS (SELECT x.op, (SELECT count(*) FROM mapped WHERE source = x.op) AS s, (SELECT count(*) FROM mapped WHERE target = x.op) AS t, (SELECT count(*) FROM mapped WHERE source = x.op AND target = x.op) AS r, (SELECT n FROM total) AS n FROM unnest({OPS}) AS x(op))
SELECT op AS operation, CAST(s AS DOUBLE) / n AS source_share, CAST(t AS DOUBLE) / n AS target_share, CASE WHEN s > 0 THEN CAST(r AS DOUBLE) / s END AS self_repeat_given_source, CASE WHEN s * t > 0 THEN CAST(r * n AS DOUBLE) / (s * t) END AS lift FROM m
UNION ALL SELECT 'all', NULL, CAST(sum(s * t) AS DOUBLE) / max(n * n), CAST(sum(r) AS DOUBLE) / max(n), (CAST(sum(r) AS DOUBLE) / max(n)) / (CAST(sum(s * t) AS DOUBLE) / max(n * n)) FROM m""")
def st1_self_affinity(spark, sf_dir):
    return T.self_affinity(T.transitions(_seqs(spark, sf_dir), "operations", A.CRUD))


@query(f"""WITH {SEQS}, l AS (SELECT CASE WHEN builds > 0 AND checks > 0 THEN 'build-dispatch-verification' WHEN builds > 0 THEN 'build-dispatch-no-verification' WHEN checks = 0 THEN 'dispatch-only' ELSE 'dispatch-verification-no-build' END AS shape FROM seqs WHERE requests > 0)
SELECT d.shape, count(l.shape) AS n, 100.0 * count(l.shape) / (SELECT count(*) FROM l) AS percent FROM (VALUES ('build-dispatch-verification'), ('build-dispatch-no-verification'), ('dispatch-only'), ('dispatch-verification-no-build')) AS d(shape) LEFT JOIN l USING (shape) GROUP BY d.shape""")
def st1_sequence_shapes(spark, sf_dir):
    return T.shapes(_seqs(spark, sf_dir))


@query(f"""WITH {SEQS}, x AS (SELECT *, CASE WHEN len(operations) = 1 THEN operations[1] ELSE 'uncategorized' END AS operation,
  max(CASE WHEN list_contains(operations, 'read') THEN 1 ELSE 0 END) OVER (PARTITION BY test_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_read, lead(seq) OVER (PARTITION BY test_id ORDER BY seq) AS nxt FROM seqs),
u AS (SELECT * FROM x WHERE checks = 0)
SELECT d.op AS operation, count(u.operation) AS n, count(u.nxt) AS followed_by_sequence, count(*) FILTER (u.later_read = 1) AS followed_by_read, CASE WHEN count(u.operation) > 0 THEN CAST(count(u.nxt) AS DOUBLE) / count(u.operation) END AS sequence_share, CASE WHEN count(u.operation) > 0 THEN CAST(count(*) FILTER (u.later_read = 1) AS DOUBLE) / count(u.operation) END AS read_share
FROM unnest(['create', 'read', 'update', 'delete', 'uncategorized']) AS d(op) LEFT JOIN u ON u.operation = d.op GROUP BY d.op""")
def st1_unverified(spark, sf_dir):
    return T.unverified(_seqs(spark, sf_dir))


_TESTS = SEQS + """,
tests AS (SELECT project_id, test_id, count(*) AS sequences, count(DISTINCT fingerprint) < count(*) AS has_repeated FROM seqs GROUP BY ALL),
eps AS (SELECT project_id, test_id, count(DISTINCT concat(http_method, npath)) AS endpoints, count(*) AS asked FROM seg WHERE kind = 'http-request' GROUP BY ALL),
te AS (SELECT *, asked > endpoints AS re_dispatches FROM tests JOIN eps USING (project_id, test_id))"""


@query(f"""WITH {_TESTS}, m AS (SELECT *, row_number() OVER (ORDER BY sequences DESC, test_id) AS rn, count(*) OVER () AS n FROM te WHERE sequences > 1),
c AS (SELECT 'multi' AS cohort, * FROM m UNION ALL SELECT 'top_decile', * FROM m WHERE rn <= ceil(n * 0.1))
SELECT cohort, count(*) AS tests, avg(sequences) AS mean_sequences, avg(endpoints) AS mean_endpoints, avg(CAST(endpoints >= 2 AS INT)) AS share_multiple_endpoints, avg(CAST(re_dispatches AS INT)) AS share_re_dispatches, avg(CAST(has_repeated AS INT)) AS share_repeated FROM c GROUP BY cohort""")
def st1_multi_sequence(spark, sf_dir):
    seg = _seg(spark, sf_dir)
    return T.multi_sequence(S.sequence_summary(seg, S.sequences(seg)))


@query(f"""WITH {SEQS}, t AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY seq DESC) = 1 AS terminal, count(*) OVER (PARTITION BY test_id) AS n FROM seqs),
x AS (SELECT test_id, bool_or(terminal AND checks > 0) AS at_end, bool_or(NOT terminal AND checks > 0) AS inside FROM t WHERE n > 1 GROUP BY test_id),
l AS (SELECT CASE WHEN at_end AND inside THEN 'both' WHEN at_end THEN 'terminal-only' WHEN inside THEN 'interior-only' ELSE 'unverified' END AS placement FROM x)
SELECT placement, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM l) AS proportion FROM l GROUP BY placement""")
def st1_verification_placement(spark, sf_dir):
    return T.placement(_seqs(spark, sf_dir))


_ROLE = "unnest(['status', 'body', 'header']) AS u(role)"
_ROLES = SEQS + f""",
roles AS (SELECT project_id, test_id, seq, u.role, CASE u.role WHEN 'status' THEN status_checks WHEN 'body' THEN body_checks ELSE header_checks END AS n FROM seqs, {_ROLE})"""


@query(f"WITH {_ROLES}, k AS (SELECT count(*) AS t FROM seqs) SELECT role, count(*) AS bearing, CAST(count(*) AS DOUBLE) / any_value(t) AS bearing_share, avg(n) AS mean_checks, count(*) FILTER (n = 1) AS exactly_one, count(*) FILTER (n >= 2) AS two_or_more, count(*) FILTER (n > 3) AS more_than_three FROM roles, k WHERE n > 0 GROUP BY role")
def st1_checks_per_sequence(spark, sf_dir):
    return T.checks_per_sequence(_seqs(spark, sf_dir))


@query(f"""WITH {_ROLES}, t AS (SELECT role, test_id, sum(n) AS total, count(*) FILTER (n > 0) AS bearing, max(n) AS most FROM roles GROUP BY ALL HAVING sum(n) > 0),
c AS (SELECT *, CASE WHEN total = 1 THEN 'single-check' WHEN bearing = 1 THEN 'concentrated-blob' ELSE 'spread-across-sequences' END AS spread FROM t)
SELECT role, spread, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY role) AS proportion, avg(total) AS mean_checks, CAST(max(most) AS BIGINT) AS most FROM c GROUP BY role, spread""")
def st1_blob_or_spread(spark, sf_dir):
    return T.blob_or_spread(_seqs(spark, sf_dir))


@query(f"""WITH {SEQS}, x AS (SELECT 'sequence' AS unit, body_checks > 0 AS b, header_checks > 0 AS h FROM seqs UNION ALL SELECT 'test', sum(body_checks) > 0, sum(header_checks) > 0 FROM seqs GROUP BY test_id),
k AS (SELECT unit, count(*) AS n, count(*) FILTER (b AND h) AS both_, count(*) FILTER (b) AS body, count(*) FILTER (h) AS header FROM x GROUP BY unit)
SELECT unit, n AS items, both_ AS both_count, body AS body_count, header AS header_count, CASE WHEN body > 0 THEN CAST(both_ AS DOUBLE) / body END AS header_given_body, CASE WHEN header > 0 THEN CAST(both_ AS DOUBLE) / header END AS body_given_header, CASE WHEN body * header > 0 THEN CAST(both_ * n AS DOUBLE) / (body * header) END AS lift FROM k""")
def st1_co_occurrence(spark, sf_dir):
    return T.co_occurrence(_seqs(spark, sf_dir))


@query(f"""WITH {SEQS}, v AS (SELECT test_id, count(DISTINCT x) AS verbs, count(DISTINCT seq) AS n FROM (SELECT test_id, seq, unnest(verbs) AS x FROM seqs) GROUP BY test_id)
SELECT cohort, {summary('verbs')}, CAST(count(*) FILTER (verbs > 1) AS DOUBLE) / count(*) AS share_multiple FROM (SELECT 'all' AS cohort, verbs FROM v UNION ALL SELECT 'multi-request', verbs FROM v WHERE n > 1) GROUP BY cohort""")
def st1_method_diversity(spark, sf_dir):
    return T.method_diversity(_seqs(spark, sf_dir))


@query(f"""WITH {RES}, c AS (SELECT array_to_string(verbs, '-') AS combination, len(verbs) AS size FROM rseqs WHERE len(verbs) > 0)
SELECT combination, CAST(any_value(size) AS INT) AS size, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM c) AS proportion FROM c GROUP BY combination""")
def st1_verb_combinations(spark, sf_dir):
    return T.verb_combinations(S.resource_sequences(S.resource_steps(views.steps(spark, sf_dir))))


@query(f"""WITH {RES}, r AS (SELECT ops, exercised FROM rseqs WHERE len(exercised) > 0)
SELECT count(*) AS pairs, count(*) FILTER (len(exercised) > 1) AS multi_operation, count(*) FILTER (list_contains(exercised, 'create')) AS with_create, count(*) FILTER (list_contains(exercised, 'create') AND list_contains(exercised, 'delete')) AS create_and_delete,
  CAST(count(*) FILTER (list_contains(exercised, 'create') AND list_contains(exercised, 'delete')) AS DOUBLE) / nullif(count(*) FILTER (list_contains(exercised, 'create')), 0) AS delete_given_create FROM r""")
def st1_create_delete_pairing(spark, sf_dir):
    return T.create_delete_pairing(S.resource_sequences(S.resource_steps(views.steps(spark, sf_dir))))
