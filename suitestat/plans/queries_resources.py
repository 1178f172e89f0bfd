"""Queries of the statistics of resources by verb, and of events, sequences and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.operators import coverage as C
from suitestat.operators import sequences as S
from suitestat.operators import stats_resources as R
from suitestat.operators.aggregates import CRUD, subsets
from suitestat.plans import views
from suitestat.plans.queries_coverage import _RCOV, _match, _rcov
from suitestat.plans.queries_tests import _OUT
from suitestat.plans.registry import query
from suitestat.plans.sqltext import CRUD as CRUD_SQL
from suitestat.plans.sqltext import OPS, RES, SEG, SEQS, summary
from suitestat.plans.sqltext import VERBS as VERBS_SQL
from suitestat.plans.views import ENDPOINTS, STEPS

_V = f"""{RES}, endpoints AS ({ENDPOINTS}),
va AS (SELECT project_id, resource_key, list_filter({VERBS_SQL}, lambda x: list_contains(coalesce(list(m) FILTER (m IS NOT NULL), []), x)) AS av, list_filter({OPS}, lambda x: list_contains(coalesce(list(op) FILTER (op IS NOT NULL), []), x)) AS ao
  FROM (SELECT project_id, regexp_replace(path_template, '/[{{]id[}}]$', '') AS resource_key, CASE WHEN NOT is_method_wildcard THEN http_method END AS m, CASE WHEN NOT is_method_wildcard THEN {CRUD_SQL.format("http_method")} END AS op FROM endpoints WHERE path_template <> '/**') t GROUP BY ALL),
vs AS (SELECT project_id, resource_key, flatten(list(verbs)) AS seen, count(*) AS sequences, bool_or(len(list_filter(av, lambda x: NOT list_contains(verbs, x))) = 0) AS whole FROM rseqs JOIN va USING (project_id, resource_key) GROUP BY ALL),
vr AS (SELECT va.*, list_filter(av, lambda x: list_contains(coalesce(seen, []), x)) AS ev, coalesce(sequences, 0) AS sequences, coalesce(whole, false) AS traversed FROM va LEFT JOIN vs USING (project_id, resource_key))"""


def _group(on: str) -> str:
    n, t, f = f"count(*) FILTER ({on})", f"count(*) FILTER ({on} AND len(ev) > 0)", f"count(*) FILTER ({on} AND len(ev) > 0 AND len(ev) = len(av))"
    return f"{n} AS resources, {t} AS tested, {f} AS fully, CAST({t} AS DOUBLE) / nullif({n}, 0) AS tested_share, CAST({f} AS DOUBLE) / nullif({t}, 0) AS fully_share_of_tested"


def _rsteps(spark, sf_dir):
    return S.resource_steps(views.steps(spark, sf_dir))


def _verbs(spark, sf_dir):
    return R.verb_exercise(S.resource_sequences(_rsteps(spark, sf_dir)), R.verb_availability(views.endpoints(spark, sf_dir)))


@query(f"WITH {_V} SELECT {_group('len(av) > 0')} FROM vr")
def st2_verb_fully_exercised(spark, sf_dir):
    return R.verb_fully_exercised(_verbs(spark, sf_dir))


@query(f"WITH {_V} SELECT len(av) > 1 AS multi, {_group('true')} FROM vr WHERE len(av) > 0 GROUP BY 1")
def st2_verb_exercise_by_breadth(spark, sf_dir):
    return R.verb_exercise_by_breadth(_verbs(spark, sf_dir))


@query(f"WITH {_V} SELECT {_group('len(ao) = 4')} FROM vr")
def st2_verb_exercise_when_capable(spark, sf_dir):
    return R.verb_exercise_when_capable(_verbs(spark, sf_dir))


@query(f"WITH {_V}, c AS (SELECT array_to_string(av, '-') AS profile FROM vr WHERE len(av) > 0), u AS (SELECT DISTINCT profile FROM c UNION SELECT unnest({VERBS_SQL})) SELECT u.profile, count(c.profile) AS n, (SELECT count(*) FROM c) AS total, CAST(count(c.profile) AS DOUBLE) / (SELECT count(*) FROM c) AS proportion FROM u LEFT JOIN c USING (profile) GROUP BY u.profile")
def st2_verb_availability_profile(spark, sf_dir):
    return R.verb_availability_profile(_verbs(spark, sf_dir))


@query(f"WITH {_V} SELECT count(*) AS resources, count(*) FILTER (traversed) AS traversed, CAST(count(*) FILTER (traversed) AS DOUBLE) / nullif(count(*), 0) AS proportion FROM vr WHERE len(av) > 1 AND sequences > 0")
def st2_single_sequence_traversal(spark, sf_dir):
    return R.single_sequence_traversal(_verbs(spark, sf_dir))


@query(f"WITH {_RCOV}, a AS (SELECT * FROM rcov WHERE len(available) = 4), c AS (SELECT CASE WHEN len(exercised) = 1 THEN concat(exercised[1], '-only') ELSE array_to_string(exercised, '-') END AS combination FROM a WHERE len(exercised) > 0) SELECT d.combination, count(c.combination) AS n, (SELECT count(*) FROM a) AS capable, (SELECT count(*) FROM a WHERE len(exercised) = 0) AS none_exercised, CAST(count(c.combination) AS DOUBLE) / nullif((SELECT count(*) FROM a), 0) AS proportion FROM unnest({subsets()!r}) AS d(combination) LEFT JOIN c USING (combination) GROUP BY d.combination")
def st2_combinations_when_capable(spark, sf_dir):
    return R.combinations_when_capable(_rcov(spark, sf_dir))


@query(f"WITH {RES}, n AS (SELECT t.test_id, count(DISTINCT resource_key) AS n FROM (SELECT DISTINCT test_id FROM steps) t LEFT JOIN rseqs USING (test_id) GROUP BY t.test_id) SELECT {summary('n')}, count(*) FILTER (n > 1) AS multi, count(*) AS tests, CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*) AS multi_share FROM n")
def st2_resources_per_test(spark, sf_dir):
    return R.resources_per_test(views.steps(spark, sf_dir), S.resource_sequences(_rsteps(spark, sf_dir)))


@query(f"WITH {RES}, c AS (SELECT project_id, test_id, resource_key, CASE WHEN bool_and(op IS NOT NULL) THEN list_filter({OPS}, lambda x: list_contains(list(op), x)) END AS v FROM rsteps GROUP BY ALL) SELECT coalesce(array_to_string(v, '-'), 'unresolved') AS combination, count(*) AS n FROM c GROUP BY 1")
def prj_resolved_combinations(spark, sf_dir):
    out = R.resolved_combination(_rsteps(spark, sf_dir), S.crud("http_method"), CRUD)
    return out.groupBy(F.coalesce(F.array_join("combination", "-"), F.lit("unresolved")).alias("combination")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RES} SELECT project_id, test_id, count(DISTINCT resource_key) AS resources, count(DISTINCT CASE WHEN phase = 'test' THEN resource_key END) AS test_resources, count(DISTINCT CASE WHEN op IS NOT NULL THEN resource_key END) AS resolved_resources, count(DISTINCT CASE WHEN op IS NOT NULL AND phase = 'test' THEN resource_key END) AS resolved_test_resources FROM rsteps GROUP BY ALL")
def prj_distinct_resources(spark, sf_dir):
    return R.distinct_resources(_rsteps(spark, sf_dir))


@query(f"WITH {_V} SELECT project_id, resource_key, array_to_string(verbs, ',') AS verbs, count(*) AS sequences FROM rseqs SEMI JOIN va USING (project_id, resource_key) GROUP BY ALL")
def prj_exercising_verbs(spark, sf_dir):
    out = R.exercising_verbs(S.resource_sequences(_rsteps(spark, sf_dir)), R.verb_availability(views.endpoints(spark, sf_dir)))
    return out.groupBy("project_id", "resource_key", F.array_join("verbs", ",").alias("verbs")).agg(F.count(F.lit(1)).alias("sequences"))


@query(f"""WITH {_OUT}, kc AS (SELECT project_id, test_id, seq, status_code, count(*) AS n FROM seg WHERE kind = 'response-check' AND assertion_role = 'status' AND status_code IS NOT NULL GROUP BY ALL),
oc AS (SELECT f.project_id, m.endpoint_id, kc.status_code, sum(kc.n) AS checks FROM f JOIN m ON m.project_id = f.project_id AND m.http_method = f.http_method AND m.http_path = f.http_path JOIN kc ON kc.test_id = f.test_id AND kc.seq = f.seq GROUP BY ALL),
g AS (SELECT count(*) AS a FROM (SELECT DISTINCT project_id, endpoint_id FROM oc)) SELECT status_code, CAST(sum(checks) AS BIGINT) AS checks, count(*) AS endpoints, CAST(sum(checks) AS DOUBLE) / (SELECT sum(checks) FROM oc) AS check_share, any_value(a) AS asserted, CAST(count(*) AS DOUBLE) / any_value(a) AS endpoint_share FROM oc, g GROUP BY status_code""")
def st2_asserted_codes(spark, sf_dir):
    _, e, m = _match(spark, sf_dir)
    segmented = S.segment(views.steps(spark, sf_dir))
    return R.asserted_codes(C.credited(segmented, e, m, R.code_checks(segmented), "status_code"))


@query(f"WITH {SEG}, x AS (SELECT kind, count(CASE WHEN kind = 'request-build' THEN 1 END) OVER (PARTITION BY test_id, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fan_in, count(CASE WHEN kind = 'response-check' THEN 1 END) OVER (PARTITION BY test_id, seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fan_out FROM seg), l AS (SELECT m AS metric, CASE m WHEN 'fan_in' THEN fan_in ELSE fan_out END AS value FROM x, unnest(['fan_in', 'fan_out']) AS u(m) WHERE kind = 'http-request') SELECT metric, {summary('value')} FROM l GROUP BY metric")
def st1_dispatch_fan(spark, sf_dir):
    return R.fan_summaries(S.fan(S.segment(views.steps(spark, sf_dir))))


@query(f"""WITH {SEQS}, r AS (SELECT checks, row_number() OVER (ORDER BY checks DESC) AS rn, count(*) OVER () AS n FROM seqs), p AS (SELECT unnest([1, 5, 10, 25]) AS percent)
SELECT percent, any_value(n) AS item_count, CAST(sum(checks) AS BIGINT) AS total, CAST(greatest(1, ceil(any_value(n) * percent / 100.0)) AS BIGINT) AS top_count, CAST(sum(checks) FILTER (rn <= greatest(1, ceil(n * percent / 100.0))) AS DOUBLE) / sum(checks) AS share_of_total,
avg(CASE WHEN checks = 0 THEN 1.0 ELSE 0 END) AS zero_share, avg(CASE WHEN checks <= 1 THEN 1.0 ELSE 0 END) AS at_most_one_share, avg(CASE WHEN checks > 5 THEN 1.0 ELSE 0 END) AS above_five_share, avg(CASE WHEN checks > 10 THEN 1.0 ELSE 0 END) AS above_ten_share FROM r, p GROUP BY percent""")
def st1_verification_concentration(spark, sf_dir):
    seg = S.segment(views.steps(spark, sf_dir))
    return R.verification_concentration(S.sequences(seg))


#: An error event whose code is unknown stands for an assertion that something is thrown.
@query(f"WITH steps AS ({STEPS}), t AS (SELECT test_id, bool_or(assertion_role = 'status' AND status_code IS NULL) AS h FROM steps GROUP BY test_id) SELECT count(*) FILTER (h) AS true_count, count(*) AS total, CAST(count(*) FILTER (h) AS DOUBLE) / count(*) AS proportion FROM t")
def st1_exception_assertions(spark, sf_dir):
    steps = views.steps(spark, sf_dir)
    return R.exception_assertions(steps.withColumn("assertion_role", F.when((F.col("assertion_role") == "status") & F.col("status_code").isNull(), "exception").otherwise(F.col("assertion_role"))))


#: Body checks stand for extractions from responses.
@query(f"WITH steps AS ({STEPS}), t AS (SELECT test_id, count(*) FILTER (assertion_role = 'body') AS x, count(*) FILTER (kind = 'http-request') AS r FROM steps GROUP BY test_id) SELECT count(*) FILTER (x > 0) AS extracting, count(*) AS tests, CAST(count(*) FILTER (x > 0) AS DOUBLE) / count(*) AS extracting_share, count(*) FILTER (r >= 2) AS multi_tests, count(*) FILTER (r >= 2 AND x > 0) AS multi_extracting, CAST(count(*) FILTER (r >= 2 AND x > 0) AS DOUBLE) / nullif(count(*) FILTER (r >= 2), 0) AS multi_share, {summary('x')} FROM t")
def st2_extraction_usage(spark, sf_dir):
    t = views.steps(spark, sf_dir).groupBy("test_id").agg(F.count_if(F.coalesce(F.col("assertion_role") == "body", F.lit(False))).alias("extractions"), F.count_if(F.col("kind") == "http-request").alias("requests"))
    return R.extraction_usage(t)


@query(f"WITH e AS (SELECT l_orderkey % 4 AS q, l_suppkey % 3 AS h FROM lineitem), l AS (SELECT m AS metric, CASE m WHEN 'query_names' THEN q ELSE h END AS value FROM e, unnest(['query_names', 'header_names']) AS u(m)) SELECT metric, {summary('value')} FROM l GROUP BY metric")
def st2_names_per_event(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = lambda n: F.when(n > 0, F.array_repeat(F.lit("x"), n.cast("int")))
    return R.names_per_event(lines.select(names(F.col("l_orderkey") % 4).alias("query_names"), names(F.col("l_suppkey") % 3).alias("header_names")))


@query(f"WITH p AS (SELECT c_custkey, count(DISTINCT o_orderkey) AS api_tests, count(l_orderkey) AS endpoints FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey), l AS (SELECT m AS metric, CASE m WHEN 'api_tests' THEN api_tests ELSE endpoints END AS value FROM p, unnest(['api_tests', 'endpoints']) AS u(m) WHERE api_tests > 0) SELECT metric, {summary('value')}, CAST(sum(value) AS BIGINT) AS total FROM l GROUP BY metric")
def st2_api_test_universe(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("api_tests"), F.coalesce(F.sum("n"), F.lit(0)).alias("endpoints"))
    return R.api_test_universe(o, "api_tests", "endpoints")


