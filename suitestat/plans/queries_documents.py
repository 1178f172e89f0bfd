"""Queries on whole project documents: a user's events as a project, written as JSON and read back by the full schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.operators import sequences as S
from suitestat.plans import views
from suitestat.plans.registry import query
from suitestat.plans.sqltext import CRUD as CRUD_SQL
from suitestat.plans.sqltext import SEG
from suitestat.sources import documents as D
from suitestat.sources import facts as P

_FRAMEWORKS = ("mockmvc", "rest-assured", "webtestclient", "okhttp", "jax-rs")


def _in_order(value, *order):
    """The values of a group in order; those that are null stay out."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))))
    return F.transform(rows, lambda x: x["v"])


def _texts(spark, sf_dir):
    """(project_id, json): every test of a user in one document."""
    s = views.steps(spark, sf_dir).withColumn("project_id", F.floor(F.col("test_id") / 10).cast("long"))
    k, none = F.col("k"), F.array().cast("array<string>")
    where = F.struct(F.col("phase").alias("phase"), F.col("origin_kind").alias("kind"))
    names = lambda on, *n: F.when(on, F.array(*[F.lit(x) for x in n])).otherwise(none)
    sources = F.when(k % 6 == 0, F.array(F.struct(F.lit("header").alias("method_name"), F.array(F.lit("header_names")).alias("contributed_properties")))).otherwise(F.array().cast("array<struct<method_name:string,contributed_properties:array<string>>>"))
    call = F.struct(F.coalesce("http_method", F.lit("UNKNOWN")).alias("http_method"), F.coalesce("http_path", F.lit("")).alias("path"), "framework", F.when(F.col("kind") == "http-request", "event").otherwise("builder").alias("request_role"), (k % 2 == 0).alias("has_body_payload"), names(k % 3 == 0, " Accept", "X-Id").alias("header_names"), names(k % 4 == 0, "page").alias("query_param_names"), names(k % 5 == 0, "id").alias("path_param_names"), sources.alias("correlated_builder_sources"))
    asks = F.when(F.col("kind") != "response-check", F.struct(where.alias("origin"), call.alias("http_call")))
    checks = F.when(F.col("kind") == "response-check", F.struct(where.alias("origin"), "assertion_role", F.when(F.col("assertion_role") == "status", "status-assertion").alias("response_role"), "status_code"))
    t = s.groupBy("project_id", "test_id").agg(_in_order(asks, "pos").alias("asks"), _in_order(checks, "pos").alias("checks"), F.count_if(F.col("assertion_role") == "status").alias("status_count"))
    step = F.struct("kind", "phase", "http_method", "http_path", "assertion_role", "status_code")
    q = S.segment(s).groupBy("project_id", "test_id", "seq").agg(_in_order(step, "pos").alias("steps"))
    q = q.groupBy("project_id", "test_id").agg(_in_order(F.struct(F.col("seq").alias("order"), F.concat_ws("|", F.transform("steps", lambda x: x["kind"])).alias("fingerprint"), "steps"), "seq").alias("sequences"))
    r = S.resource_steps(s).groupBy("project_id", "test_id", "resource_key").agg(_in_order(F.struct("http_method", "phase", F.col("operation").alias("crud_operation")), "pos").alias("steps"))
    r = r.groupBy("project_id", "test_id").agg(_in_order(F.struct("resource_key", "steps"), "resource_key").alias("resources"))
    t = t.join(q, ["project_id", "test_id"], "left").join(r, ["project_id", "test_id"], "left")
    http = F.struct(F.col("asks").alias("request_interactions"), F.col("checks").alias("verification_interactions"), F.col("sequences").alias("test_sequences"), F.col("resources").alias("resource_interaction_sequences"))
    name = F.concat(F.lit("t"), F.col("test_id").cast("string"))
    test = F.struct(F.struct(F.lit("C").alias("defining_class_name"), name.alias("method_signature")).alias("identity"), (F.size(F.filter("asks", lambda i: i["http_call"]["request_role"] == "event")) > 0).alias("is_api_test"), F.lit(False).alias("is_controller_unit_test"), F.struct(F.struct("status_count").alias("summary")).alias("assertions"), http.alias("http"))
    p = t.groupBy("project_id").agg(F.array(F.struct(F.lit("C").alias("qualified_class_name"), _in_order(test, "test_id").alias("test_method_analyses"))).alias("classes"))
    u = _resources(s)
    p = p.join(u, "project_id", "left")
    doc = F.struct(F.concat(F.lit("p"), F.col("project_id").cast("string")).alias("dataset_name"), F.struct(F.col("resources").alias("resources")).alias("resource_crud"), F.col("classes").alias("test_class_analyses"))
    return p.select("project_id", F.to_json(doc).alias("json"))


def _resources(s):
    """Production resources of a project: endpoints for a third of the requests, and references from each test that has an operation on the resource."""
    r = S.resource_steps(s)
    ends = r.filter("event_id % 3 = 0").groupBy("project_id", "resource_key").agg(F.array_sort(F.collect_set(F.struct("http_method", (F.col("http_method") == "PATCH").alias("is_method_wildcard")))).alias("endpoints"))
    refs = r.filter("operation is not null").select("project_id", "resource_key", "operation", "test_id").distinct()
    ref = F.struct(F.struct(F.lit("C").alias("qualified_class_name"), F.concat(F.lit("t"), F.col("test_id").cast("string")).alias("method_signature")).alias("test_method"), "resource_key")
    refs = refs.groupBy("project_id", "resource_key", "operation").agg(_in_order(ref, "test_id").alias("refs"))
    refs = refs.groupBy("project_id", "resource_key").agg(F.map_from_entries(F.collect_list(F.struct("operation", "refs"))).alias("exercising_test_resources_by_operation"))
    both = ends.join(refs, ["project_id", "resource_key"], "full")
    return both.groupBy("project_id").agg(F.collect_list(F.struct("resource_key", "endpoints", "exercising_test_resources_by_operation")).alias("resources"))


def _documents(spark, sf_dir):
    return D.good(D.parse(_texts(spark, sf_dir)))


_STEPS = f"{SEG}, one AS (SELECT *, CAST(floor(test_id / 10) AS BIGINT) AS user_id, kind = 'http-request' AS ev, CASE WHEN origin_kind LIKE 'fixture%' THEN 'fixture' ELSE origin_kind END AS o FROM steps)"


def _count(*conditions):
    return "concat_ws(',', " + ", ".join(f"count(*) FILTER ({c})" for c in conditions) + ")"


_BY = lambda on: [f"{on} AND o = '{o}'" for o in P.ORIGINS]
_METHODS = [f"ev AND http_method = '{m}'" for m in S.METHODS] + [f"ev AND (http_method IS NULL OR http_method NOT IN ({', '.join(repr(m) for m in S.METHODS)}))"]
_OPS = [f"ev AND {CRUD_SQL.format('http_method')} = '{c}'" for c in ("create", "read", "update", "delete")]


@query(f"""WITH {_STEPS}
SELECT user_id AS project_id, concat('t', CAST(test_id AS VARCHAR)) AS method_signature, count(*) FILTER (ev) > 0 AS is_api_test,
  {_count(*_BY("kind = 'request-build'"))} AS builder_counts, {_count(*_BY("ev"))} AS event_counts, {_count(*_BY("kind = 'response-check'"))} AS verification_counts,
  {_count("ev AND o = 'fixture' AND phase = 'setup'", "ev AND o = 'fixture' AND phase = 'teardown'")} AS fixture_event_phase_counts,
  {_count(*_METHODS)} AS http_method_counts, {_count(*_OPS)} AS crud_operation_counts,
  {_count(*[f"ev AND framework = '{f}'" for f in _FRAMEWORKS])} AS http_event_framework_counts,
  {_count("false", "false", "false", "false", "false", "kind = 'response-check' AND assertion_role = 'status'", "kind = 'response-check' AND assertion_role IS DISTINCT FROM 'status'")} AS verification_response_role_counts,
  count(*) FILTER (ev AND k % 2 = 0) AS request_events_with_body, count(*) FILTER (ev AND k % 3 = 0) AS request_events_with_headers, count(*) FILTER (ev AND k % 4 = 0) AS request_events_with_query_params,
  count(*) FILTER (ev AND k % 5 = 0) AS request_events_with_path_params, count(*) FILTER (ev AND k % 6 = 0) AS request_events_with_builder_correlation,
  2 * count(*) FILTER (kind <> 'response-check' AND k % 3 = 0) AS header_names, count(*) FILTER (assertion_role = 'status') AS assertion_status_count
FROM one GROUP BY ALL""")
def doc_test_facts(spark, sf_dir):
    t = P.test_facts(P.tests(_documents(spark, sf_dir)), _FRAMEWORKS)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    vectors = ("builder_counts", "event_counts", "verification_counts", "fixture_event_phase_counts", "http_method_counts", "crud_operation_counts", "http_event_framework_counts", "verification_response_role_counts")
    plain = ("request_events_with_body", "request_events_with_headers", "request_events_with_query_params", "request_events_with_path_params", "request_events_with_builder_correlation", "assertion_status_count")
    return t.select("project_id", "method_signature", "is_api_test", *[text(v) for v in vectors], *plain, F.size("runtime_header_names").cast("long").alias("header_names"))


_LIST = lambda c: f"coalesce(string_agg(CAST({c} AS VARCHAR), ',' ORDER BY seq), '')"


@query(f"""WITH {SEG},
sq AS (SELECT test_id, seq, count(*) FILTER (kind = 'request-build') AS b, count(*) FILTER (kind = 'http-request') AS r, count(*) FILTER (kind = 'response-check') AS c, count(*) FILTER (kind = 'response-check' AND assertion_role = 'status') AS st,
  count(*) FILTER (kind = 'response-check' AND assertion_role = 'body') AS bo, coalesce(string_agg(CASE WHEN status_code IS NULL THEN 'unknown' ELSE concat(CAST(status_code // 100 AS VARCHAR), 'xx') END, '+' ORDER BY pos) FILTER (kind = 'response-check' AND assertion_role = 'status'), '') AS ranges FROM seg GROUP BY test_id, seq),
sv AS (SELECT test_id, {_LIST("b")} AS builds, {_LIST("r")} AS requests, {_LIST("c")} AS checks, {_LIST("st")} AS status_checks, {_LIST("bo")} AS body_checks, {_LIST("ranges")} AS ranges FROM sq GROUP BY test_id),
ends AS (SELECT test_id, count(*) AS targets, count(DISTINCT concat(http_method, ' ', npath)) AS different FROM seg WHERE kind = 'http-request' GROUP BY test_id),
tests AS (SELECT DISTINCT test_id FROM steps)
SELECT CAST(floor(test_id / 10) AS BIGINT) AS project_id, concat('t', CAST(test_id AS VARCHAR)) AS method_signature, coalesce(builds, '') AS builds, coalesce(requests, '') AS requests, coalesce(checks, '') AS checks,
  coalesce(status_checks, '') AS status_checks, coalesce(body_checks, '') AS body_checks, coalesce(ranges, '') AS ranges, coalesce(builds, '') AS fan_in, coalesce(checks, '') AS fan_out, coalesce(targets > different, false) AS re_dispatches, coalesce(targets > 0, false) AS resolved
FROM tests LEFT JOIN sv USING (test_id) LEFT JOIN ends USING (test_id)""")
def doc_sequence_facts(spark, sf_dir):
    t = P.test_facts(P.tests(_documents(spark, sf_dir)))
    text = lambda c, name: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name)
    ranges = F.array_join(F.transform("http_sequence_status_ranges", lambda x: F.array_join(x, "+")), ",")
    vectors = {"builds": "http_sequence_request_build_counts", "requests": "http_sequence_http_request_counts", "checks": "http_sequence_response_check_lengths", "status_checks": "http_sequence_status_check_counts", "body_checks": "http_sequence_body_check_counts", "fan_in": "dispatch_event_request_builder_counts", "fan_out": "dispatch_event_response_check_counts"}
    return t.select("project_id", "method_signature", *[text(c, n) for n, c in vectors.items()], ranges.alias("ranges"), F.col("re_dispatches_endpoint").alias("re_dispatches"), F.col("all_dispatch_events_resolved").alias("resolved"))


_RS = f"""steps0 AS ({views.STEPS}), r0 AS (SELECT CAST(floor(test_id / 10) AS BIGINT) AS user_id, test_id, event_id, pos, phase, http_method, regexp_replace(http_path, '/[0-9]+$', '') AS resource_key, {CRUD_SQL.format("http_method")} AS op FROM steps0 WHERE kind = 'http-request'),
rq AS (SELECT user_id, test_id, resource_key, bool_and(op IS NOT NULL) AS whole, bool_or(phase = 'test') AS in_test, count(op) AS mapped,
  array_to_string(list_filter(['create', 'read', 'update', 'delete'], lambda x: list_contains(coalesce(list(op) FILTER (op IS NOT NULL), []), x)), '+') AS ops,
  list_filter(['GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE'], lambda x: list_contains(list(http_method), x)) AS verbs FROM r0 GROUP BY ALL)"""


@query(f"""WITH {_RS}
SELECT user_id AS project_id, concat('t', CAST(test_id AS VARCHAR)) AS method_signature, count(*) AS resources, count(*) FILTER (in_test) AS test_resources, count(*) FILTER (NOT whole) AS unresolved,
  coalesce(string_agg(ops, ',' ORDER BY resource_key) FILTER (whole), '') AS crud_combinations, coalesce(string_agg(array_to_string(verbs, '+'), ',' ORDER BY resource_key) FILTER (whole), '') AS verb_combinations FROM rq GROUP BY ALL""")
def doc_resource_combinations(spark, sf_dir):
    t = P.test_facts(P.tests(_documents(spark, sf_dir))).filter("distinct_resource_count > 0")
    text = lambda c, n: F.array_join(F.transform(c, lambda x: F.array_join(x, "+")), ",").alias(n)
    return t.select("project_id", "method_signature", F.col("distinct_resource_count").alias("resources"), F.col("test_phase_distinct_resource_count").alias("test_resources"), F.col("unresolved_resource_crud_sequence_count").alias("unresolved"), text("resource_crud_combinations", "crud_combinations"), text("resource_verb_combinations", "verb_combinations"))


@query(f"""WITH {_RS},
ends AS (SELECT user_id, resource_key, list_filter(['GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE'], lambda x: list_contains(list(http_method), x) AND x <> 'PATCH') AS av FROM r0 WHERE event_id % 3 = 0 GROUP BY ALL),
uses AS (SELECT user_id, resource_key, flatten(list(verbs)) AS seen, string_agg(array_to_string(verbs, '+'), ',' ORDER BY array_to_string(verbs, '+')) AS sets FROM rq WHERE mapped > 0 GROUP BY ALL)
SELECT user_id AS project_id, resource_key AS production_key, array_to_string(coalesce(av, []), '+') AS available_verbs,
  array_to_string(list_filter(['GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE'], lambda x: list_contains(coalesce(seen, []), x)), '+') AS exercised_verbs,
  array_to_string(list_filter(coalesce(av, []), lambda x: NOT list_contains(coalesce(seen, []), x)), '+') AS missing_verbs, coalesce(sets, '') AS sequence_sets
FROM ends FULL JOIN uses USING (user_id, resource_key)""")
def doc_resource_facts(spark, sf_dir):
    r = P.resource_facts(_documents(spark, sf_dir))
    sets = F.array_sort(F.transform("exercising_sequence_verb_sets", lambda x: F.array_join(x, "+")))
    return r.select("project_id", "production_key", *[F.array_join(c, "+").alias(n) for c, n in (("available_verbs", "available_verbs"), ("exercised_verbs", "exercised_verbs"), ("missing_available_verbs", "missing_verbs"))], F.array_join(sets, ",").alias("sequence_sets"))


@query(f"""WITH {SEG},
fp AS (SELECT test_id, seq, string_agg(kind, '|' ORDER BY pos) AS fingerprint FROM seg GROUP BY test_id, seq),
u AS (SELECT DISTINCT CAST(floor(test_id / 10) AS BIGINT) AS user_id, test_id, fingerprint FROM fp),
c AS (SELECT user_id, fingerprint FROM u GROUP BY ALL HAVING count(*) > 1)
SELECT DISTINCT user_id AS project_id, concat('t', CAST(test_id AS VARCHAR)) AS method_signature FROM u JOIN c USING (user_id, fingerprint)""")
def doc_shared_sequences(spark, sf_dir):
    return P.shared_sequences(P.tests(_documents(spark, sf_dir))).select("project_id", "method_signature")


# ---- audits by the whole schema and its vocabularies: a customer's orders as a project with gaps, keys too many and odd words


def _gapped(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("k", F.col("o_orderkey"))
    k = F.col("k")
    name = F.concat(F.lit("C"), k.cast("string")).alias("qualified_class_name")
    phase = F.when(k % 3 == 0, "setup").when(k % 3 == 1, "test").otherwise("boot").alias("phase")
    cls = F.struct(name, F.array(F.struct(phase)).alias("fixtures"), F.when(k % 11 == 0, 1).alias("extra"))
    ask = F.struct(F.struct(F.array(F.struct(F.when(k % 6 == 5, "matrix").otherwise("query").alias("source"))).alias("parameters")).alias("endpoint"))
    p = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(cls)).alias("classes"), F.collect_list(ask).alias("endpoints"))
    c = F.col("o_custkey")
    level = F.when(c % 7 == 0, "call_graph").when(c % 5 > 0, "symbol_table").alias("analysis_level")
    doc = F.struct(F.when(c % 4 > 0, "p").alias("dataset_name"), F.struct(F.lit("/x").alias("project_path"), level, F.when(c % 3 == 0, "main").alias("branch")).alias("metadata"), F.struct("endpoints").alias("endpoint_coverage"), F.col("classes").alias("test_class_analyses"))
    return p.select(c.alias("project_id"), F.to_json(doc).alias("json"))


_E = "endpoint_coverage.endpoints"
#: Fields of the document that the objects of these projects never have.
_NEVER = {
    "": "summary application_class_count application_method_count application_cyclomatic_complexity test_class_count test_method_count test_utility_class_count test_utility_method_count endpoint_parameter_coverage resource_crud controller_unit_tests",
    "metadata": "git_commit_hash git_remote_host git_repository expanded_helper_depth",
    "endpoint_coverage": "total_application_endpoints covered_endpoint_count untested_endpoint_count coverage_ratio discovered_application_paths",
    _E: "covering_test_methods covering_test_method_count is_covered asserted_outcomes",
    f"{_E}.endpoint": "http_method path_template framework declaring_class_name declaring_method_signature is_method_wildcard surface",
    f"{_E}.endpoint.parameters": "name type annotation required is_aggregate is_synthetic is_unscorable",
    "test_class_analyses": "testing_frameworks test_method_analyses",
    "test_class_analyses.fixtures": "defining_class_name method_signature annotations ncloc request_interaction_count verification_interaction_count http_interaction_count request_interactions verification_interactions http_interactions",
}
_GAPS = [f"{within}.{name}".lstrip(".") for within, names in _NEVER.items() for name in names.split()]


@query(f"""WITH c AS (SELECT DISTINCT o_custkey AS key FROM orders), g(path) AS (VALUES {", ".join(f"('{p}')" for p in _GAPS)})
SELECT key, path FROM c, g UNION ALL SELECT key, 'dataset_name' FROM c WHERE key % 4 = 0 UNION ALL SELECT key, 'metadata.analysis_level' FROM c WHERE key % 5 = 0 AND key % 7 > 0""")
def src_project_missing_keys(spark, sf_dir):
    return D.missing_keys(_gapped(spark, sf_dir), "project_id", "json")


@query("SELECT DISTINCT o_custkey AS key, 'metadata.branch' AS path FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'test_class_analyses.extra' FROM orders WHERE o_orderkey % 11 = 0")
def src_project_unknown_keys(spark, sf_dir):
    return D.unknown_keys(_gapped(spark, sf_dir), "project_id", "json")


@query(f"""SELECT DISTINCT o_custkey AS key, 'metadata.analysis_level' AS path, 'call_graph' AS value, CAST(1 AS BIGINT) AS n FROM orders WHERE o_custkey % 7 = 0
UNION ALL SELECT o_custkey, 'test_class_analyses.fixtures.phase', 'boot', count(*) FROM orders WHERE o_orderkey % 3 = 2 GROUP BY o_custkey UNION ALL SELECT o_custkey, '{_E}.endpoint.parameters.source', 'matrix', count(*) FROM orders WHERE o_orderkey % 6 = 5 GROUP BY o_custkey""")
def src_project_enum_drift(spark, sf_dir):
    from suitestat.sources.schema import DOMAINS

    return D.enum_drift(_gapped(spark, sf_dir), "project_id", "json", DOMAINS)
