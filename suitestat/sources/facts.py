"""Fact tables from nested project documents (PRJ-05, 14, 26..32).

A test's counters come from its own arrays, by functions on arrays, so the fact
table is one pass over the documents: it shuffles only for fingerprints that
tests of a project share.  An empty or null array counts 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitestat.functions.urls import normalize_request_path
from suitestat.operators.aggregates import CRUD, VERBS, canonical
from suitestat.operators.sequences import METHODS, canonical_method, crud, origin, verb
from suitestat.sources.schema import RESPONSE_ROLES

RANGES = ("1xx", "2xx", "3xx", "4xx", "5xx", "unknown")
ORIGINS = ("test-method", "test-helper", "fixture")


def tests(docs: DataFrame) -> DataFrame:
    """PRJ-31: a row for each test, with its class and project."""
    c = docs.select("project_id", F.explode("doc.test_class_analyses").alias("c"))
    t = c.select("project_id", F.col("c.qualified_class_name").alias("class_name"), F.explode("c.test_method_analyses").alias("t"))
    return t.select("project_id", "class_name", F.col("t.identity.method_signature").alias("method_signature"), "t.*")


def test_classes(docs: DataFrame) -> DataFrame:
    """PRJ-26: a row for each test class: frameworks, API tests, fixtures by phase."""
    c = docs.select("project_id", F.explode("doc.test_class_analyses").alias("c"))
    return c.select("project_id", F.col("c.qualified_class_name").alias("class_name"), F.col("c.testing_frameworks").alias("testing_frameworks"), _n("c.test_method_analyses", lambda t: t["is_api_test"]).alias("api_test_count"), _n("c.fixtures").alias("fixture_count"))


def steps(tests_: DataFrame) -> DataFrame:
    """Steps of the sequences of each test; SRC-08: length is the number of steps."""
    s = tests_.select("project_id", "class_name", "method_signature", F.explode("http.test_sequences").alias("s"))
    return s.select("project_id", "class_name", "method_signature", F.col("s.order").alias("seq"), _n("s.steps").alias("length"), F.posexplode("s.steps").alias("pos", "x")).select("project_id", "class_name", "method_signature", "seq", "length", "pos", "x.*")


def endpoints(docs: DataFrame) -> DataFrame:
    """PRJ-27: a row for each endpoint with its coverage and asserted outcomes."""
    return docs.select("project_id", F.posexplode("doc.endpoint_coverage.endpoints").alias("endpoint_id", "e")).select("project_id", "endpoint_id", "e.endpoint.*", "e.covering_test_method_count", "e.is_covered", "e.asserted_outcomes")


def endpoint_parameters(docs: DataFrame) -> DataFrame:
    """PRJ-28: rates of each endpoint with parameters (null: no denominator) and its maps by source."""
    e = docs.select("project_id", F.posexplode("doc.endpoint_parameter_coverage.endpoints").alias("endpoint_id", "e"))
    rates = ("exercise_rate", "required_exercise_rate", "optional_exercise_rate", "simple_1_way_optional_coverage", "simple_2_way_optional_coverage", "total_2_way_optional_coverage")
    maps = ("exercise_rate_by_source", "optional_exercise_rate_by_source", "simple_1_way_optional_coverage_by_source", "simple_2_way_optional_coverage_by_source", "total_2_way_optional_coverage_by_source")
    counts = {"optional_count_by_source": "optional_parameter_count_by_source", "optional_exercised_count_by_source": "optional_exercised_count_by_source"}
    return e.select("project_id", "endpoint_id", "e.route_covering_test_count", *[f"e.{c}" for c in rates + maps], *[F.col(f"e.{c}").alias(n) for n, c in counts.items()])


# ---- PRJ-05: counters of a test


def _rows(array: str | Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """The items of an array that are kept; a condition that is null drops the item, as false does."""
    a = F.coalesce(F.col(array) if isinstance(array, str) else array, F.array())
    return a if keep is None else F.filter(a, keep)


def _n(array: str | Column, keep: Callable[[Column], Column] | None = None) -> Column:
    return F.size(_rows(array, keep)).cast("long")


def _any(array: str | Column, keep: Callable[[Column], Column]) -> Column:
    return _n(array, keep) > 0


def _filled(array: Column) -> Column:
    return F.size(F.coalesce(array, F.array())) > 0


def _calls(role: str) -> Column:
    return _rows("http.request_interactions", lambda i: i["http_call"]["request_role"] == role)


def _vector(domain: tuple[str, ...], array: str | Column, of: Callable[[Column], Column]) -> Column:
    """How often each value of a domain stands in an array, in the order of the domain."""
    is_value = lambda d: lambda x: of(x) == d
    return F.array(*[_n(array, is_value(d)) for d in domain])


def _phases(array: str | Column) -> Column:
    """Rows of fixtures by setup and teardown."""
    return _vector(("setup", "teardown"), _rows(array, lambda i: origin(i["origin"]["kind"]) == "fixture"), lambda i: i["origin"]["phase"])


def _by_sequence(of: Callable[[Column], Column]) -> Column:
    """One value for each sequence of the test."""
    return F.transform(_rows("http.test_sequences"), lambda s: of(_rows(s["steps"])))


def _requests(s: Column) -> Column:
    return F.filter(s, lambda x: x["kind"] == "http-request")


def _checks(s: Column, role: str | None = None) -> Column:
    return F.filter(s, lambda x: (x["kind"] == "response-check") & (F.lit(True) if role is None else x["assertion_role"] == role))


def _range(x: Column) -> Column:
    """PRJ-18: a range that is given, else the hundreds of the code, else unknown."""
    given = F.when(x["status_range"] != "", x["status_range"])
    return F.coalesce(given, F.concat(F.floor(x["status_code"] / 100).cast("string"), F.lit("xx")), F.lit("unknown"))


def _fans(inward: bool) -> Column:
    """PRJ-15: for each request of the sequences, the builds before it or the checks after it."""

    def of(s: Column) -> Column:
        around = lambda i: F.slice(s, 1, i) if inward else F.slice(s, i + 2, F.size(s))
        kind = "request-build" if inward else "response-check"
        found = F.transform(s, lambda x, i: F.when(x["kind"] == "http-request", _n(around(i), lambda y: y["kind"] == kind)))
        return F.filter(found, lambda n: n.isNotNull())

    return F.flatten(_by_sequence(of))


def _combinations(of: Callable[[Column], Column], order: tuple[str, ...]) -> Column:
    """PRJ-20: the mapped values of each resource sequence, null where a method does not map or there are no steps."""

    def one(r: Column) -> Column:
        values = F.transform(_rows(r["steps"]), lambda x: of(x["http_method"]))
        return F.when((F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull()), canonical(values, order))

    return F.transform(_rows("http.resource_interaction_sequences"), one)


def test_facts(tests_: DataFrame, frameworks: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-05: a row for each test with its counters; vectors are aligned with METHODS, CRUD, RANGES, ORIGINS, RESPONSE_ROLES and none, and frameworks."""
    events, builders, checks, resources = _calls("event"), _calls("builder"), "http.verification_interactions", "http.resource_interaction_sequences"
    call = lambda i: i["http_call"]
    kind = lambda i: origin(i["origin"]["kind"])
    known = lambda x: (x["http_method"] != "") & (x["http_method"] != "UNKNOWN")
    requests = F.flatten(_by_sequence(_requests))
    path = lambda x: normalize_request_path(x["http_path"])
    asked = lambda x: F.when((x["http_method"] != "") & path(x).isNotNull(), F.concat_ws(" ", F.upper(x["http_method"]), path(x)))
    targets = F.transform(requests, asked)
    known_targets = F.filter(targets, lambda t: t.isNotNull())
    parts = F.coalesce("identity.parameterization.signals", F.create_map().cast("map<string,array<string>>"))
    has_names = lambda c: lambda i: _filled(call(i)[c])
    size_of = lambda c: F.transform(events, lambda i: F.size(F.coalesce(call(i)[c], F.array())).cast("long"))
    crud_sets, verb_sets = _combinations(crud, CRUD), _combinations(verb, VERBS)
    roles = ("status", "body", "header", "general", "exception")
    columns = {
        "expanded_ncloc": F.col("expanded_metrics.ncloc"),
        "expanded_cyclomatic_complexity": F.col("expanded_metrics.cyclomatic_complexity"),
        "expanded_helper_method_count": F.col("expanded_metrics.helper_method_count"),
        "test_helper_method_count": F.col("expanded_metrics.test_helper_method_count"),
        "expanded_objects_created": F.col("expanded_metrics.number_of_objects_created"),
        "expanded_assertion_count": sum((F.coalesce(f"assertions.summary.{r}_count", F.lit(0)) for r in roles), F.lit(0)).cast("long"),
        **{f"assertion_{r}_count": F.col(f"assertions.summary.{r}_count") for r in roles},
        "response_surface_combination": F.col("assertions.response_surface_combination"),
        "oracle_type_label": F.col("assertions.oracle_type.label"),
        "has_exception_assertion": F.col("assertions.failure_scenarios.has_exception_assertion"),
        "status_code_counts": F.col("assertions.status_code_counts"),
        "status_range_counts": F.array(*[F.coalesce(F.col("assertions.status_range_counts")[r], F.lit(0)).cast("long") for r in RANGES]),
        "mocked_interaction_count": _n("http.mocked_interactions"),
        "response_extraction_count": _n("http.response_extractions"),
        "dependency_strategy_labels": F.col("dependencies.strategy.labels"),
        "dispatch_labels": F.col("http.request_dispatch.labels"),
        "auth_handling_label": F.col("http.auth_handling.label"),
        "has_read_after_write": _any(resources, lambda r: r["has_read_after_write"]),
        "has_cleanup_delete": _any(resources, lambda r: r["has_cleanup_delete"]),
        "resource_lifecycle_labels": F.transform(_rows(resources), lambda r: r["lifecycle_label"]),
        "setup_fixture_count": _n("fixtures", lambda f: f["phase"] == "setup"),
        "teardown_fixture_count": _n("fixtures", lambda f: f["phase"] == "teardown"),
        "builder_counts": _vector(ORIGINS, builders, kind),
        "event_counts": _vector(ORIGINS, events, kind),
        "verification_counts": _vector(ORIGINS, checks, kind),
        "fixture_builder_phase_counts": _phases(builders),
        "fixture_event_phase_counts": _phases(events),
        "fixture_verification_phase_counts": _phases(checks),
        "http_method_counts": _vector((*METHODS, "UNKNOWN"), events, lambda i: canonical_method(call(i)["http_method"])),
        "crud_operation_counts": _vector(CRUD, events, lambda i: crud(call(i)["http_method"])),
        "http_call_framework_counts": _vector(frameworks, "http.request_interactions", lambda i: call(i)["framework"]) if frameworks else F.array().cast("array<bigint>"),
        "http_event_framework_counts": _vector(frameworks, events, lambda i: call(i)["framework"]) if frameworks else F.array().cast("array<bigint>"),
        "verification_response_role_counts": _vector((*RESPONSE_ROLES, "none"), checks, lambda i: F.coalesce(i["response_role"], F.lit("none"))),
        "request_events_with_body": _n(events, lambda i: call(i)["has_body_payload"]),
        "request_events_with_headers": _n(events, lambda i: _filled(call(i)["header_names"]) | _filled(call(i)["headers"])),
        **{f"request_events_with_{p}_params": _n(events, has_names(f"{p}_param_names")) for p in ("query", "path", "form")},
        "request_events_with_builder_correlation": _n(events, lambda i: _filled(call(i)["correlated_builder_sources"])),
        "event_query_param_counts": size_of("query_param_names"),
        "event_header_name_counts": size_of("header_names"),
        "runtime_header_names": F.filter(F.flatten(F.transform(_rows("http.request_interactions"), lambda i: F.transform(_rows(call(i)["header_names"]), lambda h: F.lower(F.trim(h))))), lambda h: h != ""),
        "builder_groups": F.transform(F.filter(events, lambda i: _filled(call(i)["correlated_builder_sources"])), lambda i: F.transform(call(i)["correlated_builder_sources"], lambda b: b["contributed_properties"])),
        "http_sequence_count": F.col("http.sequence_summary.sequence_count"),
        "http_sequence_lengths": F.col("http.sequence_summary.sequence_lengths"),
        "http_sequence_request_build_counts": _by_sequence(lambda s: _n(s, lambda x: x["kind"] == "request-build")),
        "http_sequence_http_request_counts": _by_sequence(lambda s: _n(_requests(s))),
        "http_sequence_request_side_lengths": _by_sequence(lambda s: _n(s, lambda x: x["kind"].isin("request-build", "http-request"))),
        "http_sequence_response_check_lengths": _by_sequence(lambda s: _n(_checks(s))),
        **{f"http_sequence_{r}_check_counts": _by_sequence(lambda s, r=r: _n(_checks(s, r))) for r in ("status", "body", "header")},
        "http_sequence_status_ranges": _by_sequence(lambda s: F.transform(_checks(s, "status"), _range)),
        "http_sequence_crud_operations": _by_sequence(lambda s: canonical(F.transform(_requests(s), lambda x: crud(x["http_method"])), CRUD)),
        "http_sequence_verb_operations": _by_sequence(lambda s: canonical(F.transform(_requests(s), lambda x: verb(x["http_method"])), VERBS)),
        "dispatch_event_request_builder_counts": _fans(True),
        "dispatch_event_response_check_counts": _fans(False),
        "http_sequence_response_check_count": F.col("http.sequence_summary.response_check_step_count"),
        "has_multiple_http_sequences": F.col("http.sequence_summary.has_multiple_sequences"),
        "has_repeated_http_sequence": F.col("http.sequence_summary.has_repeated_sequence"),
        "distinct_endpoint_count": F.col("http.sequence_summary.distinct_endpoint_count"),
        "distinct_http_method_count": F.col("http.sequence_summary.distinct_http_method_count"),
        "re_dispatches_endpoint": F.size(known_targets) > F.size(F.array_distinct(known_targets)),
        "all_dispatch_events_resolved": (F.size(targets) > 0) & F.forall(targets, lambda t: t.isNotNull()),
        "distinct_resource_count": _n(resources),
        "test_phase_distinct_resource_count": _n(resources, lambda r: _any(r["steps"], lambda x: x["phase"] == "test")),
        "method_resolved_distinct_resource_count": _n(resources, lambda r: _any(r["steps"], known)),
        "method_resolved_test_phase_distinct_resource_count": _n(resources, lambda r: _any(r["steps"], lambda x: known(x) & (x["phase"] == "test"))),
        "resource_crud_combinations": F.filter(crud_sets, lambda c: c.isNotNull()),
        "unresolved_resource_crud_sequence_count": _n(crud_sets, lambda c: c.isNull()),
        "resource_verb_combinations": F.filter(verb_sets, lambda c: c.isNotNull()),
        "unresolved_resource_verb_sequence_count": _n(verb_sets, lambda c: c.isNull()),
        "precondition_types": F.transform(_rows("state.preconditions.preconditions"), lambda p: p["type"]),
        "postcondition_types": F.transform(_rows("state.observations.observations"), lambda o: o["medium"]),
        "is_parameterized": F.col("identity.parameterization").isNotNull(),
        **{f"parameterization_{k}_sources": F.coalesce(parts[k], F.array().cast("array<string>")) for k in ("static", "dynamic")},
    }
    return tests_.select("project_id", "class_name", "method_signature", "is_api_test", "is_controller_unit_test", *[c.alias(n) for n, c in columns.items()])


def shared_sequences(tests_: DataFrame) -> DataFrame:
    """PRJ-24: tests that have a sequence whose fingerprint another test of their project has too."""
    keys = ["project_id", "class_name", "method_signature"]
    f = tests_.select(*keys, F.explode("http.test_sequences.fingerprint").alias("fingerprint")).distinct()
    common = f.groupBy("project_id", "fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return f.join(common, ["project_id", "fingerprint"], "left_semi").select(*keys).distinct()


# ---- PRJ-29/30: resources


def exercising_sequences(docs: DataFrame) -> DataFrame:
    """PRJ-30: the verbs of each (test, resource) sequence that a production resource refers to, once for each resource."""
    r = docs.select("project_id", F.explode("doc.resource_crud.resources").alias("r"))
    refs = r.select("project_id", F.col("r.resource_key").alias("production_key"), F.explode(F.flatten(F.map_values("r.exercising_test_resources_by_operation"))).alias("x"))
    refs = refs.select("project_id", "production_key", F.col("x.test_method.qualified_class_name").alias("class_name"), F.col("x.test_method.method_signature").alias("method_signature"), F.col("x.resource_key").alias("resource_key")).distinct()
    s = tests(docs).select("project_id", F.col("identity.defining_class_name").alias("class_name"), "method_signature", F.explode("http.resource_interaction_sequences").alias("s"))
    s = s.select("project_id", "class_name", "method_signature", F.col("s.resource_key").alias("resource_key"), canonical(F.transform(_rows("s.steps"), lambda x: verb(x["http_method"])), VERBS).alias("verbs"))
    return refs.join(s, ["project_id", "class_name", "method_signature", "resource_key"])


def resource_facts(docs: DataFrame) -> DataFrame:
    """PRJ-29: per production resource, its operations and verbs: available, exercised, missing, and the verb set of each exercising sequence."""
    r = docs.select("project_id", F.explode("doc.resource_crud.resources").alias("r"))
    offered = F.transform(_rows("r.endpoints", lambda e: ~e["is_method_wildcard"]), lambda e: verb(e["http_method"]))
    r = r.select("project_id", F.col("r.resource_key").alias("production_key"), *[f"r.{c}" for c in ("available_operations", "exercised_operations", "missing_available_operations", "full_crud_test_count")], canonical(offered, VERBS).alias("available_verbs"))
    sets = exercising_sequences(docs).groupBy("project_id", "production_key").agg(F.array_sort(F.collect_list("verbs")).alias("exercising_sequence_verb_sets"))
    out = r.join(sets, ["project_id", "production_key"], "left")
    sets_ = F.coalesce("exercising_sequence_verb_sets", F.array().cast("array<array<string>>"))
    out = out.withColumn("exercising_sequence_verb_sets", sets_).withColumn("exercised_verbs", canonical(F.flatten("exercising_sequence_verb_sets"), VERBS))
    return out.withColumn("missing_available_verbs", F.array_except("available_verbs", "exercised_verbs"))


def project_gates(docs: DataFrame) -> DataFrame:
    """PRJ-32: per project, its API tests and whether any of them dispatches a request with a verb and a path."""
    t = tests(docs).filter("is_api_test")
    return t.groupBy("project_id").agg(F.count(F.lit(1)).alias("api_tests"), F.bool_or(F.coalesce("http.sequence_summary.distinct_endpoint_count", F.lit(0)) > 0).alias("has_resolved_endpoint"))
