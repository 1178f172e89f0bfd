"""The schema of a nested project document (SRC-02) and its closed vocabularies (SRC-06), stated as fixed values: names and words of the file format."""

from __future__ import annotations

STRINGS, COUNTS, RATES, SIGNALS = "array<string>", "map<string,bigint>", "map<string,double>", "map<string,array<string>>"


def _f(kind: str, *names: str) -> str:
    """Fields of one type."""
    return ",".join(f"{n}:{kind}" for n in names)


def _s(*fields: str) -> str:
    return f"struct<{','.join(fields)}>"


def _a(item: str) -> str:
    return f"array<{item}>"


# ---- calls and checks

SPAN = _s(_f("bigint", "start_line", "start_column", "end_line", "end_column"))
ORIGIN = _s(_f("string", "phase", "kind", "defining_class_name", "method_signature", "entry_defining_class_name", "entry_method_signature"), "depth:bigint", "is_group_ambiguous:boolean")
BUILDER = _s(_f("string", "method_name", "framework"), "start_line:bigint", f"contributed_properties:{STRINGS}")
_SITE = _f("string", "http_method", "path", "framework", "method_name", "receiver_type", "callee_signature")
_NAMES = _f(STRINGS, "headers", "header_names", "query_param_names", "path_param_names", "form_param_names", "auth_hints")
CALL = _s(_SITE, "request_role:string", "start_line:bigint", _NAMES, "has_body_payload:boolean", f"correlated_builder_sources:{_a(BUILDER)}")
CANDIDATE = _s(_f("string", "http_method", "path", "source"), "start_line:bigint", "path_truncated:boolean")
REQUEST = _s(f"origin:{ORIGIN}", f"http_call:{CALL}", f"endpoint_candidate:{CANDIDATE}")
MOCKED = _s(f"origin:{ORIGIN}", f"http_call:{_s(_SITE, 'start_line:bigint', 'mocking_context:' + _s(_f('string', 'framework', 'kind', 'wrapper_method')))}")
VERIFICATION = _s(f"origin:{ORIGIN}", _f("string", "assertion_role", "method_name", "framework", "response_role", "status_range"), "status_code:bigint", f"source_span:{SPAN}")
INTERACTION = _s("kind:string", f"origin:{ORIGIN}", f"source_span:{SPAN}", f"request_interaction:{REQUEST}", f"verification_interaction:{VERIFICATION}")
EXTRACTION = _s(f"origin:{ORIGIN}", _f("string", "response_role", "method_name", "framework"), f"source_span:{SPAN}")

# ---- sequences

STEP = _s(_f("bigint", "order", "status_code"), _f("string", "kind", "phase", "method_name", "framework", "http_method", "http_path", "assertion_role", "status_range"), f"origin:{ORIGIN}", f"source_span:{SPAN}", "path_truncated:boolean")
SEQUENCE = _s(_f("bigint", "order", "length"), "fingerprint:string", f"steps:{_a(STEP)}")
SEQUENCE_SUMMARY = _s(
    _f("bigint", "sequence_count", "request_build_step_count", "http_request_step_count", "response_check_step_count"),
    _f("bigint", "distinct_http_method_count", "distinct_resource_count", "distinct_endpoint_count", "distinct_sequence_fingerprint_count", "repeated_sequence_fingerprint_count"),
    "sequence_lengths:array<bigint>",
    _f("boolean", "has_multiple_sequences", "has_repeated_sequence"),
)
RESOURCE_STEP = _s(_f("string", "http_method", "path", "normalized_path", "phase", "crud_operation"), "event_order:bigint")
RESOURCE_SEQUENCE = _s("resource_key:string", f"steps:{_a(RESOURCE_STEP)}", _f(STRINGS, "exercised_operations", "available_operations", "missing_available_operations"), "lifecycle_label:string", _f("boolean", "has_read_after_write", "has_cleanup_delete"))
DISPATCH = _s(f"labels:{STRINGS}", _f("bigint", "local_request_count", "external_request_count", "unresolved_request_count"), f"signals:{SIGNALS}")
DECISION = _s("label:string", f"signals:{SIGNALS}")
HTTP = _s(
    f"request_interactions:{_a(REQUEST)}",
    f"mocked_interactions:{_a(MOCKED)}",
    f"response_extractions:{_a(EXTRACTION)}",
    f"verification_interactions:{_a(VERIFICATION)}",
    f"http_interactions:{_a(INTERACTION)}",
    f"call_sequence:{_a(STEP)}",
    f"test_sequences:{_a(SEQUENCE)}",
    f"sequence_summary:{SEQUENCE_SUMMARY}",
    f"resource_interaction_sequences:{_a(RESOURCE_SEQUENCE)}",
    f"request_dispatch:{DISPATCH}",
    f"auth_handling:{DECISION}",
)

# ---- tests and classes

IDENTITY = _s(_f("string", "defining_class_name", "method_signature", "method_declaration"), _f(STRINGS, "annotations", "thrown_exceptions"), f"parameterization:{_s('signals:' + SIGNALS)}")
LOCAL = _s(_f("bigint", "ncloc", "cyclomatic_complexity", "number_of_objects_created", "assertion_count"))
EXPANDED = _s(_f("bigint", "ncloc", "cyclomatic_complexity", "helper_method_count", "helper_method_ncloc", "test_helper_method_count", "number_of_objects_created"))
ASSERTIONS = _s(
    f"summary:{_s(_f('bigint', 'status_count', 'body_count', 'header_count', 'general_count', 'exception_count'))}",
    f"oracle_type:{DECISION}",
    f"failure_scenarios:{_s(_f('boolean', 'has_client_error_assertion', 'has_server_error_assertion', 'has_exception_assertion'))}",
    f"status_code_distribution:{_s(_f('bigint', 'range_1xx', 'range_2xx', 'range_3xx', 'range_4xx', 'range_5xx', 'unknown'))}",
    f"response_surface_labels:{STRINGS}",
    "response_surface_combination:string",
    _f(COUNTS, "status_code_counts", "status_range_counts"),
    _f("boolean", "has_status_check", "has_body_check", "has_header_check", "has_exception_check"),
)
DEPENDENCIES = _s(f"strategy:{_s(f'labels:{STRINGS}', f'signals:{SIGNALS}')}")
STATE = _s(f"preconditions:{_s('preconditions:' + _a(_s(_f('string', 'type', 'source', 'evidence'))))}", f"observations:{_s('observations:' + _a(_s(_f('string', 'medium', 'tier', 'receiver_type', 'method_name', 'evidence'), 'start_line:bigint')))}")
FIXTURE = _s(
    _f("string", "phase", "defining_class_name", "method_signature"),
    f"annotations:{STRINGS}",
    _f("bigint", "ncloc", "request_interaction_count", "verification_interaction_count", "http_interaction_count"),
    f"request_interactions:{_a(REQUEST)}",
    f"verification_interactions:{_a(VERIFICATION)}",
    f"http_interactions:{_a(INTERACTION)}",
)
TEST = _s(
    f"identity:{IDENTITY}",
    _f("boolean", "is_api_test", "is_controller_unit_test"),
    f"controller_unit_test_targets:{_a(_s(_f('string', 'declaring_class_name', 'declaring_method_signature')))}",
    f"local_metrics:{LOCAL}",
    f"expanded_metrics:{EXPANDED}",
    f"http:{HTTP}",
    f"assertions:{ASSERTIONS}",
    f"dependencies:{DEPENDENCIES}",
    f"state:{STATE}",
    f"fixtures:{_a(FIXTURE)}",
    f"ambiguous_fixture_group_methods:{_a(_s(_f('string', 'phase', 'defining_class_name', 'method_signature', 'reason')))}",
)
TEST_CLASS = _s("qualified_class_name:string", f"testing_frameworks:{STRINGS}", f"fixtures:{_a(FIXTURE)}", f"test_method_analyses:{_a(TEST)}")
TEST_REFERENCE = _s(_f("string", "qualified_class_name", "method_signature"))

# ---- endpoints, parameters, resources

PARAMETER = _s(_f("string", "name", "type", "source", "annotation"), _f("boolean", "required", "is_aggregate", "is_synthetic", "is_unscorable"))
SURFACE = _s(_f("bigint", "route_depth", "path_variable_count", "total_required_parameter_count", "total_optional_parameter_count"), f"parameter_sources:{STRINGS}", _f(COUNTS, "parameter_count_by_source", "required_parameter_count_by_source", "optional_parameter_count_by_source"))
ENDPOINT = _s(_f("string", "http_method", "path_template", "framework", "declaring_class_name", "declaring_method_signature"), "is_method_wildcard:boolean", f"parameters:{_a(PARAMETER)}", f"surface:{SURFACE}")
RESOURCE = _s(
    "resource_key:string",
    f"endpoints:{_a(ENDPOINT)}",
    _f(STRINGS, "available_operations", "exercised_operations", "missing_available_operations"),
    f"exercising_test_resources_by_operation:map<string,{_a(_s(f'test_method:{TEST_REFERENCE}', _f('string', 'resource_key', 'lifecycle_label')))}>",
    _f("bigint", "full_crud_test_count", "read_only_test_count"),
)
OUTCOMES = _s(_f("bigint", "attributed_request_count", "status_asserted_request_count", "asserting_test_method_count"), _f(COUNTS, "status_range_counts", "status_code_counts"))
COVERAGE = _s(f"endpoint:{ENDPOINT}", f"covering_test_methods:{_a(TEST_REFERENCE)}", "covering_test_method_count:bigint", "is_covered:boolean", f"asserted_outcomes:{OUTCOMES}")
PARAMETER_COVERAGE = _s(
    f"endpoint:{ENDPOINT}",
    f"parameter_evidence:{_a(_s(f'test_method:{TEST_REFERENCE}', f'exercised_parameters:{_a(PARAMETER)}'))}",
    f"parameter_entries:{_a(_s(f'parameter:{PARAMETER}', 'is_exercised:boolean', 'exercising_test_count:bigint'))}",
    _f("bigint", "exercised_parameter_count", "total_parameter_count", "required_parameter_count", "required_exercised_count", "optional_parameter_count", "optional_exercised_count"),
    _f("double", "exercise_rate", "required_exercise_rate", "optional_exercise_rate"),
    _f(RATES, "exercise_rate_by_source", "required_exercise_rate_by_source", "optional_exercise_rate_by_source"),
    _f(COUNTS, "required_parameter_count_by_source", "required_exercised_count_by_source", "optional_parameter_count_by_source", "optional_exercised_count_by_source"),
    _f("bigint", "route_covering_test_count", "observed_optional_parameter_set_limit", "distinct_observed_optional_parameter_set_count"),
    "observed_optional_parameter_sets_truncated:boolean",
    f"distinct_observed_optional_set_count_by_source:{COUNTS}",
    f"observed_optional_parameter_sets:{_a(_s(f'parameter_keys:{STRINGS}', 'test_count:bigint'))}",
    _f("bigint", "simple_1_way_optional_covered_count", "optional_pair_count", "simple_2_way_optional_covered_count", "total_2_way_optional_covered_config_count"),
    _f("double", "simple_1_way_optional_coverage", "simple_2_way_optional_coverage", "total_2_way_optional_coverage"),
    _f(COUNTS, "simple_1_way_optional_covered_count_by_source", "optional_pair_count_by_source", "simple_2_way_optional_covered_count_by_source", "total_2_way_optional_covered_config_count_by_source"),
    _f(RATES, "simple_1_way_optional_coverage_by_source", "simple_2_way_optional_coverage_by_source", "total_2_way_optional_coverage_by_source"),
)
CONTROLLER = _s(f"endpoint:{ENDPOINT}", f"exercising_test_methods:{_a(TEST_REFERENCE)}", "exercising_test_method_count:bigint")

#: SRC-02: one document per project.
PROJECT_DDL = ",".join([
    "dataset_name:string",
    f"metadata:{_s(_f('string', 'project_path', 'git_commit_hash', 'git_remote_host', 'git_repository', 'analysis_level'), 'expanded_helper_depth:bigint')}",
    f"summary:{_s(_f('bigint', 'api_test_count', 'non_api_test_count', 'controller_unit_test_count', 'total_http_interactions'), 'coverage_ratio:double')}",
    _f("bigint", "application_class_count", "application_method_count", "application_cyclomatic_complexity", "test_class_count", "test_method_count", "test_utility_class_count", "test_utility_method_count"),
    f"endpoint_coverage:{_s(_f('bigint', 'total_application_endpoints', 'covered_endpoint_count', 'untested_endpoint_count'), 'coverage_ratio:double', f'endpoints:{_a(COVERAGE)}', f'discovered_application_paths:{STRINGS}')}",
    f"endpoint_parameter_coverage:{_s(_f('bigint', 'total_endpoints_with_parameters', 'fully_exercised_endpoint_count', 'partially_exercised_endpoint_count', 'unexercised_endpoint_count', 'unscorable_endpoint_count'), f'endpoints:{_a(PARAMETER_COVERAGE)}')}",
    f"resource_crud:{_s(_f('bigint', 'total_resource_count', 'resources_with_any_test_count', 'resources_with_full_crud_test_count'), f'resources:{_a(RESOURCE)}')}",
    f"controller_unit_tests:{_s(_f('bigint', 'controller_unit_test_count', 'targeted_endpoint_count'), f'endpoints:{_a(CONTROLLER)}')}",
    f"test_class_analyses:{_a(TEST_CLASS)}",
])

# ---- closed vocabularies by the dotted path of the field

_TESTS = "test_class_analyses.test_method_analyses"
_PHASES = ("setup", "test", "teardown")
_ROLES = ("status", "body", "header", "exception", "general")
_KINDS = ("test-method", "test-helper", "fixture", "fixture-helper")
_OPERATIONS = ("create", "read", "update", "delete")
_SOURCES = ("path", "query", "header", "body", "form", "unknown")
RESPONSE_ROLES = ("inspector", "matcher", "extractor", "body-assertion", "header-assertion", "status-assertion")
DOMAINS = {
    f"{_TESTS}.http.test_sequences.steps.kind": ("request-build", "http-request", "response-check"),
    f"{_TESTS}.http.test_sequences.steps.phase": _PHASES,
    f"{_TESTS}.http.test_sequences.steps.assertion_role": _ROLES,
    f"{_TESTS}.http.request_interactions.origin.phase": _PHASES,
    f"{_TESTS}.http.request_interactions.origin.kind": _KINDS,
    f"{_TESTS}.http.request_interactions.http_call.request_role": ("builder", "event"),
    f"{_TESTS}.http.verification_interactions.origin.kind": _KINDS,
    f"{_TESTS}.http.verification_interactions.assertion_role": _ROLES,
    f"{_TESTS}.http.verification_interactions.response_role": RESPONSE_ROLES,
    f"{_TESTS}.http.http_interactions.kind": ("request", "verification"),
    f"{_TESTS}.http.mocked_interactions.http_call.mocking_context.kind": ("stubbing", "verification"),
    f"{_TESTS}.http.resource_interaction_sequences.steps.crud_operation": _OPERATIONS,
    f"{_TESTS}.http.resource_interaction_sequences.exercised_operations": _OPERATIONS,
    f"{_TESTS}.http.resource_interaction_sequences.lifecycle_label": ("read-only", "create-and-trust", "create-verify", "create-update-verify", "create-verify-cleanup", "delete-verify", "full-crud", "write-only", "other"),
    f"{_TESTS}.state.preconditions.preconditions.type": ("db-seeding", "container-bootstrap", "mq-seeding", "fs-seeding"),
    f"{_TESTS}.state.preconditions.preconditions.source": ("annotation", "programmatic"),
    f"{_TESTS}.state.observations.observations.medium": ("db", "mq", "fs"),
    f"{_TESTS}.state.observations.observations.tier": ("nested", "binding", "annotation"),
    f"{_TESTS}.fixtures.phase": _PHASES,
    "test_class_analyses.fixtures.phase": _PHASES,
    "endpoint_coverage.endpoints.endpoint.parameters.source": _SOURCES,
    "endpoint_parameter_coverage.endpoints.endpoint.parameters.source": _SOURCES,
    "resource_crud.resources.available_operations": _OPERATIONS,
    "metadata.analysis_level": ("symbol_table",),
}
