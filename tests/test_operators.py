"""Operators on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from suitestat.functions import urls as U
from suitestat.operators import aggregates as A
from suitestat.operators import coverage as C
from suitestat.operators import extract as E
from suitestat.operators import graph as H
from suitestat.operators import rules as R
from suitestat.operators import sequences as S
from suitestat.operators import stats_corpus as T
from suitestat.sources import documents as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("values, expected", [([1, 2, 3, 4], (4, 1, 4, 2.5, 1.75, 2.5, 3.25, 3.7)), ([5], (1, 5, 5, 5, 5, 5, 5, 5)), ([], (0,) + (None,) * 7)])
def test_summary(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert tuple(A.summarize(df, "v").first()) == expected


def test_share_of_nothing_is_null(spark):
    assert tuple(spark.createDataFrame([], "f boolean").agg(*A.share("f")).first()) == (0, 0, None)


def test_subsets_are_canonical():
    assert A.subsets()[:6] == ["create-only", "read-only", "update-only", "delete-only", "create-read", "create-update"] and len(A.subsets()) == 15


def test_concentration_takes_at_least_one(spark):
    df = spark.createDataFrame([(10,), (1,), (1,)], "v int")
    row = A.concentration(df, "v", percents=(1,)).first()
    assert (row["top_count"], row["share_of_total"]) == (1, 10 / 12)


def test_code_order(spark):
    df = spark.createDataFrame([("500",), ("x",), ("200",), ("99",)], "c string")
    assert [r[0] for r in df.orderBy(*A.code_order("c")).collect()] == ["99", "200", "500", "x"]


@pytest.mark.parametrize("path, expected", [
    ("/users/123", "/users/{id}"), ("/users/{userId}", "/users/{id}"), ("/users/", "/users"), ("users//1", "/users/{id}"), ("/a/%s", "/a/{id}"), ("/a/:id", "/a/{id}"),
    ("/a/**", None), ("/a/{*rest}", None), ("/a/${x}", None), ("<unknown>", None), ("", None), (None, None), ("https://example.com/a", None), ("http://localhost:8080/a/7", "/a/{id}"),
    ("//api/x", "/api/x"), ("/a?b=1#c", "/a"), ("/", "/"), ("/2024-01-02", "/{id}"), ("/a/0123456789abcdef01234567", "/a/{id}"), ("/{id:\\d{4}}", "/{id}"), ("/{a}{b}", "/{a}{b}"),
])
def test_normalize_request_path(spark, path, expected):
    assert one(spark, U.normalize_request_path(F.lit(path).cast("string"))) == expected


@pytest.mark.parametrize("path, expected", [("", "/"), ("a/b/", "/a/b"), ("/a{?x,y}", "/a"), ("http://h/a//b?q", "/a/b"), ("//a", "/a"), ("?q=1", "/"), ("//[x/a?b", "/[x/a")])
def test_normalize_path(spark, path, expected):
    assert one(spark, U.normalize_path(F.lit(path))) == expected


@pytest.mark.parametrize("url, expected", [("/x", "local"), ("x", "unknown"), ("a/b", "local"), ("http://127.0.0.1/x", "local"), ("https://example.com", "external"), ("ftp://h/x", "unknown"), ("", "unknown"), ("http://10.1.2.3", "local"), ("http://[::1]/", "local"), ("http://", "unknown"), ("http://8.8.8.8", "external")])
def test_request_target(spark, url, expected):
    assert one(spark, U.request_target(F.lit(url))) == expected


def test_url_names(spark):
    assert one(spark, U.template_variables(F.lit("/a/{id}/{x:\\d+}/{*rest}{?q}"))) == ["id", "x", "rest"]
    assert one(spark, U.query_template_names(F.lit("/a{?max,off:3,cmd*}{&b}"))) == ["max", "off", "b"]
    assert one(spark, U.query_names(F.lit("/a?x=1&y&x=2&%7A=3"))) == ["x", "y", "z"]
    assert one(spark, U.segments(F.lit("/a/{x:[/]+}/b"))) == ["a", "{x:[/]+}", "b"]
    assert one(spark, U.optional_segments(F.lit("/a{/b}"))) == ["/a", "/a/{b}"]


def test_joins_of_paths(spark):
    assert one(spark, U.join_paths(F.lit("/a/"), F.lit("b"))) == "/a/b"
    assert one(spark, U.join_request_paths(F.lit("http://h:1/a"), F.lit("/b"))) == "http://h:1/a/b"
    assert one(spark, U.join_request_paths(F.lit("/a"), F.lit("https://x/y"))) == "https://x/y"
    assert one(spark, U.strip_key_prefix(F.lit("/apiserver/x"), F.lit("/api"))) is None
    assert one(spark, U.strip_key_prefix(F.lit("/api/x"), F.lit("/api"))) == "/x"


def test_remote_identity(spark):
    for url in ("https://u:p@github.com/a/b.git", "git@github.com:a/b.git"):
        assert tuple(one(spark, U.remote_identity(F.lit(url)))) == ("github.com", "a/b")


@pytest.mark.parametrize("ops, label", [("", "other"), ("crud", "full-crud"), ("rr", "read-only"), ("cc", "create-and-trust"), ("cur", "create-update-verify"), ("cru", "other"), ("crd", "create-verify-cleanup"), ("cr", "create-verify"), ("rc", "other"), ("dr", "delete-verify"), ("cd", "write-only")])
def test_lifecycle(spark, ops, label):
    assert spark.createDataFrame([(ops,)], "ops string").select(S.lifecycle().alias("x")).first()["x"] == label


def steps(spark, kinds):
    return spark.createDataFrame([(1, 1, i, k, "GET", "/a/1", None, None) for i, k in enumerate(kinds)], "project_id int, test_id int, pos int, kind string, http_method string, http_path string, assertion_role string, status_code int")


B, Q, K = "request-build", "http-request", "response-check"


@pytest.mark.parametrize("kinds, kept", [([K, B, Q, K, K, Q, B], [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]), ([K, B], []), ([Q, Q], [(0, 1), (1, 2)]), ([B, K, Q], [(0, 1), (2, 1)]), ([], [])])
def test_segmentation(spark, kinds, kept):
    assert sorted((r["pos"], r["seq"]) for r in S.segment(steps(spark, kinds)).collect()) == kept


ENDPOINTS = "project_id int, endpoint_id int, http_method string, is_method_wildcard boolean, path_template string"


@pytest.mark.parametrize("template, path, cut, hit", [
    ("/a/{id}", "/a/7", False, 1), ("/a/{id}", "/a", False, None), ("/a/{id}", "/a", True, 1), ("/a/{id:\\\\d+}", "/a/x", False, None), ("/a/{id:\\\\d+}", "/a/12", False, 1), ("/a/{id:\\\\d+}", "/a", True, None),
    ("/a/**", "/a/b/c", False, 1), ("/a/{*rest}", "/a", False, 1), ("/f-{n}.txt", "/f-x.txt", False, 1), ("/f-{n}.txt", "/f-.txt", False, None), ("/v*/x", "/v12/x", False, 1), ("/", "/", False, 1),
    ("/api/a/{id}", "/a/7", False, 3), ("/api/a", "/a", False, None), ("/{v}/a/b", "/a/b", False, None), ("/a", "https://example.com/a", False, None),
])
def test_template_match(spark, template, path, cut, hit):
    e = spark.createDataFrame([(1, 1, "GET", False, template)], ENDPOINTS)
    r = spark.createDataFrame([(1, "get", path, cut)], "project_id int, http_method string, http_path string, path_truncated boolean")
    found = C.match(r, e).collect()
    assert [x["tier"] for x in found] == ([] if hit is None else [hit])


def test_match_tiers_and_guards(spark):
    e = spark.createDataFrame([(1, 1, "GET", False, "/x/a/b"), (1, 2, "GET", False, "/y/a/b"), (1, 3, "UNKNOWN", True, "/w"), (1, 4, "UNKNOWN", False, "/w"), (1, 5, "GET", False, "/p/q")], ENDPOINTS)
    r = spark.createDataFrame([(1, "GET", "/a/b"), (1, "POST", "/w"), (1, "UNKNOWN", "/w"), (1, "GET", "/app/p/q")], "project_id int, http_method string, http_path string")
    p = spark.createDataFrame([(1, "/app")], "project_id int, prefix string")
    # Two routes share the suffix /a/b, so neither counts.
    assert sorted((x["endpoint_id"], x["tier"]) for x in C.match(r, e, p).collect()) == [(3, 1), (5, 2)]


def test_coverage_ratio_of_nothing(spark):
    assert one(spark, C.coverage_ratio(F.lit(0), F.lit(0))) == 0.0


def test_sample_arguments(spark):
    ranked = spark.createDataFrame([(i, i) for i in range(1, 6)], "project_id int, rank int")
    with pytest.raises(ValueError):
        T.select_sample(ranked)
    assert T.select_sample(ranked, percent=1).count() == 1 and T.select_sample(ranked, percent=50).count() == 3


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "class_name string, parent string")
    found = {(r["child"], r["ancestor"]): r["depth"] for r in H.closure(e).collect()}
    assert found[("a", "c")] == 2 and found[("a", "a")] == 0 and found[("d", "d")] == 0 and len(found) == 10


def test_ncloc(spark):
    code = 'int a; // x\n/* b\n c */\n\nString s = "// no";\nString t = """\n/* text */\n""";'
    assert one(spark, H.ncloc(F.lit(code))) == 5


def test_type_name(spark):
    assert one(spark, H.type_name(F.lit("java.util.Map$Entry<K, List<V>>[]"))) == "java.util.Map.Entry"


def test_prefixes_end_at_boundaries(spark):
    assert one(spark, R.prefixes(F.lit("a.bc$D"))) == ["a", "a.bc", "a.bc$D"]


def test_appended_path(spark):
    part = lambda t, c: F.struct(F.lit(t).alias("text"), F.lit(c).alias("truncated"))
    assert one(spark, R.appended_path(F.array(part("/a/", False), part("b", True)))) == "/a/b"
    assert one(spark, R.appended_path(F.array(part("/a/", True), part("b", False)))) is None


def test_annotation_paths(spark):
    assert one(spark, E.paths(F.lit('value = {"/a", "/b"}, produces = "x"'))) == ["/a", "/b"]
    assert one(spark, E.paths(F.lit('"/c"'))) == ["/c"] and one(spark, E.paths(F.lit('produces = "x"'))) == [""]
    assert one(spark, E.annotation_name(F.lit('@org.x.GetMapping("/a")'))) == "GetMapping"


def test_documents_round_trip(spark, tmp_path):
    import json

    def empty(t):
        from pyspark.sql import types as X

        if isinstance(t, X.StructType):
            return {f.name: empty(f.dataType) for f in t.fields}
        return [] if isinstance(t, X.ArrayType) else {} if isinstance(t, X.MapType) else "s" if isinstance(t, X.StringType) else True if isinstance(t, X.BooleanType) else 1

    good = empty(D.project_schema())
    bad = dict(good)
    del bad["dataset_name"]
    bad["summary"] = {k: v for k, v in good["summary"].items() if k != "coverage_ratio"} | {"more": 1}
    for name, text in (("a", json.dumps(good)), ("b", json.dumps(bad)), ("c", "{not json"), ("d", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / D.FILE_NAME).write_text(text)
    assert D.discover(spark, str(tmp_path)).count() == 4
    parsed = D.parse(D.read_text(spark, str(tmp_path)))
    assert D.good(parsed).count() == 2 and D.quarantine(parsed, "path").count() == 2
    texts = D.good(parsed).select("path", "json")
    assert sorted(r["path"] for r in D.missing_keys(texts, "path", "json").collect()) == ["dataset_name", "summary.coverage_ratio"]
    assert [r["path"] for r in D.unknown_keys(texts, "path", "json").collect()] == ["summary.more"]


def test_statistics_sink(spark, tmp_path):
    for suite in ("dev", "agent"):
        D.write_statistics({"auth": spark.createDataFrame([("none", 1)], "label string, n int")}, str(tmp_path / suite))
    assert [r["suite"] for r in D.read_statistics(spark, str(tmp_path), "auth", "dev").collect()] == ["dev", "agent"]


def test_code_tables_by_hand(spark):
    from suitestat.operators import assertions as N
    from suitestat.operators import labels as L

    f = spark.createDataFrame
    found = E.client_kind(f([("A", '@FeignClient(name = "x", url = "http://h/a")'), ("B", "@Override")], "class_name string, annotation string")).collect()
    assert [tuple(r) for r in found] == [("A", "feign", "http://h/a")]
    body = E.body_parameters(f([("A", "m", "x", None, False), ("A", "m", "c", None, True), ("A", "n", "y", None, False)], "class_name string, method_signature string, java_name string, source string, is_context boolean"), f([("A", "m", "POST"), ("A", "n", "GET")], "class_name string, method_signature string, http_method string"))
    assert [r["name"] for r in body.collect()] == ["x"]
    beans = E.bean_parameters(f([("A", "m", "P")], "class_name string, method_signature string, type string"), f([("P", "q", "query", None), ("P", "in", None, "I"), ("I", "h", "header", None), ("I", "p", None, "P")], "type string, name string, source string, bean string"))
    assert sorted(r["name"] for r in beans.collect()) == ["h", "q"]
    headers = E.header_constants(f([("A", "HttpHeaders.ACCEPT"), ("B", "HttpHeaders.ACCEPT")], "class_name string, identifier string"), f([("A", "x.HttpHeaders")], "class_name string, path string"))
    assert [tuple(r) for r in headers.collect()] == [("A", "HttpHeaders.ACCEPT", "Accept")]
    values = H.parameter_values(f([(1, "h", ["a", "b"]), (2, "h", ["a", None])], "call_id int, callee string, values array<string>"), f([("h", 0, "x"), ("h", 1, "y")], "callee string, pos int, name string"))
    assert {r["name"]: r["value"] for r in values.collect()} == {"x": "a", "y": None}
    chain = N.status_chain(f([(1, 1, "subject", "status"), (1, 2, "verifier", None), (2, 1, "verifier", None)], "chain int, pos int, kind string, role string").withColumn("m", F.lit(1)), "m")
    assert {r["chain"]: r["in_status"] for r in chain.collect()} == {1: True, 2: False}
    for path, helper, want in (("", "/a", "/a"), ("?q", "/a", "/a?q"), ("/a", "/a/b", "/a/b"), ("/x", "/a", "/x")):
        assert one(spark, N.recovered_path(F.lit(path), F.lit(helper))) == want
    fixtures = L.applicable_fixtures(f([("A", "s", False, ["g"]), ("A", "t", False, None), ("A", "u", True, ["h"]), ("A", "v", False, ["h"])], "class_name string, method_signature string, always_run boolean, groups array<string>"), f([("A", 1, ["g"])], "class_name string, test_id int, groups array<string>"))
    assert {r["method_signature"]: r["ambiguous"] for r in fixtures.collect()} == {"s": False, "t": True, "u": False}
    seen = L.state_observations(f([(1, 1, "db", 5, 8, "x"), (1, 2, "mq", 20, 22, None), (1, 3, "fs", 30, 31, "z")], "test_id int, call_id int, medium string, start int, stop int, target string"), f([(1, 10, 12, ["x"]), (1, 19, 25, [])], "test_id int, start int, stop int, names array<string>"))
    assert {r["call_id"]: r["tier"] for r in seen.collect()} == {1: "binding", 2: "nested"}


def test_prefixes_and_production_keys(spark):
    e = spark.createDataFrame([(1, 1, "GET", False, "/v1/a/{id}"), (1, 2, "DELETE", False, "/v1/a"), (1, 3, "POST", False, "/v1/a")], ENDPOINTS)
    r = spark.createDataFrame([(1, 1, 1, "http-request", "POST", "/app/v1/a"), (1, 1, 2, "http-request", "GET", "/app/v1/a/7")], "project_id int, test_id int, pos int, kind string, http_method string, http_path string")
    none, more = (spark.createDataFrame(x, "project_id int, prefix string") for x in ([], [(1, "/app")]))
    assert [x["project_id"] for x in C.has_lead_segment(r, ["app"]).collect()] == [1] and C.has_lead_segment(r, ["v1"]).count() == 0
    assert {x["variant"]: x["covered"] for x in C.coverage_with_prefixes(r, e, none, more).collect()} == {"discovered": 0, "with-deploy-prefixes": 2}
    keyed = C.production_keys(S.resource_steps(r), C.match(r, e, more), e)
    assert {x["http_method"]: (x["resource_key"], x["production_key"], x["resolved"]) for x in keyed.collect()} == {"POST": ("/app/v1/a", "/v1/a", True), "GET": ("/app/v1/a", "/v1/a", True)}
    assert {x["grouping"]: x["read_after_write"] for x in C.grouping_comparison(keyed).collect()} == {"observed": 1, "production": 1}


def test_jax_rs_paths_of_methods(spark):
    m = spark.createDataFrame([("A", "one", "@GET"), ("A", "one", '@Path("/{id}")'), ("A", "all", "@GET"), ("A", "two", '@Path("/x")'), ("A", "two", "@POST"), ("A", "sub", '@Path("/sub")')], "class_name string, method_signature string, annotation string")
    c = spark.createDataFrame([("A", '@Path("/a")')], "class_name string, annotation string")
    got = {(r["method_signature"], r["http_method"], r["path_template"]) for r in E.endpoints(m, c).collect()}
    assert got == {("one", "GET", "/a/{id}"), ("all", "GET", "/a"), ("two", "POST", "/a/x")}


def test_deep_nesting_is_whole(spark):
    beans = spark.createDataFrame([("A", "m", "T0")], "class_name string, method_signature string, type string")
    fields = [(f"T{i}", f"f{i}", "query", None) for i in range(8)] + [(f"T{i}", "in", None, f"T{(i + 1) % 8}") for i in range(8)]
    got = E.bean_parameters(beans, spark.createDataFrame(fields, "type string, name string, source string, bean string")).collect()
    assert sorted(r["name"] for r in got) == [f"f{i}" for i in range(8)]
    roots = spark.createDataFrame([("C0", "/r")], "class_name string, mount string")
    steps = [(f"C{i}", f"p{i}", f"C{i + 1}") for i in range(10)] + [("C10", "back", "C0")]
    got = {r["class_name"]: r["mount"] for r in E.mounts(spark.createDataFrame(steps, "class_name string, path string, target string"), roots).collect()}
    assert len(got) == 11 and got["C10"] == "/r/" + "/".join(f"p{i}" for i in range(10))
    names = [("k0", [("literal", "/v")])] + [(f"k{i}", [("reference", f"k{i - 1}")]) for i in range(1, 20)]
    got = {r["name"]: r["value"] for r in H.resolve_constants(spark.createDataFrame(names, "name string, tokens array<struct<kind:string,text:string>>")).collect()}
    assert set(got.values()) == {"/v"}
    up = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(36)], "class_name string, parent string")
    assert H.closure(up).filter("child = 'c0'").count() == 37
    with pytest.raises(RuntimeError, match="settle"):
        H.closure(up, max_depth=3)


def test_tables_of_a_document(spark):
    import json

    from suitestat.sources import facts as P

    test = {"identity": {"defining_class_name": "C", "method_signature": "m"}, "is_api_test": True, "http": {"sequence_summary": {"distinct_endpoint_count": 1}, "resource_interaction_sequences": [{"resource_key": "/a", "steps": [{"http_method": "POST", "phase": "test"}, {"http_method": "UNKNOWN", "phase": "setup"}]}, {"resource_key": "/b", "steps": []}]}}
    other = {"identity": {"defining_class_name": "C", "method_signature": "n"}}
    ref = {"test_method": {"qualified_class_name": "C", "method_signature": "m"}, "resource_key": "/a"}
    doc = {
        "test_class_analyses": [{"qualified_class_name": "C", "testing_frameworks": ["junit5"], "fixtures": [{"phase": "setup"}], "test_method_analyses": [test, other]}],
        "endpoint_coverage": {"endpoints": [{"endpoint": {"http_method": "GET", "path_template": "/a"}, "is_covered": True}]},
        "endpoint_parameter_coverage": {"endpoints": [{"exercise_rate": 0.5, "exercise_rate_by_source": {"query": 0.5}, "optional_exercise_rate": None}]},
        "resource_crud": {"resources": [{"resource_key": "/a", "endpoints": [{"http_method": "post", "is_method_wildcard": False}, {"http_method": "GET", "is_method_wildcard": False}], "exercising_test_resources_by_operation": {"create": [ref], "read": [ref]}}, {"resource_key": "/c"}]},
    }
    texts = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}")], "project_id long, json string")
    docs = D.good(D.parse(texts))
    facts = {r["method_signature"]: r for r in P.test_facts(P.tests(docs)).collect()}
    m, n = facts["m"], facts["n"]
    assert (m["distinct_resource_count"], m["method_resolved_distinct_resource_count"], m["unresolved_resource_crud_sequence_count"], m["resource_crud_combinations"]) == (2, 1, 2, [])
    assert n["is_api_test"] is None and n["event_counts"] == [0, 0, 0] and n["http_sequence_status_ranges"] == [] and not n["is_parameterized"]
    c = P.test_classes(docs).first()
    assert (c["api_test_count"], c["fixture_count"]) == (1, 1)
    assert P.endpoints(docs).first()["is_covered"] and P.endpoint_parameters(docs).first()["exercise_rate_by_source"] == {"query": 0.5}
    assert [tuple(r) for r in P.project_gates(docs).collect()] == [(1, 1, True)]
    r = {x["production_key"]: x for x in P.resource_facts(docs).collect()}
    assert (r["/a"]["available_verbs"], r["/a"]["exercised_verbs"], r["/a"]["missing_available_verbs"], r["/a"]["exercising_sequence_verb_sets"]) == (["GET", "POST"], ["POST"], ["GET"], [["POST"]])
    assert r["/c"]["exercising_sequence_verb_sets"] == [] and P.shared_sequences(P.tests(docs)).count() == 0


def test_urls_without_a_query(spark):
    assert [one(spark, U.is_external_url(F.lit(u))) for u in ("http://a.example/x", "http://localhost/x", "/x", "ftp://a.example")] == [True, False, False, False]
    assert [one(spark, U.join_parts(F.lit(a), F.lit(b))) for a, b in (("a/", "/b"), ("", "b"), ("a", ""))] == ["a/b", "b", "a"]
    assert [one(spark, U.in_test_directory(F.lit(f), ["src/test"])) for f in ("a\\src\\test\\B.java", "src/tests/B.java")] == [True, False]
    assert [one(spark, U.test_scope_rule(F.lit(f))) for f in ("src/itTest/java/A.java", "it/A.java", "src/main/ATest.java", "src/main/A.java")] == ["source-set", "test-directory", "file-name", None]


def test_small_operators(spark):
    from suitestat.operators import labels as L

    f = spark.createDataFrame
    shares = A.complete_shares(f([("a", 1)], "k string, n int"), "k", ["a", "b"], F.lit(2)).orderBy("rank").collect()
    assert [(r["k"], r["n"], r["proportion"]) for r in shares] == [("a", 1, 0.5), ("b", 0, 0.0)]
    assert [one(spark, C.methods_match(F.lit(p), F.lit(w), F.lit(o))) for p, w, o in (("get", False, "GET"), ("UNKNOWN", True, "PUT"), ("UNKNOWN", False, "PUT"), ("GET", False, None))] == [True, True, False, False]
    whole = T.full_traversal(f([(1, "/a", ["GET", "POST"]), (1, "/b", ["GET"])], "project_id int, resource_key string, verbs array<string>"), f([(1, "/a", ["GET"]), (1, "/b", ["GET", "PUT"])], "project_id int, resource_key string, available_verbs array<string>"))
    assert tuple(whole.first()) == (2, 1)
    mocked = L.mocked_calls(f([(1, "when"), (2, "get"), (3, "verify"), (4, "post"), (5, "put")], "call_id int, method_name string"), f([(2, 1), (4, 3), (5, 2)], "call_id int, parent_id int"))
    assert {r["method_name"]: r["mocking"] for r in mocked.collect()} == {"get": "stubbing", "post": "verification"}
    total = H.runtime_metrics(f([("t", "h"), ("t", "h")], "root string, callee string"), f([("t", 5), ("h", 2)], "method string, ncloc int"), "ncloc")
    assert [tuple(r) for r in total.collect()] == [("t", 9)]


def test_form_names_and_frameworks(spark):
    from suitestat.operators import verbs as V

    names = lambda f, m, *a: one(spark, V.form_names(F.lit(f), F.lit(m), F.array(*[F.lit(x) for x in a])))
    assert names("rest-assured", "formParam", '"a"', "x") == ["a"] and names("mockmvc", "multipart", '"/up"') == []
    assert names("rest-assured", "formParams", '"a"', "1", '"b"', '"v"', '"a"', "2") == ["a", "b"]
    assert names("rest-assured", "multiPart", '"f"') == ["f"] and names("mockmvc", "file", 'new MockMultipartFile("p", b)') == ["p"]
    assert names("webclient", "body", 'BodyInserters.fromFormData("u", "v").with("w", "x")') == ["u", "w"] and names("webclient", "body", "x") == []
    pairs = [("okhttp", "okhttp"), ("rest-template", "test-rest-template"), ("okhttp", "feign"), (None, "feign")]
    assert [one(spark, V.frameworks_match(F.lit(a).cast("string"), F.lit(b))) for a, b in pairs] == [True, True, False, False]
