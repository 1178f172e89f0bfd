"""Call sites: the rule table, passes and builders on hand-made and drawn calls, against plain walks and queues."""

import random

import pytest
from pyspark.sql import functions as F

from suitestat.operators import classification as C
from suitestat.operators import correlation as B
from suitestat.operators import families as K
from suitestat.operators.spans import nest

CALL = "k int, call_id bigint, start bigint, stop bigint, line int, method_name string, receiver_type string, receiver_expr string, args array<string>, arg_types array<string>, values array<string>, is_constructor boolean, callee_signature string"
RA = "io.restassured.specification.RequestSpecification"


def frame(spark, rows):
    """rows: (k, call_id, start, stop, method, receiver, expr, args)."""
    return spark.createDataFrame([(k, i, a, b, (a or 0) // 100, m, r, e, args, [], [], False, "") for k, i, a, b, m, r, e, args in rows], CALL)


# ---- the table


def test_rules_are_ordered_where_they_differ():
    # The only types that two families answer for differently: a response is checked before it is read, and a body's own readers are extractors in both families.
    assert {tuple(f) for _, _, f in K.conflicts()} == {
        ("rest-assured.body_assertion", "rest-assured.response_extractor"),
        ("rest-assured.status_assertion", "rest-assured.response_extractor"),
        ("webtestclient.response_extractor", "webtestclient.body_assertion"),
    }
    twice = (K.Family("a", "a.x", "p.T", ((K.EVENT, "go"),)), K.Family("b", "b.x", "p.T", ((K.BUILDER, "go stay"),)))
    assert K.conflicts(twice) == [("p.t", "go", ["a.x", "b.x"])]


def test_one_family_answers(spark):
    cases = [
        ("io.restassured.RestAssured", "get", False, ("rest-assured.request_factory", "event", None, "GET")),
        ("io.restassured.RestAssuredX", "get", False, None),
        ("IO.restassured.response.ValidatableResponse", "Header", False, ("rest-assured.body_assertion", None, "header-assertion", "UNKNOWN")),
        ("org.springframework.test.web.reactive.server.WebTestClient$ResponseSpec", "expectBody", False, ("webtestclient.matcher_root", None, "matcher", "UNKNOWN")),
        ("org.springframework.test.web.reactive.server.WebTestClient$ResponseSpec", "bindToServer", False, ("webtestclient.request_factory", "builder", None, "UNKNOWN")),
        ("org.springframework.test.web.reactive.server.StatusAssertions", "anything", False, ("webtestclient.status_assertion", None, "status-assertion", "UNKNOWN")),
        ("org.apache.hc.client5.http.classic.methods.HttpPatch", "HttpPatch", True, ("apache-httpclient.request", "builder", None, "PATCH")),
        ("org.apache.hc.client5.http.classic.methods", "get", False, None),
        ("org.apache.hc.client5.http.async.methods.SimpleHttpRequest", "SimpleHttpRequest", True, ("apache-httpclient.request", "builder", None, "UNKNOWN")),
        ("com.intuit.karate.Http", "postJson", False, ("karate.request", "event", None, "POST")),
        ("com.intuit.karate.Http$Sub", "postJson", False, None),
        ("okhttp3.Request", "newBuilder", None, ("okhttp.request", "builder", None, "UNKNOWN")),
        ("", "get", False, None),
        (None, "get", False, None),
        ("java.net.http.HttpRequest", None, False, None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, receiver_type string, method_name string, is_constructor boolean")
    got = {r["i"]: r for r in K.resolve(df).collect()}
    for i, (*_, want) in enumerate(cases):
        r = got[i]
        assert (tuple(r[c] for c in ("family", "request_role", "response_role", "verb")) if r["family"] else None) == want, cases[i]
    assert K.resolve(df.limit(0)).count() == 0
    held = {r["receiver_type"]: r["holds_path"] for r in K.holds_path(df).collect()}
    assert held["okhttp3.Request"] and held["com.intuit.karate.Http"] and not held["io.restassured.RestAssured"] and "com.intuit.karate.Http$Sub" not in held


# ---- nesting


def test_nesting_of_drawn_spans(spark):
    rng = random.Random(5)
    rows = [(m if m else None, c, a, a + rng.randrange(9)) for m in range(60) for c in range(rng.randrange(1, 14)) for a in [rng.randrange(12)]] + [(99, 0, None, 3), (99, 1, 0, 9)]
    df = spark.createDataFrame(rows, "m int, call_id int, start int, stop int")
    got = {(r["m"], r["call_id"]): r for r in nest(df.withColumn("w", F.lit(True)), "m", wanted="w").collect()}
    for m, c, a, b in rows:
        if a is None:
            assert got[m, c]["parent_id"] is None
            continue
        outer = [(q - p, i, p) for n, i, p, q in rows if n == m and p is not None and p <= a and q >= b and (p < a or q > b)]
        assert got[m, c]["parent_id"] == min(outer, default=(0, None))[1]


def test_a_hundred_thousand_spans_in_one_method(spark):
    n = 100_000
    i = F.col("id")
    deep = i < n // 2
    df = spark.range(n).select(F.lit(0).alias("m"), i.alias("call_id"), F.when(deep, i).otherwise(i * 3).alias("start"), F.when(deep, n - i).otherwise(i * 3 + 1).alias("stop"))
    assert nest(df, "m").filter("parent_id is not null").count() == n // 2 - 1
    chain = spark.range(n).select(F.lit(0).alias("m"), i.alias("call_id"), F.lit(5).alias("start"), (i + 10).alias("stop"))
    assert nest(chain, "m").filter("host_id is not null").count() == 0


# ---- passes


def test_what_is_lost_is_inferred_from_one_framework_only(spark):
    web, mvc = "org.springframework.web.reactive.function.client.WebClient", "org.springframework.test.web.servlet.request.MockMvcRequestBuilders"
    rows = [
        # An argument shows the framework: perform(get("/a")) on an unknown receiver.
        (1, 0, 0, 50, "perform", "", "mvc", ["get(...)"]), (1, 1, 12, 40, "get", mvc, "", ['"/a"']),
        # Two frameworks in the arguments show none.
        (2, 0, 0, 90, "perform", "", "mvc", ["x", "y"]), (2, 1, 12, 40, "get", mvc, "", ['"/a"']), (2, 2, 50, 80, "get", web, "", []),
        # After an event nothing is left to infer from.
        (3, 0, 0, 10, "get", web, "", []), (3, 1, 0, 20, "retrieve", web + "$RequestHeadersSpec", "", []), (3, 2, 0, 30, "exchange", "", "", []),
        # What is inferred is evidence in turn.
        (4, 0, 0, 10, "get", web, "", []), (4, 1, 0, 20, "uri", "", "", ['"/b"']), (4, 2, 0, 30, "cookie", None, "", ['"c"']), (4, 3, 0, 40, "retrieve", "", "", []), (4, 4, 0, 50, "uri", "", "", ['"/no"']),
    ]
    got = {(r["k"], r["call_id"]): (r["framework"], r["request_role"], r["path"]) for r in C.classify(frame(spark, rows), "k").collect()}
    assert got[1, 0] == ("mockmvc", "event", "") and got[2, 0] == (None, None, None)
    assert got[3, 2] == (None, None, None)
    assert [got[4, i] for i in (1, 2, 3, 4)] == [("webclient", "builder", "/b"), ("webclient", "builder", ""), ("webclient", "event", ""), (None, None, None)]


def test_paths_and_names_of_arguments(spark):
    spec = [
        ("post", "io.restassured.specification.RequestSender", ['"http://localhost:" + port + "/x/" + id'], "/x/", True),
        ("post", "io.restassured.specification.RequestSender", ['"http://localhost:8080/"'], "", False),
        ("post", "io.restassured.specification.RequestSender", ['"users/all"'], "/users/all", False),
        ("post", "io.restassured.specification.RequestSender", ['"users"'], "", False),
        ("post", "io.restassured.specification.RequestSender", ["path"], "", False),
        ("contentType", RA, ['"application/json"'], "", False),
        ("basePath", RA, ['"api"'], "/api", False),
        ("uri", "org.springframework.web.client.RestClient$UriSpec", ['b -> b.path("/q").queryParam("n", 1).build()'], "/q", False),
    ]
    rows = [(i, 0, 0, 9, m, r, "", a) for i, (m, r, a, _, _) in enumerate(spec)]
    df = frame(spark, rows).withColumn("values", F.when(F.col("k") == 4, F.array(F.lit("/const"))).otherwise(F.col("values")))
    got = {r["k"]: r for r in C.classify(df, "k").collect()}
    for i, (_, _, _, path, cut) in enumerate(spec):
        assert (got[i]["path"], got[i]["truncated"]) == (("/const", False) if i == 4 else (path, cut)), spec[i]
    assert got[7]["query_names"] == ["n"] and got[5]["header_names"] == ["content-type"]


@pytest.mark.parametrize(
    ("expression", "name"),
    [('"X-A"', "x-a"), ("HttpHeaders.CONTENT_TYPE", "content-type"), ("CONTENT_TYPE", "content-type"), ("MY_HEADER", None), ("HttpHeaders.EMPTY", None), ("p + HttpHeaders.ACCEPT", None), ('new Header("T", v)', "t"), ('new BasicHeader(n, "v")', None), ("requestDATE", None), ("", None)],
)
def test_header_names(spark, expression, name):
    assert spark.createDataFrame([(expression,)], "x string").select(C.header_name(F.col("x"))).first()[0] == name


@pytest.mark.parametrize(
    ("framework", "m", "verb", "args", "want"),
    [
        ("rest-template", "exchange", "POST", ["u", "HttpMethod.POST", "new HttpEntity<>(dto)"], True), ("rest-template", "exchange", "POST", ["u", "v", "new HttpEntity<>()"], False), ("rest-template", "exchange", "POST", ["u", "v", "new HttpEntity<>(null, h)"], False),
        ("rest-template", "exchange", "GET", ["u", "v", "e"], False), ("rest-template", "exchange", "PUT", ["u", "v", "HttpEntity.EMPTY"], False), ("rest-template", "postforobject", "POST", ["u"], False), ("rest-template", "put", "PUT", ["u", "b"], True),
        ("java-httpclient", "post", "POST", ["BodyPublishers.noBody()"], False), ("java-httpclient", "method", "PUT", ['"PUT"', "publisher"], True), ("okhttp", "post", "POST", ["b"], True), ("micronaut-client", "delete", "DELETE", ["u"], False), ("micronaut-client", "post", "POST", ["u", "b"], True),
        ("karate", "method", "POST", ['"POST"'], False), ("karate", "delete", "DELETE", ["b"], True), ("jax-rs", "method", "POST", ['"POST"', "Entity.json(d)"], True), ("jax-rs", "method", "GET", ['"GET"', "X.class"], False), ("mockmvc", "content", "X", ["b"], True), ("mockmvc", "content", "X", [], False), (None, "get", "GET", [], False),
    ],
)
def test_bodies(spark, framework, m, verb, args, want):
    df = spark.createDataFrame([(framework, m, verb, args)], "f string, m string, v string, a array<string>")
    assert df.select(C.has_body(F.col("f"), F.col("m"), F.col("v"), F.col("a"), F.lit("x"))).first()[0] is want


# ---- chains that wait


def queue(items):
    """A plain queue: items in order, (cls, chain, event, open, receiver, names, base)."""
    waiting, out = [], {}
    for cls, chain, event, open_, receiver, names, base in items:
        if event is None:
            waiting.append((cls, chain, set(names), base))
            continue
        mine = [w for w in waiting if w[0] == cls]
        taken = []
        if open_:
            taken = mine
        elif cls == "rest-assured" and mine:
            matched = [w for w in mine if receiver and receiver in w[2]]
            unnamed = [w for w in mine if not w[2]]
            if matched:
                taken = matched
            elif not (receiver and any(w[2] for w in mine)) and any(w[3] for w in unnamed):
                taken = unnamed[:1]
        for w in taken:
            out[w[0], w[1]] = event
            waiting.remove(w)
    return out


def test_waiting_chains_as_a_plain_queue(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for k in range(150):
        items = []
        for pos in range(rng.randrange(1, 30)):
            cls = rng.choice(["rest-assured", "rest-assured", "okhttp"])
            if rng.random() < 0.6:
                items.append((cls, pos, None, False, "", rng.sample(["a", "b", "c"], rng.choice([0, 0, 1, 2])), rng.random() < 0.5))
            else:
                items.append((cls, pos, pos, rng.random() < 0.3, rng.choice(["", "a", "b", "z"]), [], False))
        rows += [(k, *x[:2], x[1], *x[2:]) for x in items]
        want |= {(k, *c): e for c, e in queue(items).items()}
    df = spark.createDataFrame(rows, "k int, cls string, chain bigint, stop bigint, event_id bigint, open boolean, receiver string, names array<string>, base boolean")
    got = {(r["k"], r["cls"], r["chain"]): r["event_id"] for r in B.drained(df, "k").collect()}
    assert got == want and len(got) > 200
    assert B.drained(df.limit(0), "k").count() == 0


def test_a_named_specification_goes_to_the_event_that_names_it(spark):
    rows = [
        (1, 0, 0, 10, "given", "io.restassured.RestAssured", "", []), (1, 1, 0, 30, "header", RA, "", ['"X-S"', "v"]),
        (1, 2, 100, 130, "get", RA, "other", ['"/o"']), (1, 3, 200, 230, "get", RA, "spec", ['"/s"']),
    ]
    declared = spark.createDataFrame([(1, "spec", 0, 30, "given().header()"), (1, "none", 0, 99, " ")], "k int, name string, start bigint, stop bigint, initializer string")
    calls = C.classify(frame(spark, rows), "k")
    events, sources = B.correlate(calls, "k", declarations=declared)
    assert {r["call_id"]: r["header_names"] for r in events.collect()} == {2: [], 3: ["x-s"]}
    assert [(r["event_id"], r["builder_id"], r["properties"]) for r in sources.collect()] == [(3, 1, ["header_names"])]
    defaults = spark.createDataFrame([(1, "baseuri", "http://localhost/base"), (1, "basepath", "/v1")], "k int, key string, path string")
    paths = {r["call_id"]: r["path"] for r in B.correlate(calls, "k", static_bases=defaults)[0].collect()}
    assert paths == {2: "http://localhost/base/v1/o", 3: "http://localhost/base/v1/s"}


def test_odd_calls(spark):
    rows = [(None, 0, 0, 10, None, None, None, None), (1, 1, None, None, "get", RA, None, [None]), (1, 2, 5, 9, "get", RA, "", ['"/x"']), (1, 2, 5, 9, "get", RA, "", ['"/x"']), (1, 3, 5, 9, "get", RA, "", ["x" * 100_000])]
    df = frame(spark, rows).withColumn("extra", F.lit("kept"))
    calls = C.classify(df, "k")
    got = calls.collect()
    assert len(got) == 4 and all(r["extra"] == "kept" for r in got)
    events, _ = B.correlate(calls, "k")
    assert {r["call_id"]: r["path"] for r in events.collect()} == {1: "", 2: "/x", 3: ""}
    empty = C.classify(df.limit(0), "k")
    assert empty.count() == 0 and B.correlate(empty, "k")[0].count() == 0
