"""Work that grows with the result: no pairs or paths on the way that the result doesn't hold."""

import random
import re

from pyspark.sql import functions as F

from suitestat.functions import lineage
from suitestat.operators import classification as K
from suitestat.operators import coverage as C
from suitestat.operators import extract as E
from suitestat.operators import graph as H
from suitestat.operators import parameters as P
from suitestat.operators import resolution as R
from suitestat.sources import documents as D

ENDPOINTS = "project_id int, endpoint_id int, http_method string, is_method_wildcard boolean, path_template string"


def test_requests_meet_groups_of_endpoints(spark):
    e = spark.createDataFrame([(1, i, "GET", False, "/a/{id}") for i in range(40)] + [(1, 0, "GET", False, "/a/b"), (1, 99, "POST", False, "/a")], ENDPOINTS)
    r = spark.createDataFrame([(1, t, "GET", p) for t in (1, 2) for p in ("/a/b", "/a/c", "/a/c")], "project_id int, test_id int, http_method string, http_path string")
    hits = C.match_groups(r, e)
    # Two groups have the template: endpoint 0 has two templates, 39 endpoints one. They don't become 40 rows a request.
    assert hits.count() == 4
    assert C.match(r, e).count() == 80
    got = {x["endpoint_id"]: (x["covering_tests"], x["requests"]) for x in C.endpoint_coverage(e, r, hits).collect()}
    # A request that matches both templates of endpoint 0 counts once.
    assert got == {i: (2, 6) for i in range(40)} | {99: (0, 0)}


def test_a_large_group_meets_requests_in_parts(spark):
    n = 2 * C.GROUP_PART + 7
    e = spark.range(n).select(F.lit(1).alias("project_id"), F.col("id").alias("endpoint_id"), F.lit("GET").alias("http_method"), F.lit(False).alias("is_method_wildcard"), F.lit("/a").alias("path_template"))
    m = C.match(spark.createDataFrame([(1, "GET", "/a"), (1, "get", "/a")], "project_id int, http_method string, http_path string"), e)
    assert m.count() == m.distinct().count() == 2 * n


def test_beans_that_all_hold_each_other(spark):
    n = 14  # 14 beans have more than 10**10 paths
    rows = [(f"T{i}", None, None, f"T{j}") for i in range(n) for j in range(n) if i != j] + [(f"T{i}", f"f{i}", "header", None) for i in range(n)]
    beans = spark.createDataFrame([("A", "m", "T0"), ("A", "k", "U")], "class_name string, method_signature string, type string")
    got = E.bean_parameters(beans, spark.createDataFrame(rows, "type string, name string, source string, bean string")).collect()
    assert sorted((r["method_signature"], r["name"], r["is_unscorable"]) for r in got) == [("k", "U", True)] + sorted(("m", f"f{i}", False) for i in range(n))


def test_helpers_without_paths(spark):
    draw = random.Random(5)
    edges = sorted({(draw.randrange(30), draw.randrange(25)) for _ in range(70)})
    calls = spark.createDataFrame(edges, "owner int, callee int")
    roots = calls.select(F.col("owner").alias("root")).distinct()
    for depth in (0, 1, 3):
        want = {r["root"]: r["helpers"] for r in H.distinct_helpers(H.expand(calls, roots, depth)).collect()}
        assert {r["root"]: r["helpers"] for r in H.helper_counts(calls, roots, depth).collect()} == want
    # All of 300 methods call all: 300**5 paths.
    n = 300
    every = spark.range(n * n).select((F.col("id") / n).cast("int").alias("owner"), (F.col("id") % n).cast("int").alias("callee"))
    got = H.helper_counts(every, spark.createDataFrame([(0,), (1,)], "root int")).collect()
    assert sorted((r["root"], r["helpers"]) for r in got) == [(0, n), (1, n)]


def test_callees_do_not_meet_methods_by_signature_alone(spark):
    calls = spark.createDataFrame([(1, "B", "", "super", "m"), (2, "B", "", "", "m"), (3, "B", "B", "", "m")], "call_id int, owner string, receiver_type string, receiver_expr string, callee_signature string")
    order = R.resolution_order(spark.createDataFrame([("B", "A", "extends", 0)], "class_name string, parent string, kind string, place int"))
    methods = spark.createDataFrame([("A", "m", True), ("B", "m", True)], "class_name string, method_signature string, has_code boolean")
    d = R.callees(calls, order, methods)
    assert {r["call_id"]: r["target"] for r in d.collect()} == {1: "A", 2: "B", 3: "B"}
    assert not re.search(r"Join \[callee_signature#\d+\], \[callee_signature#\d+\]", d._jdf.queryExecution().sparkPlan().toString())


def test_methods_with_the_same_calls_are_classified_once(spark):
    mvc = "org.springframework.test.web.servlet.request.MockMvcRequestBuilders"
    call = "k int, call_id int, start int, stop int, line int, method_name string, receiver_type string, receiver_expr string, args array<string>, arg_types array<string>, values array<string>, is_constructor boolean, callee_signature string"
    body = lambda k, path: [(k, 0, 0, 50, 1, "perform", "", "mvc", ["get(...)"], [], None, False, ""), (k, 1, 12, 40, 1, "get", mvc, "", [path], [], None, None, "")]
    rows = [r for k in range(40) for r in body(k, '"/a"')] + body(50, '"/b"') + body(51, '"/b"')[::-1] + body(None, '"/c"') + body(None, '"/c"')
    # A method that lacks a call, and one whose call has another text in another column, have bodies of their own; so has one that repeats a call.
    rows += body(60, '"/a"')[1:] + [(61, 0, 0, 50, 1, "perform", "", "mvc", [], ["get(...)"], None, False, ""), *body(61, '"/a"')[1:]] + body(62, '"/a"') + body(62, '"/a"')[:1]
    calls = spark.createDataFrame(rows, call)
    seen = []

    def of(d):
        seen.append(d.count())
        return K.classify(d, "k").select("k", "call_id", "framework", "request_role", "path")

    got = K.once_a_body(calls, of, "k")
    assert seen == [2 + 2 + 1 + 2 + 3 + 4]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, K.classify(calls, "k").select("k", "call_id", "framework", "request_role", "path").collect()))


def test_rounds_over_classes_broadcast_nothing(spark, monkeypatch):
    plans = []
    for module in (H, E):
        cut = module.cut
        monkeypatch.setattr(module, "cut", lambda d, cut=cut: (plans.append(d._jdf.queryExecution().executedPlan().toString()), cut(d))[1])
    assert H.closure(spark.createDataFrame([(1, 2), (2, 3)], "class_name int, parent int")).count() == 6
    steps = spark.createDataFrame([("A", "x", "B"), ("B", "y", "C")], "class_name string, path string, target string")
    assert E.mounts(steps, spark.createDataFrame([("A", "/a")], "class_name string, mount string")).count() == 3
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)


def _physical(d):
    return d._jdf.queryExecution().sparkPlan().toString()


def test_ancestors_stream_past_the_facts_of_classes(spark):
    up = spark.createDataFrame([("a", "a", 0), ("a", "P", 1), ("b", "P", 2), ("b", "Q", 1), ("a", None, 1)], "child string, ancestor string, depth int")
    i = spark.createDataFrame([("P", "x", False, False), ("P", "y", True, False), ("P", "x", False, False), ("Q", "x", False, False), (None, "z", False, True)], "class_name string, path string, is_static boolean, is_wildcard boolean")
    d = H.imports_of(i, up)
    assert sorted((str(r["class_name"]), r["path"]) for r in d.collect()) == [("None", "z"), ("P", "x"), ("P", "y"), ("Q", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    # Imports open once they are dealt by the class that has them, not where ancestors meet.
    plan = _physical(d)
    assert "ShuffledHashJoin" in plan and plan.index("Generate explode(_i") < plan.index("ShuffledHashJoin")
    m = spark.createDataFrame([("P", "m()", "BeforeEach"), ("Q", "m()", "BeforeEach")], "class_name string, method_signature string, annotation string")
    d = H.fixtures(up, m, spark.createDataFrame([("BeforeEach", "setup")], "annotation string, phase string"))
    assert sorted((r["child"], r["ancestor"], r["place"]) for r in d.collect()) == [("a", "P", 1), ("b", "Q", 1)]
    assert "ShuffledHashJoin" in _physical(d)


def test_annotations_meet_ancestors_unsorted(spark):
    up = spark.createDataFrame([("a", "P", 1), ("b", "P", 2), ("b", "Q", 1)], "child string, ancestor string, depth int")
    a = spark.createDataFrame([("P", "m()", 0, "RequestParam", "p"), ("Q", "m()", 0, "RequestParam", "q")], "class_name string, method_signature string, pos int, short_name string, annotation string")
    d = E.inherited_parameter_annotations(up, a)
    assert sorted((r["class_name"], r["annotation"]) for r in d.collect()) == [("a", "p"), ("b", "q")]
    assert "ShuffledHashJoin" in _physical(d)


def test_requests_stream_past_the_parameters_of_endpoints(spark):
    p = spark.createDataFrame([(1, "a", "query", False), (1, "b", "query", False), (1, "B", "query", False), (1, "c", "header", True), (2, "a", "path", True)], "endpoint_id int, name string, source string, required boolean")
    r = spark.createDataFrame([(1, 7, 1, ["a"], []), (1, 7, 1, ["B", "a"], ["c"]), (1, 7, 2, None, None), (2, 7, 3, [], []), (None, 7, 4, [], []), (3, 7, 5, ["a"], [])], "endpoint_id int, test_id int, request_id int, query_names array<string>, header_names array<string>")
    r = r.withColumn("form_names", F.lit(None).cast("array<string>")).withColumn("has_body", F.lit(False))
    used = P.exercised(r, p)
    # A request that comes twice, with other names, is one; keys that differ in case only are one.
    assert sorted((x["endpoint_id"], x["request_id"], x["key"]) for x in used.collect()) == [(1, 1, "header:c"), (1, 1, "query:a"), (1, 1, "query:b"), (2, 3, "path:a")]
    plan = _physical(used)
    assert "ShuffledHashJoin" in plan and "Aggregate" not in plan[: plan.index("ShuffledHashJoin")]
    sets = P.optional_sets(r, used, p)
    found = {(x["endpoint_id"], tuple(x["present"]), x["tests"]) for x in sets.collect()}
    assert found == {(1, ("query:a", "query:b"), 1), (1, (), 1), (2, (), 1), (None, (), 1), (3, (), 1)}
    assert [tuple(x) for x in P.one_way(sets, p).collect()] == [(1, 2, 2)]
    assert [tuple(x) for x in P.two_way(sets, p).collect()] == [(1, 0, 2, 1)]
    # A request's keys and the request meet by a grouping, not by a join.
    assert len(re.findall("Join", _physical(sets))) == 2


def test_missing_keys_without_a_row_for_each_field(spark):
    schema = D.StructType.fromDDL("a int, s struct<b: int, t: array<struct<c: int, d: int>>>")
    texts = ['{"a": null, "s": {"b": 1, "t": [{"c": 1}, {"d": 1}]}, "x": {"t": [{}]}}', '[{"a": 1}]', '{"a": 1, "s": 5}', "{broken", None, '{"a": 1, "s": [[{"b": 1}]]}']
    d = D.missing_keys(spark.createDataFrame(list(enumerate(texts)), "k int, json string"), "k", "json", schema)
    want = [(0, "s.t.c"), (0, "s.t.d"), (1, "a"), (1, "s"), (3, "a"), (3, "s"), (4, "a"), (4, "s"), (5, "s.t")]
    assert sorted((r["key"], r["path"]) for r in d.collect()) == want
    assert "Join" not in _physical(d)


def test_a_text_is_parsed_once(spark):
    texts = spark.createDataFrame([(1, '{"dataset_name": "p"}'), (2, "[1]"), (3, None), (4, "{x")], "k int, json string")
    d = D.good(D.parse(texts)).select("k", "doc.dataset_name")
    assert [tuple(r) for r in d.collect()] == [(1, "p")]
    assert _physical(d).count("from_json(") == 1


def _shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_helpers_of_a_root_are_not_shuffled(spark, monkeypatch):
    draw = random.Random(7)
    edges = [(10**6 + m, draw.randrange(10**7, 10**9)) for m in range(100) for _ in range(100)] + [(r, 10**6 + m) for r in range(4000) for m in draw.sample(range(100), 5)]
    below = {}
    for owner, callee in edges:
        below.setdefault(owner, set()).add(callee)
    want = {r: len(mine.union(*(below.get(m, ()) for m in mine))) for r, mine in below.items() if r < 4000}
    calls = spark.createDataFrame(edges, "owner long, callee long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = _shuffled(spark)
    got = {r["root"]: r["helpers"] for r in H.helper_counts(calls, calls.filter("owner < 4000").select(F.col("owner").alias("root"))).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == want
    # 4000 roots by 5 sets of 100 would be 16 MB.
    assert _shuffled(spark) - before < 2 << 20
    # Several groups, slices of them, and chunks of roots; keys of any type; a null calls nothing and is no helper.
    monkeypatch.setattr(H, "GROUP_CALLS", 10)
    monkeypatch.setattr(H, "_SHOWN", 3)
    monkeypatch.setattr(H, "REACHED_AT_ONCE", 40)
    monkeypatch.setattr(H, "PAIRS_AT_ONCE", 20)
    few = [(f"m{draw.randrange(30)}", f"m{draw.randrange(25)}") for _ in range(70)] + [("m1", "m1"), ("n", None), (None, "m2")]
    calls = spark.createDataFrame(few, "owner string, callee string")
    for depth in (0, 1, 3):
        want = {r["root"]: r["helpers"] for r in H.distinct_helpers(H.expand(calls, calls.select(F.col("owner").alias("root")).distinct(), depth)).collect()}
        tables = []
        monkeypatch.setattr(H, "written", lambda d, free=False, tables=tables: (tables.append(d), lineage.written(d, free))[1])
        assert {r["root"]: r["helpers"] for r in H.helper_counts(calls, max_depth=depth).collect()} == want
        assert len(tables) > 3 or depth == 0  # two, and one for each slice


def test_pairs_of_class_and_ancestor_are_not_shuffled(spark):
    faces, kinds = 60, "class_name string, parent string, kind string, place int"
    edges = [(f"C{i}", f"B{i % 10}", "extends", 0) for i in range(3000)] + [(f"B{b}", f"I{b}x{f}", "implements", f) for b in range(10) for f in range(faces)]
    edges = spark.createDataFrame(edges, kinds)
    before = _shuffled(spark)
    order = R.resolution_order(edges)
    assert order.count() == 3000 * (2 + faces) + 10 * (1 + faces) + 10 * faces
    assert _shuffled(spark) - before < 1 << 20
    methods = spark.createDataFrame([(f"I{b}x{f}", f"m{f % 7}", f >= 7) for b in range(10) for f in range(faces)], "class_name string, method_signature string, has_code boolean")
    calls = spark.createDataFrame([(i, f"C{i}", None, "", f"m{i % 8}") for i in range(3000)], "call_id int, owner string, receiver_type string, receiver_expr string, callee_signature string")
    before = _shuffled(spark)
    got = {r["call_id"]: r["target"] for r in R.callees_above(calls, edges, methods).collect()}
    assert got == {i: f"I{i % 10}x{7 + i % 8}" if i % 8 < 7 else None for i in range(3000)}
    assert _shuffled(spark) - before < 1 << 20
