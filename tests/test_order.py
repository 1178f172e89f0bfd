"""Orders: timelines, hierarchies, static imports, bindings and ranks, against plain walks."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from suitestat.functions import lineage
from suitestat.operators import aggregates as A
from suitestat.operators import labels as L
from suitestat.operators import resolution as R
from suitestat.operators import timeline as T


# ---- timelines


def nested(rng, lo, hi, depth=0):
    """Spans that nest: (start, stop, children)."""
    out, at = [], lo
    while at + 2 < hi and rng.random() < 0.8:
        a = at + rng.randrange(2)
        b = min(hi - 1, a + 1 + rng.randrange(8))
        if b <= a:
            break
        out.append((a, b, nested(rng, a, b, depth + 1) if depth < 2 else []))
        at = b + 1
    return out


def post(tree):
    for a, b, inner in tree:
        yield from post(inner)
        yield a, b


def test_timelines_as_a_recursive_walk(spark):
    rng = random.Random(6)
    trees = {m: nested(rng, 0, 40) for m in range(12)}
    ids = {(m, s): i for i, (m, s) in enumerate((m, s) for m, t in trees.items() for s in dict.fromkeys(post(t)))}
    calls_helper = {k: rng.randrange(14) for k in ids if rng.random() < 0.4}
    rows = [(m, i, a, b, calls_helper.get((m, (a, b)))) for (m, (a, b)), i in ids.items()]
    calls = spark.createDataFrame(rows, "owner int, call_id int, start int, stop int, callee int")
    entries = [(r, e, p, rng.randrange(12)) for r in range(8) for e, p in enumerate(["setup", "test", "teardown"])]

    def walk(method, depth, running, most):
        for a, b in dict.fromkeys(post(trees[method])):
            yield depth, ids[method, (a, b)]
            helper = calls_helper.get((method, (a, b)))
            if helper is not None and depth < most and helper not in running and helper in trees:
                yield from walk(helper, depth + 1, running | {helper}, most)

    for most in (0, 1, 3):
        got = {}
        for r in T.timeline(calls, spark.createDataFrame(entries, "root int, entry int, phase string, method int"), most).collect():
            got.setdefault(r["root"], []).append((r["path"], r["phase"], r["depth"], r["call_id"]))
        for root in range(8):
            want = [(p, d, c) for r, _, p, m in entries if r == root for d, c in walk(m, 0, {m}, most)]
            assert [x[1:] for x in sorted(got.get(root, []))] == want
    with pytest.raises(ValueError):
        T.timeline(calls, calls, -1)


def test_timelines_sort_without_interpreted_comparisons(spark):
    from conftest import SMALL
    from suitestat.plans.queries_calls import sym_timeline

    assert "lambda" not in sym_timeline(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_a_timeline(spark):
    kind = "root int, phase string, owner string, call_id int, path array<bigint>, request_role string, framework string, http_method string, http_path string, assertion_role string, counts boolean, status_code int"
    rows = [(1, "test", "m", 3, [1, 3], None, None, None, None, "status", True, 200), (1, "test", "m", 1, [1, 1], "builder", "okhttp", "UNKNOWN", "", None, None, None), (1, "test", "m", 2, [1, 1, 5], "event", "okhttp", "GET", "/a", "status", True, 404), (1, "test", "m", 4, [1, 4], None, None, None, None, "general", True, None), (1, "test", "m", 5, [1, 5], None, None, None, None, "body", False, None), (1, "test", "m", 6, [1, 6], None, None, None, None, None, None, None)]
    got = [tuple(r) for r in T.call_steps(spark.createDataFrame(rows, kind)).orderBy("order").collect()]
    assert got == [(1, 1, "request-build", "test", "m", 1, "okhttp", None, None, None, None), (1, 2, "http-request", "test", "m", 2, "okhttp", "GET", "/a", None, None), (1, 3, "response-check", "test", "m", 3, None, None, None, "status", 200)]


# ---- hierarchies


def visit(edges, child):
    """The order by queues: superclasses, enclosing classes with theirs, then interfaces."""
    of = lambda c, kind: [p for _, p in sorted((place, p) for n, p, k, place in edges if n == c and k == kind)]
    order, supers = [child], []

    def climb(start):
        queue = deque(p for p in of(start, "extends") if p not in order)
        while queue:
            c = queue.popleft()
            if c not in order:
                order.append(c)
            supers.append(c)
            queue.extend(p for p in of(c, "extends") if p not in order)

    climb(child)
    around, at = [], child
    while of(at, "encloses") and of(at, "encloses")[0] not in [child, *around]:
        at = of(at, "encloses")[0]
        around.append(at)
    for c in around:
        if c not in order:
            order.append(c)
            supers.append(c)
            climb(c)
    relation = {c: "super" for c in order} | {child: "class"}
    seen, queue = set(), deque()
    for c in [child, *supers]:
        for p in of(c, "implements"):
            if p not in seen:
                seen.add(p)
                queue.append(p)
    while queue:
        i = queue.popleft()
        if i not in order:
            order.append(i)
            relation[i] = "interface"
        for p in of(i, "extends"):
            if p not in seen:
                seen.add(p)
                queue.append(p)
    return [(c, relation[c]) for c in order]


def test_resolution_order_as_queues_visit(spark):
    rng = random.Random(4)
    edges = []
    for g in range(25):
        n = rng.randrange(2, 8)
        name = lambda i: f"g{g}c{i}"  # noqa: E731, B023
        for i in range(n):
            for place in range(rng.choice([0, 1, 1, 2])):
                edges.append((name(i), name(rng.randrange(i)) if i else name(n - 1) if rng.random() < 0.2 else None, "extends", place))
            for place in range(rng.choice([0, 1, 2])):
                edges.append((name(i), f"g{g}i{rng.randrange(4)}", "implements", place))
            if i and rng.random() < 0.3:
                edges.append((name(i), name(rng.randrange(i)), "encloses", 0))
        for i in range(4):
            for place in range(rng.choice([0, 1, 2])):
                edges.append((f"g{g}i{i}", f"g{g}i{rng.randrange(4)}", "extends", place))
    whole = [e for e in dict.fromkeys(edges) if e[1]]
    got = {}
    for r in R.resolution_order(spark.createDataFrame(edges, "class_name string, parent string, kind string, place int")).collect():
        got.setdefault(r["child"], []).append((r["position"], r["ancestor"], r["relation"]))
    for c in {e[0] for e in whole}:
        assert [x[1:] for x in sorted(got[c])] == visit(whole, c), c
    assert R.resolution_order(spark.createDataFrame([], "class_name string, parent string, kind string, place int")).count() == 0


def test_resolution_order_in_several_groups(spark, monkeypatch):
    from suitestat.operators import ancestry

    monkeypatch.setattr(ancestry, "GROUP_ROWS", 20)
    test_resolution_order_as_queues_visit(spark)
    # Names of another type; a kind that isn't known; a cycle of all kinds.
    edges = spark.createDataFrame([(1, 2, "extends", None), (2, 3, "implements", 1), (3, 1, "extends", 0), (1, 1, "encloses", 0), (4, 5, "other", 0), (None, 1, "extends", 0)], "class_name int, parent long, kind string, place int")
    got = sorted(tuple(r) for r in R.resolution_order(edges).collect())
    assert got == [(1, 1, 0, "class"), (1, 2, 1, "super"), (1, 3, 2, "interface"), (2, 1, 2, "interface"), (2, 2, 0, "class"), (2, 3, 1, "interface"), (3, 1, 1, "super"), (3, 2, 2, "super"), (3, 3, 0, "class"), (4, 4, 0, "class"), (5, 5, 0, "class")]
    monkeypatch.setattr(ancestry, "GROUP_ROWS", 1)
    with pytest.raises(RuntimeError):
        R.resolution_order(spark.createDataFrame([(i, i + 1, "extends", 0) for i in range(20)], "class_name int, parent int, kind string, place int"), rounds=2)


def test_callees_without_the_rows_of_the_order(spark, monkeypatch):
    from suitestat.operators import ancestry

    rng = random.Random(8)
    name = lambda: f"c{rng.randrange(25)}"
    edges = spark.createDataFrame([(name(), name(), rng.choice(["extends", "implements", "encloses"]), rng.randrange(3)) for _ in range(30)], "class_name string, parent string, kind string, place int")
    methods = spark.createDataFrame([(name(), f"m{rng.randrange(4)}", rng.random() < 0.8) for _ in range(25)] + [("alone", "m1", True)], "class_name string, method_signature string, has_code boolean")
    calls = [(i, rng.choice([name(), name(), None]), rng.choice([None, " ", f" {name()}", "alone", "nowhere"]), rng.choice([None, "super", "x"]), rng.choice([f"m{rng.randrange(5)}", None])) for i in range(300)]
    calls = spark.createDataFrame(calls, "call_id int, owner string, receiver_type string, receiver_expr string, callee_signature string")
    order = R.resolution_order(edges)
    valid = spark.createDataFrame([(f"c{i}",) for i in range(0, 25, 2)] + [("alone",)], "class_name string")
    for size in (10, 1 << 14):
        monkeypatch.setattr(ancestry, "GROUP_ROWS", size)
        for ok in (None, valid):
            want = sorted(map(str, R.callees(calls, order, methods, ok).collect()))
            got = R.callees_above(calls, edges, methods, ok)
            assert sorted(map(str, got.collect())) == want
            assert len(want) == 300 and any("target='c" in x for x in want) and any("target=None" in x for x in want)


def test_callees_along_the_order(spark):
    order = R.resolution_order(spark.createDataFrame([("C", "B", "extends", 0), ("B", "A", "extends", 0), ("C", "I", "implements", 0)], "class_name string, parent string, kind string, place int"))
    methods = spark.createDataFrame([("A", "m()", True), ("B", "m()", False), ("C", "own()", True), ("A", "own()", True), ("I", "d()", True), ("Z", "z()", True)], "class_name string, method_signature string, has_code boolean")
    calls = spark.createDataFrame([(1, "C", None, "", "m()"), (2, "C", None, "", "own()"), (3, "C", "", "super", "own()"), (4, "X", "C", "c", "d()"), (5, "C", "Z", "z", "z()"), (6, "C", None, "", "no()"), (7, "Z", None, None, "z()"), (8, None, None, None, None)], "call_id int, owner string, receiver_type string, receiver_expr string, callee_signature string")
    got = {r["call_id"]: r["target"] for r in R.callees(calls, order, methods).collect()}
    assert got == {1: "A", 2: "C", 3: "A", 4: "I", 5: "Z", 6: None, 7: "Z", 8: None}
    valid = spark.createDataFrame([("C",), ("A",)], "class_name string")
    got = {r["call_id"]: r["target"] for r in R.callees(calls, order, methods, valid).collect()}
    assert got == {1: "A", 2: "C", 3: "A", 4: None, 5: None, 6: None, 7: None, 8: None}
    classes = spark.createDataFrame([("C", ["@Feign"], ["a.B"])], "class_name string, annotations array<string>, imports array<string>")
    details = spark.createDataFrame([("C", "m()", ["@Get"], ["int x"])], "class_name string, method_signature string, annotations array<string>, parameters array<string>")
    asked = spark.createDataFrame([(1, "C", "m()"), (2, "C", "n()"), (3, "D", "m()")], "call_id int, receiver_type string, callee_signature string")
    got = {r["call_id"]: (r["declaring"], r["class_annotations"], r["method_annotations"]) for r in R.callee_details(asked, classes, details).collect()}
    assert got == {1: ("C", ["@Feign"], ["@Get"]), 2: ("C", ["@Feign"], []), 3: (None, None, None)}


def test_static_names_that_two_owners_give_are_dropped(spark):
    imports = [("T", "p.A", True, True), ("T", "p.B", True, True), ("T", "p.A.one", True, False), ("T", "lib.U", True, True), ("T", "p.A.CONST", True, False), ("T", "p.B.off", False, False), ("U", "p.A", True, True), ("U", "p.A", True, True), ("U", None, True, True)]
    methods = [("p.A", "one(int)", ["static"]), ("p.A", "both()", ["public", "static"]), ("p.B", "both()", ["static"]), ("p.B", "one()", ["static"]), ("p.A", "instance()", []), ("p.A", "nul()", None), ("p.B", "Late()", ["static"])]
    known = spark.createDataFrame([("lib.U", "both", "utility"), ("lib.U", "late", "utility")], "owner string, method string, tier string")
    got = R.static_index(spark.createDataFrame(imports, "class_name string, path string, is_static boolean, is_wildcard boolean"), spark.createDataFrame(methods, "class_name string, method_signature string, modifiers array<string>"), known)
    assert {(r["class_name"], r["method"]): r["receiver_type"] for r in got.collect()} == {("T", "one"): "p.A", ("T", "both"): "lib.U", ("T", "late"): "p.B", ("U", "one"): "p.A", ("U", "both"): "p.A"}


# ---- bindings


def test_a_use_takes_the_last_assignment_before_it(spark):
    f = spark.createDataFrame
    reads = f([(1, "", 1, "db", 10, 12, "x"), (1, "", 2, "db", 20, 22, "x"), (1, "h", 3, "mq", 25, 26, "x"), (1, "", 4, "fs", 31, 33, None), (1, "", 5, "db", 60, 61, "y"), (2, "", 6, "db", 10, 12, "x")], "test_id int, scope string, call_id int, medium string, start int, stop int, target string")
    uses = f([(1, "", 15, 16, ["x", "x"]), (1, "", 30, 40, ["q"]), (1, "", 70, 71, ["y"]), (2, "", 50, 51, ["x"]), (1, "h", 24, 24, ["x"])], "test_id int, scope string, start int, stop int, names array<string>")
    other = f([(1, "", "y", 65), (2, "", "x", 5)], "test_id int, scope string, name string, pos int")
    got = {r["call_id"]: r["tier"] for r in L.state_observations(reads, uses, other).collect()}
    # 1 is used before x gets 2; 2 and 3 are never used in their scope; y is overwritten.
    assert got == {1: "binding", 4: "nested", 6: "binding"}
    assert {r["call_id"] for r in L.state_observations(reads, uses).collect()} == {1, 4, 5, 6}
    assert L.state_observations(reads, uses.limit(0)).count() == 0


# ---- ranks and the shared folder


def test_ranks_over_all_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3]), f"n{rng.randrange(50)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v int, _rank_x string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = A.global_rank(df, F.desc("v"), F.col("id")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in want] and {r["rank"] for r in got} == set(range(1, 3001))
    assert A.global_rank(df.limit(0), F.col("id")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda _: None)

    class Spark:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Spark)
