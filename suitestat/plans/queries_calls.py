"""Queries on call sites: owner families, classification, builders and their events, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.operators import classification as C
from suitestat.operators import correlation as B
from suitestat.operators import families as K
from suitestat.plans.registry import query
from suitestat.plans.snippets import SNIPPETS


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


def _calls(spark, sf_dir):
    """Call sites of the piece of code that each order holds."""
    kind = "struct<call_id:bigint,start:bigint,stop:bigint,method_name:string,receiver_type:string,receiver_expr:string,args:array<string>,arg_types:array<string>,is_constructor:boolean>"
    rows = [(i, [(j, *c[:3], c[3], c[4], c[5], c[6], c[7]) for j, (c, _) in enumerate(calls)]) for i, (calls, _, _) in enumerate(SNIPPETS)]
    pieces = spark.createDataFrame(rows, f"piece bigint, calls array<{kind}>")
    d = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % len(SNIPPETS)).alias("piece"), (F.col("o_orderkey") % 97).cast("string").alias("_n"))
    d = d.join(F.broadcast(pieces), "piece").select("o_orderkey", "_n", F.explode("calls").alias("c")).select("o_orderkey", "_n", "c.*")  # a fixed table
    return d.withColumn("args", F.transform("args", lambda x: F.replace(x, F.lit("@"), F.col("_n")))).drop("_n").withColumns({"line": (F.col("start") / 100).cast("int"), "values": C.no_names(), "callee_signature": F.lit("")})


_O = f"o AS (SELECT o_orderkey, o_custkey % {len(SNIPPETS)} AS piece, CAST(o_orderkey % 97 AS VARCHAR) AS n FROM orders)"
_FOUND = _values((i, j, *f) for i, (calls, _, _) in enumerate(SNIPPETS) for j, (_, f) in enumerate(calls))
_ASKED = _values((i, *a) for i, (_, asked, _) in enumerate(SNIPPETS) for a in asked)
_GAVE = _values((i, *g) for i, (_, _, gave) in enumerate(SNIPPETS) for g in gave)


def _names():
    return F.concat_ws("|", *[F.array_join(c, ",") for c in ("header_names", "query_names", "path_names", "form_names")])


@query(f"""WITH {_O}, f(piece, call_id, framework, family, request_role, response_role, mocking, http_method, path, names, has_body) AS (VALUES {_FOUND})
SELECT o_orderkey, CAST(call_id AS BIGINT) AS call_id, framework, family, request_role, response_role, mocking, http_method, replace(path, '@', n) AS path, names, has_body FROM o JOIN f USING (piece)""")
def cls_call_sites(spark, sf_dir):
    d = C.once_a_body(_calls(spark, sf_dir), lambda calls: C.classify(calls, "o_orderkey"), "o_orderkey")
    return d.select("o_orderkey", "call_id", "framework", "family", "request_role", "response_role", F.col("mocking.kind").alias("mocking"), "http_method", "path", F.when(F.col("framework").isNotNull(), _names()).alias("names"), "has_body")


@query(f"""WITH {_O}, a(piece, call_id, http_method, path, names, has_body) AS (VALUES {_ASKED})
SELECT o_orderkey, CAST(call_id AS BIGINT) AS call_id, http_method, replace(path, '@', n) AS path, names, has_body FROM o JOIN a USING (piece)""")
def cls_requests(spark, sf_dir):
    def asked(calls):
        known = C.classify(calls, "o_orderkey")
        events, _ = B.correlate(known, "o_orderkey")
        return B.requests(known, events, "o_orderkey").filter("request_role = 'event'")

    rows = C.once_a_body(_calls(spark, sf_dir), asked, "o_orderkey")
    return rows.select("o_orderkey", "call_id", "http_method", "path", _names().alias("names"), "has_body")


@query(f"""WITH {_O}, g(piece, event_id, builder_id, properties) AS (VALUES {_GAVE})
SELECT o_orderkey, CAST(event_id AS BIGINT) AS event_id, CAST(builder_id AS BIGINT) AS builder_id, properties FROM o JOIN g USING (piece)""")
def cls_builder_sources(spark, sf_dir):
    sources = C.once_a_body(_calls(spark, sf_dir), lambda calls: B.correlate(C.classify(calls, "o_orderkey"), "o_orderkey")[1], "o_orderkey")
    return sources.select("o_orderkey", "event_id", "builder_id", F.array_join("properties", ",").alias("properties"))


# ---- the rule table alone: receivers and methods of the table, whole, with a nested type, and with a longer name

_RECEIVERS = sorted({k for _, k, _, _ in K.receiver_rows()})
_METHODS = sorted({m for _, m, *_ in K.method_rows() if m != "*"})
_PAIRS = f"""SELECT DISTINCT concat({_RECEIVERS!r}[CAST(1 + l_partkey % {len(_RECEIVERS)} AS INT)], CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '$Sub' ELSE 'x' END) AS receiver_type,
  {_METHODS!r}[CAST(1 + (l_partkey * 7 + l_suppkey) % {len(_METHODS)} AS INT)] AS method_name, l_linenumber = 3 AS is_constructor FROM lineitem"""
_RULES = f"""f(rule, framework, family) AS (VALUES {_values((i, f.framework, f.family) for i, f in enumerate(K.FAMILIES))}), r(rule, key, match, length) AS (VALUES {_values(K.receiver_rows())}),
m(rule, method, request_role, response_role, verb) AS (VALUES {_values(K.method_rows())})"""


def _pairs(spark, sf_dir):
    pick = lambda xs, at: F.get(F.array(*[F.lit(x) for x in xs]), (at % len(xs)).cast("int"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, "$Sub").otherwise("x")
    d = _t(spark, sf_dir, "lineitem")
    return d.select(F.concat(pick(_RECEIVERS, F.col("l_partkey")), kind).alias("receiver_type"), pick(_METHODS, F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("method_name"), (F.col("l_linenumber") == 3).alias("is_constructor")).distinct()


_MEETS = "(r.match = 'exact' AND p.receiver_type = r.key OR r.match = 'prefix' AND (p.receiver_type = r.key OR starts_with(p.receiver_type, concat(r.key, '.')) OR starts_with(p.receiver_type, concat(r.key, '$'))) OR r.match = 'inside' AND (starts_with(p.receiver_type, concat(r.key, '.')) OR starts_with(p.receiver_type, concat(r.key, '$'))))"


@query(f"""WITH p AS ({_PAIRS}), {_RULES},
c AS (SELECT p.*, f.framework, f.family, m.request_role, m.response_role, m.verb, row_number() OVER (PARTITION BY receiver_type, method_name, is_constructor ORDER BY r.length DESC, m.method = '*', r.rule) AS n FROM p JOIN r ON {_MEETS} JOIN m ON m.rule = r.rule AND m.method IN (p.method_name, '*') JOIN f ON f.rule = r.rule)
SELECT p.receiver_type, p.method_name, p.is_constructor, framework, family, request_role, response_role, verb FROM p LEFT JOIN c ON c.receiver_type = p.receiver_type AND c.method_name = p.method_name AND c.is_constructor = p.is_constructor AND c.n = 1""")
def cls_owner_families(spark, sf_dir):
    return K.resolve(_pairs(spark, sf_dir))


_HOLDS = _values((i, f.holds_path) for i, f in enumerate(K.FAMILIES))


@query(f"""WITH p AS (SELECT DISTINCT receiver_type FROM ({_PAIRS})), {_RULES}, h(rule, holds_path) AS (VALUES {_HOLDS}),
c AS (SELECT receiver_type, r.length, bool_or(holds_path) AS holds_path FROM p JOIN r ON {_MEETS} JOIN h ON h.rule = r.rule GROUP BY receiver_type, r.length)
SELECT receiver_type, max_by(holds_path, length) AS holds_path FROM c GROUP BY receiver_type""")
def cls_path_receivers(spark, sf_dir):
    return K.holds_path(_pairs(spark, sf_dir))


# ---- chains that wait: the lines of an order as chains of two frameworks

_ITEM = """SELECT l_orderkey, CASE l_linestatus WHEN 'O' THEN 'mockmvc' ELSE 'okhttp' END AS cls, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS chain, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey END AS event_id, l_suppkey % 2 = 0 AS open FROM lineitem"""


@query(f"""WITH i AS ({_ITEM}) SELECT a.l_orderkey, a.cls, a.chain, min(b.event_id) AS event_id FROM i a JOIN i b ON b.l_orderkey = a.l_orderkey AND b.cls = a.cls AND b.chain > a.chain AND b.event_id IS NOT NULL AND b.open
WHERE a.event_id IS NULL GROUP BY a.l_orderkey, a.cls, a.chain""")
def cls_waiting_chains(spark, sf_dir):
    pos = F.expr("CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey")
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "O", "mockmvc").otherwise("okhttp").alias("cls"), pos.alias("chain"), pos.alias("stop"), F.when(F.col("l_suppkey") % 3 == 0, pos).alias("event_id"), (F.col("l_suppkey") % 2 == 0).alias("open"))
    return B.drained(d.withColumns({"receiver": F.lit(""), "names": C.no_names(), "base": F.lit(False)}), "l_orderkey")


_DECL = "SELECT DISTINCT l_orderkey, concat('v', CAST(l_linenumber AS VARCHAR)) AS name, l_partkey % 50 AS start, l_partkey % 50 + l_suppkey % 30 AS stop, CASE WHEN l_suppkey % 5 > 0 THEN 'x' ELSE ' ' END AS initializer FROM lineitem WHERE l_linenumber % 2 = 0"
_CHAIN = "SELECT l_orderkey, l_partkey % 50 AS chain, max(l_partkey % 50 + l_suppkey % 6) AS stop, list(DISTINCT CASE WHEN l_suppkey % 4 = 0 THEN concat('r', CAST(l_linenumber AS VARCHAR)) ELSE 'a.b()' END) AS receivers FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey, l_partkey % 50"


@query(f"""WITH d AS ({_DECL}), c AS ({_CHAIN}), n AS (SELECT l_orderkey, chain, unnest(list_filter(receivers, lambda x: x LIKE 'r%')) AS name FROM c UNION
SELECT c.l_orderkey, chain, name FROM c JOIN d ON d.l_orderkey = c.l_orderkey AND d.start <= c.chain AND c.stop <= d.stop AND trim(initializer) <> '')
SELECT c.l_orderkey, c.chain, coalesce(string_agg(name, ',' ORDER BY name), '') AS names FROM c LEFT JOIN n ON n.l_orderkey = c.l_orderkey AND n.chain = c.chain GROUP BY c.l_orderkey, c.chain""")
def cls_target_names(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber").cast("string")
    place = F.col("l_partkey") % 50
    d = lines.filter("l_linenumber % 2 = 0").select("l_orderkey", F.concat(F.lit("v"), number).alias("name"), place.alias("start"), (place + F.col("l_suppkey") % 30).alias("stop"), F.when(F.col("l_suppkey") % 5 > 0, "x").otherwise(" ").alias("initializer"))
    receiver = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("r"), number)).otherwise("a.b()")
    c = lines.filter("l_linenumber % 2 = 1").groupBy("l_orderkey", place.alias("chain")).agg(F.max(place + F.col("l_suppkey") % 6).alias("stop"), F.collect_set(receiver).alias("receivers"))
    return B.target_names(c, d, "l_orderkey").select("l_orderkey", "chain", F.array_join("names", ",").alias("names"))


# ---- timelines: an order is a method, its lines are calls; a part's number may be that of an order, which is then a helper

_PLACE = "CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey"
_RUNS = f"""SELECT l_orderkey AS owner, {_PLACE} AS call_id, {_PLACE} AS start, {_PLACE} + l_quantity * 10000000 AS stop, CASE WHEN l_suppkey % 4 = 0 THEN l_partkey END AS callee,
  CASE l_returnflag WHEN 'R' THEN 'builder' WHEN 'A' THEN 'event' END AS request_role, 'okhttp' AS framework, CASE l_linenumber WHEN 1 THEN 'UNKNOWN' ELSE 'PUT' END AS http_method, CASE WHEN l_linenumber = 2 THEN '' ELSE concat('/', l_linestatus) END AS http_path,
  CASE l_linestatus WHEN 'O' THEN 'status' ELSE 'general' END AS assertion_role, l_linenumber % 3 > 0 AS counts, CAST(200 + l_linenumber AS INT) AS status_code FROM lineitem"""
_ENTRIES = "SELECT o_orderkey AS root, 'test' AS phase, 1 AS entry, o_orderkey AS method FROM orders UNION ALL SELECT o_orderkey, 'setup', 0, 1 + o_custkey % 7 FROM orders"
_RUN_SQL = f"""c AS ({_RUNS}), p AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY stop, start DESC, call_id) AS place FROM c), e AS ({_ENTRIES}),
d0 AS (SELECT e.root, e.phase, [CAST(e.entry AS BIGINT), p.place] AS path, 0 AS depth, [e.method] AS running, p.* FROM e JOIN p ON p.owner = e.method),
d1 AS (SELECT d0.root, d0.phase, list_append(d0.path, p.place) AS path, 1 AS depth, p.* FROM d0 JOIN p ON p.owner = d0.callee WHERE NOT list_contains(d0.running, d0.callee)),
t AS (SELECT * EXCLUDE (running) FROM d0 UNION ALL BY NAME SELECT * FROM d1)"""


def _timeline(spark, sf_dir):
    from suitestat.operators.timeline import timeline
    from suitestat.plans import views

    views.tables(spark, sf_dir, "lineitem", "orders")
    return timeline(spark.sql(_RUNS), spark.sql(_ENTRIES))


@query(f"WITH {_RUN_SQL} SELECT root, count(*) AS n, md5(string_agg(concat(phase, ':', depth, ':', owner, ':', call_id), ',' ORDER BY path)) AS digest FROM t GROUP BY root")
def sym_timeline(spark, sf_dir):
    said = F.concat_ws(":", "phase", "depth", "owner", "call_id")
    rows = F.sort_array(F.collect_list(F.struct("path", said.alias("said"))))  # array_sort() would interpret a comparison for each step
    return _timeline(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(rows["said"], ",")).alias("digest"))


@query(f"""WITH {_RUN_SQL}, k AS (SELECT *, CASE WHEN request_role = 'builder' THEN 'request-build' WHEN request_role = 'event' THEN 'http-request' WHEN counts AND assertion_role = 'status' THEN 'response-check' END AS kind FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS n, kind <> 'response-check' AS asks FROM k WHERE kind IS NOT NULL)
SELECT root, CAST(n AS INT) AS "order", kind, phase, owner, call_id, framework, CASE WHEN asks THEN nullif(http_method, 'UNKNOWN') END AS http_method, CASE WHEN asks THEN nullif(http_path, '') END AS http_path,
  CASE WHEN NOT asks THEN assertion_role END AS assertion_role, CASE WHEN NOT asks THEN status_code END AS status_code FROM s""")
def seq_call_steps(spark, sf_dir):
    from suitestat.operators.timeline import call_steps

    return call_steps(_timeline(spark, sf_dir))


# ---- hierarchies: a part is a class, with a superclass, two interfaces and sometimes a class around it

_HIERARCHY = """SELECT concat('c', CAST(p_partkey AS STRING)) AS class_name, concat('c', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING)) AS parent, 'extends' AS kind, 0 AS place FROM part WHERE p_partkey > 1
UNION ALL SELECT concat('c', CAST(p_partkey AS STRING)), concat('i', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)), 'implements', 1 FROM part
UNION ALL SELECT concat('c', CAST(p_partkey AS STRING)), concat('i', CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING)), 'implements', 0 FROM part
UNION ALL SELECT concat('i', CAST(p_partkey AS STRING)), concat('i', CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING)), 'extends', 1 FROM part WHERE p_partkey >= 4
UNION ALL SELECT concat('i', CAST(p_partkey AS STRING)), concat('i', CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING)), 'extends', 0 FROM part WHERE p_partkey % 3 = 0 AND p_partkey >= 10
UNION ALL SELECT concat('c', CAST(p_partkey AS STRING)), concat('c', CAST(p_partkey - 1 AS STRING)), 'encloses', 0 FROM part WHERE p_partkey % 6 IN (4, 5)"""
_ORDER_SQL = f"""e AS (SELECT DISTINCT class_name, parent, kind, CAST(place AS BIGINT) AS place FROM ({_HIERARCHY.replace("STRING", "VARCHAR")})), k AS (SELECT class_name AS child FROM e UNION SELECT parent FROM e),
sup AS (SELECT child, child AS ancestor, CAST([] AS BIGINT[]) AS path FROM k UNION ALL SELECT sup.child, e.parent, list_append(sup.path, e.place) FROM sup JOIN e ON e.kind = 'extends' AND e.class_name = sup.ancestor),
enc AS (SELECT child, child AS outer_, 0 AS ring FROM k UNION ALL SELECT enc.child, e.parent, enc.ring + 1 FROM enc JOIN e ON e.kind = 'encloses' AND e.class_name = enc.outer_),
h0 AS (SELECT child, ancestor, CASE WHEN len(path) = 0 THEN [CAST(0 AS BIGINT)] ELSE list_concat([CAST(1 AS BIGINT), 0, len(path)], path) END AS key FROM sup
  UNION ALL SELECT enc.child, sup.ancestor, list_concat([CAST(2 AS BIGINT), ring, len(path)], path) FROM enc JOIN sup ON sup.child = enc.outer_ WHERE ring > 0),
h AS (SELECT child, ancestor, min(key) AS key FROM h0 GROUP BY child, ancestor),
f AS (SELECT h.child, e.parent AS ancestor, list_append(h.key, e.place) AS path, CAST(0 AS BIGINT) AS depth FROM h JOIN e ON e.kind = 'implements' AND e.class_name = h.ancestor
  UNION ALL SELECT f.child, e.parent, list_append(f.path, e.place), f.depth + 1 FROM f JOIN e ON e.kind = 'extends' AND e.class_name = f.ancestor),
b AS (SELECT child, ancestor, min(key) AS key FROM (SELECT * FROM h UNION ALL SELECT child, ancestor, list_concat([CAST(3 AS BIGINT), depth], path) FROM f) GROUP BY child, ancestor),
o AS (SELECT child, ancestor, row_number() OVER (PARTITION BY child ORDER BY key, ancestor) - 1 AS position, CASE WHEN key[1] = 0 THEN 'class' WHEN key[1] < 3 THEN 'super' ELSE 'interface' END AS relation FROM b)"""


def _hierarchy(spark, sf_dir):
    from suitestat.plans import views

    views.tables(spark, sf_dir, "part")
    return spark.sql(_HIERARCHY)


@query(f"WITH RECURSIVE {_ORDER_SQL} SELECT child, ancestor, position, relation FROM o")
def sym_resolution_order(spark, sf_dir):
    from suitestat.operators.resolution import resolution_order

    return resolution_order(_hierarchy(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ORDER_SQL}, c AS (SELECT DISTINCT l_partkey, l_suppkey, concat('c', CAST(l_partkey AS VARCHAR)) AS child, concat('m', CAST(l_suppkey % 9 AS VARCHAR)) AS sig, l_suppkey % 4 = 0 AS up FROM lineitem),
m AS (SELECT concat(CASE p_size % 2 WHEN 0 THEN 'c' ELSE 'i' END, CAST(p_partkey AS VARCHAR)) AS ancestor, concat('m', CAST(p_size % 9 AS VARCHAR)) AS sig FROM part WHERE p_partkey % 5 > 0)
SELECT c.l_partkey, c.l_suppkey, min_by(o.ancestor, o.position) FILTER (m.sig IS NOT NULL AND (NOT up OR position > 0)) AS target FROM c JOIN o ON o.child = c.child LEFT JOIN m ON m.ancestor = o.ancestor AND m.sig = c.sig GROUP BY c.l_partkey, c.l_suppkey""")
def sym_callees(spark, sf_dir):
    from suitestat.operators.resolution import callees_above

    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    lines = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    up = F.col("l_suppkey") % 4 == 0
    own = name("c", F.col("l_partkey"))
    calls = lines.select("l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey").alias("call_id"), own.alias("owner"), F.when(~up & (F.col("l_suppkey") % 3 > 0), own).alias("receiver_type"), F.when(up, "super").otherwise("").alias("receiver_expr"), name("m", F.col("l_suppkey") % 9).alias("callee_signature"))
    p = _t(spark, sf_dir, "part")
    methods = p.select(F.when(F.col("p_size") % 2 == 0, name("c", F.col("p_partkey"))).otherwise(name("i", F.col("p_partkey"))).alias("class_name"), name("m", F.col("p_size") % 9).alias("method_signature"), (F.col("p_partkey") % 5 > 0).alias("has_code"))
    return callees_above(calls, _hierarchy(spark, sf_dir), methods).select("l_partkey", "l_suppkey", "target")


_IMPORTS = """SELECT concat('c', CAST(l_orderkey AS STRING)) AS class_name, CASE l_linenumber % 3 WHEN 0 THEN concat('p', CAST(l_partkey % 40 AS STRING)) WHEN 1 THEN concat('q.X.', CASE WHEN l_suppkey % 5 = 0 THEN 'RUN' ELSE 'run' END, CAST(l_suppkey % 4 AS STRING)) ELSE 'lib.Util' END AS path, l_linenumber % 7 <> 6 AS is_static, l_linenumber % 3 <> 1 AS is_wildcard FROM lineitem"""


@query(f"""WITH i AS (SELECT DISTINCT class_name, path, is_wildcard FROM ({_IMPORTS.replace("STRING", "VARCHAR")}) WHERE is_static), m AS (SELECT concat('p', CAST(p_partkey % 40 AS VARCHAR)) AS owner, concat('run', CAST(p_size % 6 AS VARCHAR)) AS method, 1 AS tier FROM part WHERE p_partkey % 2 = 0 UNION SELECT 'lib.Util', 'run1', 2),
a AS (SELECT class_name, substr(path, 5) AS method, 'q.X' AS owner, 0 AS tier FROM i WHERE NOT is_wildcard AND path NOT LIKE '%RUN%' UNION SELECT class_name, method, owner, tier FROM i JOIN m ON m.owner = i.path WHERE is_wildcard),
u AS (SELECT class_name, method, tier, min(owner) AS owner FROM a GROUP BY class_name, method, tier HAVING count(DISTINCT owner) = 1)
SELECT class_name, method, min_by(owner, tier) AS receiver_type FROM u GROUP BY class_name, method""")
def sym_static_index(spark, sf_dir):
    from suitestat.operators.resolution import static_index
    from suitestat.plans import views

    views.tables(spark, sf_dir, "lineitem")
    p = _t(spark, sf_dir, "part")
    methods = p.select(F.concat(F.lit("p"), (F.col("p_partkey") % 40).cast("string")).alias("class_name"), F.concat(F.lit("Run"), (F.col("p_size") % 6).cast("string"), F.lit("(int)")).alias("method_signature"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("public"), F.lit("static"))).otherwise(F.array(F.lit("public"))).alias("modifiers"))
    known = spark.createDataFrame([("lib.Util", "run1", "utility")], "owner string, method string, tier string")
    return static_index(spark.sql(_IMPORTS), methods, known)


# ---- reads of a medium that assertions use: the lines of an order as reads, assertions and other assignments, by place

_USE = "SELECT l_orderkey AS test_id, CASE l_linestatus WHEN 'O' THEN '' ELSE 'helper' END AS scope, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS start, concat('v', CAST(l_suppkey % 2 AS STRING)) AS name, l_partkey % 3 AS kind, l_quantity FROM lineitem"


@query(f"""WITH l AS ({_USE.replace("STRING", "VARCHAR")}), r AS (SELECT *, start + 100000 AS stop FROM l WHERE kind = 0), a AS (SELECT *, start + CAST(l_quantity AS BIGINT) * 500000000 AS stop FROM l WHERE kind = 1),
n AS (SELECT DISTINCT r.test_id, r.start FROM r JOIN a ON a.test_id = r.test_id AND a.scope = r.scope AND a.start <= r.start AND a.stop >= r.stop),
s AS (SELECT test_id, scope, name, stop AS pos, start AS call_id FROM r UNION ALL SELECT test_id, scope, name, start, NULL FROM l WHERE kind = 2),
b AS (SELECT DISTINCT a.test_id, arg_max(s.call_id, s.pos) AS call_id FROM (SELECT a.*, a.start AS use FROM a) a JOIN s ON s.test_id = a.test_id AND s.scope = a.scope AND s.name = a.name AND s.pos < a.start
  AND s.pos = (SELECT max(x.pos) FROM s x WHERE x.test_id = a.test_id AND x.scope = a.scope AND x.name = a.name AND x.pos < a.start) GROUP BY a.test_id, a.scope, a.name, a.use)
SELECT r.test_id, r.start AS call_id, 'db' AS medium, CASE WHEN n.start IS NOT NULL THEN 'nested' ELSE 'binding' END AS tier FROM r LEFT JOIN n ON n.test_id = r.test_id AND n.start = r.start WHERE n.start IS NOT NULL OR (r.test_id, r.start) IN (SELECT test_id, call_id FROM b WHERE call_id IS NOT NULL)""")
def seq_state_observations(spark, sf_dir):
    from suitestat.operators.labels import state_observations
    from suitestat.plans import views

    views.tables(spark, sf_dir, "lineitem")
    d = spark.sql(_USE)
    reads = d.filter("kind = 0").select("test_id", "scope", F.col("start").alias("call_id"), F.lit("db").alias("medium"), "start", (F.col("start") + 100000).alias("stop"), F.col("name").alias("target"))
    uses = d.filter("kind = 1").select("test_id", "scope", "start", (F.col("start") + F.col("l_quantity").cast("long") * 500000000).alias("stop"), F.array("name").alias("names"))
    return state_observations(reads, uses, d.filter("kind = 2").select("test_id", "scope", "name", F.col("start").alias("pos")))
