"""Queries on small facts of classes, methods and calls, from lines, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.operators import assertions as N
from suitestat.operators import extract as E
from suitestat.operators import figures as G
from suitestat.operators import graph as H
from suitestat.operators import labels as L
from suitestat.plans import views
from suitestat.plans.registry import query

_PLACE = "CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


# ---- assertions


@query(f"SELECT l_orderkey, {_PLACE} AS pos, last_value(CASE l_linenumber % 3 WHEN 0 THEN 'status' WHEN 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'body' END END IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {_PLACE}) AS role FROM lineitem")
def cls_inherited_roles(spark, sf_dir):
    role = F.when(F.col("l_linenumber") % 3 == 0, "status").when((F.col("l_linenumber") % 3 == 1) & (F.col("l_suppkey") % 2 == 0), "body")
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("chain"), F.expr(_PLACE).alias("pos"), role.alias("role"))
    return L.inherited_roles(d, "l_orderkey").select("l_orderkey", "pos", "role")


_ARG = "SELECT DISTINCT l_orderkey AS call_id, CASE l_suppkey % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'body' END AS role FROM lineitem"


@query(f"WITH a AS ({_ARG}), r AS (SELECT call_id, CASE WHEN count(role) = 1 THEN max(role) END AS r FROM a GROUP BY call_id) SELECT o_orderkey AS call_id, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'header' END, r, 'general') AS role FROM orders LEFT JOIN r ON r.call_id = o_orderkey")
def cls_argument_roles(spark, sf_dir):
    views.tables(spark, sf_dir, "lineitem")
    calls = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderstatus") == "P", "header").alias("role"))
    return N.role_of_arguments(calls, spark.sql(_ARG))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'status' WHEN 'O' THEN 'body' END, 'general') AS role FROM lineitem LEFT JOIN orders ON o_orderkey = l_partkey")
def cls_promoted_matchers(spark, sf_dir):
    wraps = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderstatus") == "F", "status").when(F.col("o_orderstatus") == "O", "body").alias("role"))
    m = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_partkey").alias("parent_id"), F.lit("general").alias("role"))
    return N.promoted(m, wraps).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "role")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'T' ELSE p_type END AS receiver_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0")
def cls_helper_returns(spark, sf_dir):
    calls = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, "T").otherwise("").alias("receiver_type"), F.col("l_partkey").alias("helper"))
    methods = _t(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("method"), F.col("p_type").alias("return_type"))
    return N.helper_return_types(calls, methods).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "receiver_type")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_suppkey % 2 = 0 OR l_linenumber > 3 OR l_partkey % 5 = 0 AS evidence, l_partkey % 3 = 0 AS veto,
  CASE l_linenumber % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'body' WHEN 2 THEN 'header' END AS role FROM lineitem""")
def cls_status_guards(spark, sf_dir):
    c = F.col
    role = F.get(F.array(*[F.lit(x) for x in ("status-assertion", "body-assertion", "header-assertion", "matcher")]), (c("l_linenumber") % 4).cast("int"))
    types = F.array(F.lit("int"), F.when(c("l_partkey") % 3 == 0, "com.acme.Status").otherwise("com.acmeX.Status"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", N.is_status_evidence(c("l_suppkey") % 2 == 0, c("l_linenumber") > 3, F.when(c("l_partkey") % 5 == 0, True)).alias("evidence"), N.domain_status(types, ["com.acme."]).alias("veto"), N.response_role(role).alias("role"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method, concat('/base/p', CAST(p_size AS VARCHAR)) AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 3 = 0 AND l_suppkey % 2 = 0")
def cls_declarative_requests(spark, sf_dir):
    calls = _t(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("call_id"), _text("I", "l_partkey").alias("receiver_type"), F.when(F.col("l_suppkey") % 2 == 0, "m()").otherwise("n()").alias("callee_signature"))
    p = _t(spark, sf_dir, "part")
    mapped = p.select(_text("I", "p_partkey").alias("class_name"), F.lit("m()").alias("method_signature"), F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("http_method"), _text("p", "p_size").alias("path"))
    clients = p.filter("p_partkey % 3 = 0").select(_text("I", "p_partkey").alias("class_name"), F.lit("/base/").alias("base"))
    return L.declarative_requests(calls, mapped, clients).select("call_id.*", "http_method", "path")


# ---- classes


@query("SELECT p_partkey, CASE WHEN l.k IS NOT NULL THEN 'test' WHEN p_size % 3 = 0 THEN 'utility' ELSE 'application' END AS category FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) l ON l.k = p_partkey")
def sym_categories(spark, sf_dir):
    tests = _t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("class_name"))
    d = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("class_name"), "p_size")
    return H.categorize(d, tests, F.col("p_size") % 3 == 0).select(F.col("class_name").alias("p_partkey"), "category")


#: A line's class stands below its order's and its part's.
_UP = "SELECT DISTINCT concat('l', CAST(l_orderkey AS STRING)) AS child, concat('p', CAST(l_partkey AS STRING)) AS ancestor, CAST(1 + l_partkey % 2 AS INT) AS depth FROM lineitem UNION SELECT concat('l', CAST(o_orderkey AS STRING)), concat('l', CAST(o_orderkey AS STRING)), 0 FROM orders"
_UP_SQL = _UP.replace("STRING", "VARCHAR")


def _up(spark, sf_dir):
    """_UP, made distinct by its numbers before they become texts; its two parts share no row, as depth tells them apart."""
    k = F.col("l_partkey")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    own = _t(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return lines.select(_text("l", "l_orderkey").alias("child"), _text("p", "l_partkey").alias("ancestor"), (1 + k % 2).cast("int").alias("depth")).unionByName(own.select(_text("l", "o_orderkey").alias("child"), _text("l", "o_orderkey").alias("ancestor"), F.lit(0).alias("depth")))


_ANNOTATED = "SELECT concat('p', CAST(p_partkey AS STRING)) AS class_name, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS short_name, p_brand AS body, p_size % 4 > 0 AS inheritable FROM part UNION ALL SELECT concat('l', CAST(o_orderkey AS STRING)), 'A', o_orderstatus, false FROM orders WHERE o_orderkey % 3 = 0"


@query(f"""WITH u AS ({_UP_SQL}), a AS ({_ANNOTATED.replace("STRING", "VARCHAR")}), j AS (SELECT u.child, short_name, u.ancestor, body, depth, row_number() OVER (PARTITION BY u.child, short_name ORDER BY depth, u.ancestor) AS n FROM u JOIN a ON a.class_name = u.ancestor WHERE depth = 0 OR inheritable)
SELECT child, short_name, ancestor, body, depth FROM j WHERE n = 1""")
def sym_effective_annotations(spark, sf_dir):
    views.tables(spark, sf_dir, "orders", "part")
    return H.effective_annotations(_up(spark, sf_dir), spark.sql(_ANNOTATED))


_METHODS = "SELECT concat('p', CAST(p_partkey AS STRING)) AS class_name, concat('m', CAST(p_size % 6 AS STRING), '()') AS method_signature, CASE p_size % 3 WHEN 0 THEN 'BeforeEach' WHEN 1 THEN 'AfterEach' ELSE 'Test' END AS annotation FROM part"


@query(f"""WITH u AS ({_UP_SQL}), m AS ({_METHODS.replace("STRING", "VARCHAR")}), j AS (SELECT u.child, u.ancestor, depth, method_signature, annotation, min(depth) OVER (PARTITION BY u.child, method_signature) AS d FROM u JOIN m ON m.class_name = u.ancestor),
f AS (SELECT *, CASE annotation WHEN 'BeforeEach' THEN 'setup' ELSE 'teardown' END AS phase FROM j WHERE depth = d AND annotation <> 'Test')
SELECT child, ancestor, method_signature, phase, CAST(row_number() OVER (PARTITION BY child, phase ORDER BY CASE phase WHEN 'setup' THEN -depth ELSE depth END, ancestor, method_signature) AS INT) AS place FROM f""")
def sym_fixtures(spark, sf_dir):
    views.tables(spark, sf_dir, "part")
    rules = spark.createDataFrame([("BeforeEach", "setup"), ("AfterEach", "teardown")], "annotation string, phase string")
    return H.fixtures(_up(spark, sf_dir), spark.sql(_METHODS), rules).select("child", "ancestor", "method_signature", "phase", "place")


@query("""WITH f AS (SELECT DISTINCT l_orderkey, l_suppkey, l_suppkey % 5 = 0 AS always, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE [concat('g', CAST(l_suppkey % 3 AS VARCHAR))] END AS groups FROM lineitem)
SELECT o_orderkey, l_suppkey, groups IS NULL AND NOT always AS ambiguous FROM orders JOIN f ON l_orderkey = o_orderkey WHERE always OR groups IS NULL OR len(groups) = 0 OR list_contains(groups, concat('g', CAST(o_orderkey % 3 AS VARCHAR)))""")
def sym_applicable_fixtures(spark, sf_dir):
    k = F.col("l_suppkey")
    groups = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), (k % 3).cast("string"))))
    fixtures = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("class_name"), "l_suppkey", (k % 5 == 0).alias("always_run"), groups.alias("groups")).distinct()
    tests = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("class_name"), F.col("o_orderkey").alias("test_id"), F.array(F.concat(F.lit("g"), (F.col("o_orderkey") % 3).cast("string"))).alias("groups"))
    return L.applicable_fixtures(fixtures, tests).select(F.col("test_id").alias("o_orderkey"), "l_suppkey", "ambiguous")


@query("SELECT o_orderkey AS owner, CASE WHEN o_orderstatus = 'F' THEN 'setup' ELSE 'teardown' END AS phase, count(*) FILTER (l_returnflag = 'R') AS requests, count(*) FILTER (l_returnflag = 'A') AS verifications FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def sym_fixture_rows(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "request").when(F.col("l_returnflag") == "A", "verification")
    i = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), kind.alias("kind"))
    f = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", "setup").otherwise("teardown").alias("phase"))
    return L.fixture_rows(i, f)


@query("SELECT o_orderkey AS test_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS is_api_test FROM orders")
def sym_api_tests(spark, sf_dir):
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test_id"), F.when(F.col("l_returnflag") == "R", "event").otherwise("builder").alias("role"))
    return L.api_tests(r, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id")))


@query("SELECT l_orderkey AS callee, 'a' AS name, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 'b', CASE WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN 'F' END FROM lineitem GROUP BY l_orderkey")
def sym_parameter_values(spark, sf_dir):
    calls = _t(spark, sf_dir, "lineitem").select(F.expr(_PLACE).alias("call_id"), F.col("l_orderkey").alias("callee"), F.array("l_returnflag", F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))).alias("values"))
    names = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("callee"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("pos", "name"))
    return H.parameter_values(calls, names)


@query("SELECT p_brand AS class_name, count(*) AS methods, sum(p_size) AS complexity, (SELECT count(*) FROM lineitem JOIN part q ON q.p_partkey = l_partkey WHERE q.p_brand = p.p_brand AND l_returnflag = 'R') AS objects_created FROM part p GROUP BY p_brand")
def sym_method_totals(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    calls = _t(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("class_name"), (F.col("l_returnflag") == "R").alias("is_constructor"))
    return H.method_totals(p.select(F.col("p_brand").alias("class_name"), F.col("p_name").alias("method_signature"), F.col("p_size").alias("complexity")), calls)


_IMPORTED = "SELECT DISTINCT concat('p', CAST(l_partkey AS STRING)) AS class_name, concat('x.', l_returnflag) AS path, l_linestatus = 'O' AS is_static, false AS is_wildcard FROM lineitem"


@query(f"WITH u AS ({_UP_SQL}), i AS ({_IMPORTED.replace('STRING', 'VARCHAR')}) SELECT class_name, path, is_static, is_wildcard FROM i UNION SELECT child, path, is_static, is_wildcard FROM u JOIN i ON i.class_name = u.ancestor")
def sym_imports(spark, sf_dir):
    views.tables(spark, sf_dir, "lineitem")
    return H.imports_of(spark.sql(_IMPORTED), _up(spark, sf_dir))


# ---- endpoints


@query("""SELECT p_partkey, name, source FROM part, unnest(CASE p_partkey % 3 WHEN 0 THEN [concat('p', CAST(p_size AS VARCHAR)), 'q'] WHEN 1 THEN ['q'] ELSE [] END) AS u(name), (SELECT 'query' AS source) UNION ALL SELECT p_partkey, 'X-H', 'header' FROM part WHERE p_partkey % 3 = 2""")
def ext_constraints(spark, sf_dir):
    k = F.col("p_partkey") % 3
    two = F.concat(F.lit('@GetMapping(value = "/a", params = {"p'), F.col("p_size").cast("string"), F.lit('=1", "!not", "q"})'))
    m = _t(spark, sf_dir, "part").select("p_partkey", F.lit("C").alias("class_name"), F.col("p_partkey").cast("string").alias("method_signature"), F.when(k == 0, two).when(k == 1, '@GetMapping(params = "q>3")').otherwise('@PostMapping(headers = {"X-H=v"})').alias("annotation"))
    return E.constraint_parameters(m).select(F.col("method_signature").cast("long").alias("p_partkey"), "name", "source")


@query("SELECT DISTINCT concat('/v', CAST(p_size AS VARCHAR)) AS prefix FROM part WHERE p_partkey % 2 = 0")
def ext_prefixes(spark, sf_dir):
    a = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('@ApplicationPath("v'), F.col("p_size").cast("string"), F.lit('/")'))).otherwise('@ApplicationPath("/")')
    return E.application_prefixes(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("class_name"), a.alias("annotation")))


@query("SELECT p_partkey AS class_name, CASE p_partkey % 5 WHEN 0 THEN 'feign' WHEN 1 THEN 'http-interface' WHEN 2 THEN 'micronaut-client' ELSE 'rest-client' END AS kind, CASE p_partkey % 5 WHEN 0 THEN concat('http://h', CAST(p_size AS VARCHAR)) WHEN 1 THEN '/x' WHEN 2 THEN '/m' ELSE '' END AS base FROM part WHERE p_partkey % 5 < 4")
def ext_clients(spark, sf_dir):
    k = F.col("p_partkey") % 5
    a = F.when(k == 0, F.concat(F.lit('@FeignClient(name = "n", url = "http://h'), F.col("p_size").cast("string"), F.lit('")'))).when(k == 1, '@HttpExchange("/x")').when(k == 2, '@Client("/m")').when(k == 3, "@RegisterRestClient").otherwise("@Service")
    return E.client_kind(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("class_name"), a.alias("annotation")))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 'query' WHEN 1 THEN CASE WHEN l_suppkey % 8 = 1 THEN 'body' END END AS source, l_suppkey % 4 = 2 AS context FROM lineitem)
SELECT l_orderkey, min(concat('a', CAST(l_linenumber AS VARCHAR))) FILTER (source IS NULL AND NOT context) AS name FROM p JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY l_orderkey HAVING count(*) FILTER (source IS NULL AND NOT context) = 1 AND count(*) FILTER (source = 'body') = 0""")
def ext_bodies(spark, sf_dir):
    k = F.col("l_suppkey")
    c = F.lit("C").alias("class_name")
    source = F.when(k % 4 == 0, "query").when(k % 8 == 1, "body")
    p = _t(spark, sf_dir, "lineitem").select(c, F.col("l_orderkey").alias("method_signature"), _text("a", "l_linenumber").alias("java_name"), source.alias("source"), (k % 4 == 2).alias("is_context"))
    m = _t(spark, sf_dir, "orders").select(c, F.col("o_orderkey").alias("method_signature"), F.when(F.col("o_orderstatus") == "F", "GET").otherwise("PUT").alias("http_method"))
    return E.body_parameters(p, m).select(F.col("method_signature").alias("l_orderkey"), "name")


_WITHIN = "SELECT DISTINCT l_partkey AS type, concat('f', CAST(l_linenumber AS STRING)) AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'header' END AS source, CASE WHEN l_linenumber = 3 THEN l_suppkey + 1000000 END AS bean FROM lineitem UNION SELECT s_suppkey + 1000000, concat('s', CAST(s_nationkey AS STRING)), NULL, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1000001 END FROM supplier"


@query(f"""WITH RECURSIVE f AS ({_WITHIN.replace("STRING", "VARCHAR")}), b AS (SELECT p_partkey, p_partkey AS type FROM part UNION SELECT b.p_partkey, f.bean FROM b JOIN f ON f.type = b.type WHERE f.bean IS NOT NULL)
SELECT DISTINCT p_partkey, coalesce(name, CAST(b.type AS VARCHAR)) AS name, coalesce(source, 'query') AS source, name IS NULL AS is_unscorable FROM b LEFT JOIN f ON f.type = b.type WHERE f.bean IS NULL""")
def ext_beans(spark, sf_dir):
    views.tables(spark, sf_dir, "lineitem", "supplier")
    kind = lambda d: d.withColumns({c: F.col(c).cast("string") for c in ("type", "bean") if c in d.columns})
    beans = kind(_t(spark, sf_dir, "part").select(F.lit("C").alias("class_name"), F.col("p_partkey").alias("method_signature"), F.col("p_partkey").alias("type")))
    return E.bean_parameters(beans, kind(spark.sql(_WITHIN))).select(F.col("method_signature").alias("p_partkey"), "name", "source", "is_unscorable")


@query(f"""WITH u AS ({_UP_SQL}), a AS (SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS class_name, p_size % 3 AS pos, CASE WHEN p_size % 2 = 0 THEN 'PathVariable' ELSE 'RequestParam' END AS short_name, p_name AS annotation FROM part)
SELECT child AS class_name, pos, short_name, arg_min(annotation, (depth, ancestor)) AS annotation FROM u JOIN a ON a.class_name = u.ancestor GROUP BY child, pos, short_name""")
def ext_inherited_annotations(spark, sf_dir):
    a = _t(spark, sf_dir, "part").select(_text("p", "p_partkey").alias("class_name"), F.lit("m()").alias("method_signature"), (F.col("p_size") % 3).alias("pos"), F.when(F.col("p_size") % 2 == 0, "PathVariable").otherwise("RequestParam").alias("short_name"), F.col("p_name").alias("annotation"))
    return E.inherited_parameter_annotations(_up(spark, sf_dir), a).select("class_name", "pos", "short_name", "annotation")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'Accept' ELSE 'ETag' END AS header FROM lineitem WHERE l_partkey % 3 < 2 AND l_orderkey % 2 = 0")
def ext_header_constants(spark, sf_dir):
    k = F.col("l_partkey") % 3
    lines = _t(spark, sf_dir, "lineitem")
    names = lines.select(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("class_name"), F.when(k == 0, "HttpHeaders.ACCEPT").when(k == 1, "HttpHeaders.ETAG").otherwise("Other.ACCEPT").alias("identifier"))
    imports = lines.filter("l_orderkey % 2 = 0").select(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("class_name"), F.lit("org.x.HttpHeaders").alias("path"))
    return E.header_constants(names, imports).select("class_name.*", "header")


@query("""WITH RECURSIVE l AS (SELECT p_partkey AS a, CAST(floor(p_partkey / 3) AS BIGINT) AS b, concat('n', CAST(p_partkey % 10 AS VARCHAR)) AS p FROM part WHERE p_partkey >= 3),
m AS (SELECT p_partkey AS k, concat('/r', CAST(p_partkey % 7 AS VARCHAR)) AS mount FROM part WHERE p_size % 5 = 0 UNION SELECT l.b, concat(m.mount, '/', l.p) FROM m JOIN l ON l.a = m.k) SELECT k AS class_name, mount FROM m""")
def ext_deep_mounts(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    n = lambda c, m: (F.col(c) % m).cast("string")
    roots = p.filter("p_size % 5 = 0").select(F.col("p_partkey").alias("class_name"), F.concat(F.lit("/r"), n("p_partkey", 7)).alias("mount"))
    locators = p.filter("p_partkey >= 3").select(F.col("p_partkey").alias("class_name"), F.concat(F.lit("n"), n("p_partkey", 10), F.lit("/")).alias("path"), F.floor(F.col("p_partkey") / 3).cast("long").alias("target"))
    return E.mounts(locators, roots)


# ---- figures


@query("SELECT o_custkey AS suite, min(o_totalprice) AS min, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey")
def fig_box(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("suite")).agg(F.count(F.lit(1)).alias("count"), F.min("o_totalprice").alias("min"), F.max("o_totalprice").alias("max"), F.avg("o_totalprice").alias("mean"))
    none = o.select((-F.col("suite")).alias("suite"), F.lit(0).cast("long").alias("count"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"), F.lit(None).cast("double").alias("mean"))
    return G.box(o.unionByName(none)).select("suite", "min", "mean")


@query("WITH l AS (SELECT concat('requests:', l_returnflag) AS a, concat('resources:', l_linestatus) AS b, concat('endpoints:', CAST(l_linenumber AS VARCHAR)) AS c FROM lineitem) SELECT a AS source, b AS target, count(*) AS n FROM l GROUP BY a, b UNION ALL SELECT b, c, count(*) FROM l GROUP BY b, c")
def fig_scope_links(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("requests"), F.col("l_linestatus").alias("resources"), F.col("l_linenumber").cast("string").alias("endpoints")).agg(F.count(F.lit(1)).alias("n"))
    return G.scope_links(s)


# ---- authentication: each order is a test with one of the cases; ~ stands for its number

_SEC = "org.springframework.security.test.web.servlet.request.SecurityMockMvcRequestPostProcessors"
#: (annotation, role, path, header, receiver, method, label, signals).
_AUTH = (
    ("@WithMockUser(roles = \"A\")", "event", "/oauth/~", None, None, "perform", "real-flow", "real-flow=route:/oauth/~|mocked=annotation:@WithMockUser(roles = \"A\")"),
    ("@WithTenantPrincipal", "event", "/authors/~", None, None, None, "unknown", "unknown=weak:annotation:@WithTenantPrincipal"),
    ("@WithEnvironmentVariable", None, None, None, None, None, "none", ""),
    ("@a.b.PermitAll", "builder", "/login", '"Bearer ~"', "okhttp3.Request", "header", "test-token", "test-token=header:authorization|bypassed=annotation:@a.b.PermitAll"),
    ("@Test", None, None, None, _SEC, "httpBasic", "test-token", f"test-token=call-site:receiver:{_SEC}.httpBasic"),
    ("@Test", None, None, None, _SEC, "anonymous", "bypassed", f"bypassed=call-site:receiver:{_SEC}.anonymous"),
    ("@Test", None, None, None, "x.Y", "oidcLogin", "mocked", "mocked=method:oidcLogin"),
    ("@Test", None, None, None, "org.keycloak.Admin", "authorize", "real-flow", "real-flow=call-site:receiver:org.keycloak.Admin.authorize"),
    ("@Test", None, None, None, "org.keycloak.Admin", "realms", "unknown", "unknown=weak:auth-receiver:org.keycloak.Admin.realms"),
    ("@Test", None, None, None, "org.keycloakish.Admin", "login", "none", ""),
    ("@Test", "event", "/token-~", '"X-API-Key"', "io.restassured.specification.RequestSpecification", "oauth2", "real-flow", "real-flow=route:/token-~|test-token=call-site:receiver:io.restassured.specification.RequestSpecification.oauth2|test-token=header:authorization"),
)


def _lit(value):
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query(f"WITH v(piece, label, signals) AS (VALUES {', '.join(f'({i}, {_lit(c[6])}, {_lit(c[7])})' for i, c in enumerate(_AUTH))}) SELECT o_orderkey AS test_id, label, replace(signals, '~', CAST(o_orderkey % 97 AS VARCHAR)) AS signals FROM orders JOIN v ON piece = o_orderkey % {len(_AUTH)}")
def seq_auth_handling(spark, sf_dir):
    from suitestat.operators.auth import auth_handling

    cases = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(_AUTH)], "piece long, annotation string, request_role string, path string, header string, receiver_type string, method_name string")
    d = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("test_id"), (F.col("o_orderkey") % len(_AUTH)).alias("piece"), (F.col("o_orderkey") % 97).cast("string").alias("n")).join(F.broadcast(cases), "piece")  # a fixed list
    own = lambda c: F.replace(c, F.lit("~"), F.col("n"))
    events = d.withColumn("path", own("path")).withColumn("headers", F.when(F.col("header").isNotNull(), F.array(own("header")))).withColumn("auth_hints", F.lit(None).cast("array<string>"))
    found = auth_handling(d.select("test_id"), events, d.select("test_id", "annotation"))
    return found.select("test_id", "label", F.array_join(F.transform("signals", lambda s: F.concat_ws("=", s["label"], s["signal"])), "|").alias("signals"))
