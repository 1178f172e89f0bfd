"""Queries on test methods, frameworks of classes and owners of fixtures: an order as a class, its line items as methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.operators import detection as T
from suitestat.operators import rules as R
from suitestat.operators import verbs as V
from suitestat.plans import views
from suitestat.plans.registry import query

_IMPORT = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'org.testng.annotations.Test' WHEN '2' THEN 'org.testng.annotations' WHEN '3' THEN 'junit.framework.TestCase' WHEN '4' THEN 'com.other.Test' ELSE 'org.junit' END"
_METHOD = "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'test' ELSE 'check' END, CAST(l_linenumber AS VARCHAR(9)))"


@query(f"""WITH i AS (SELECT o_orderkey AS class_name, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s FROM orders),
m AS (SELECT l_orderkey AS class_name, {_METHOD} AS method_signature, l_returnflag <> 'R' AS is_public, l_linestatus = 'O' AS is_void, l_quantity > 25 AS has_parameter, CASE l_linenumber WHEN 3 THEN 'Test' WHEN 5 THEN 'BeforeMethod' END AS annotation FROM lineitem)
SELECT class_name, method_signature, (annotation IS NOT DISTINCT FROM 'Test' AND p IN ('1', '2', '5'))
  OR (p = '3' AND s = 'O' AND method_signature LIKE 'test%' AND is_public AND is_void AND NOT has_parameter)
  OR (p IN ('1', '2') AND s = 'F' AND is_public AND NOT (annotation IS NOT DISTINCT FROM 'BeforeMethod' AND p = '2')) AS is_test
FROM m JOIN i USING (class_name)""")
def sym_test_methods(spark, sf_dir):
    views.tables(spark, sf_dir, "orders", "lineitem")
    imports = spark.sql(f"SELECT o_orderkey AS class_name, {_IMPORT} AS path, substr(o_orderpriority, 1, 1) IN ('2', '5') AS is_wildcard FROM orders")
    methods = spark.sql(f"SELECT l_orderkey AS class_name, {_METHOD} AS method_signature, array(CASE WHEN l_returnflag <> 'R' THEN 'public' ELSE 'private' END) AS modifiers, CASE WHEN l_linestatus = 'O' THEN 'void' ELSE 'int' END AS return_type, CAST(l_quantity > 25 AS INT) AS parameter_count, CASE l_linenumber WHEN 3 THEN 'Test' WHEN 5 THEN 'BeforeMethod' END AS short_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
    on_class = spark.sql("SELECT o_orderkey AS class_name, 'Test' AS short_name FROM orders WHERE o_orderstatus = 'F'")
    parents = spark.sql("SELECT o_orderkey AS class_name, 'junit.framework.TestCase' AS parent FROM orders WHERE o_orderstatus = 'O'")
    known = T.allowed(spark, T.TEST_ANNOTATIONS, T.FIXTURE_ANNOTATIONS)
    said = methods.filter("short_name is not null").select("class_name", "method_signature", "short_name")
    sure = said.join(R.import_evidence(said.select("class_name", "short_name").distinct(), imports, known), ["class_name", "short_name"], "left_semi")
    out = T.test_methods(methods.drop("short_name"), sure, R.import_evidence(on_class, imports, known), T.frameworks(imports, T.TESTING_PACKAGES), parents)
    return out.select("class_name", "method_signature", "is_test")


_CLIENT = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'org.springframework.test.web.servlet.MockMvc' WHEN '2' THEN 'org.springframework.test.web.reactive.server' WHEN '3' THEN 'org.springframework.boot.test.web.client.TestRestTemplate' WHEN '4' THEN 'org.springframework.boot.test.autoconfigure.web.servlet.WebMvcTest' ELSE 'org.springframework.test.web.servlets.Other' END"


@query("""SELECT o_orderkey AS class_name, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'mockmvc' WHEN '2' THEN 'webtestclient' WHEN '3' THEN 'test-rest-template' ELSE 'mockmvc' END AS framework
FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3') OR (substr(o_orderpriority, 1, 1) = '4' AND o_orderstatus = 'F')""")
def sym_sub_frameworks(spark, sf_dir):
    views.tables(spark, sf_dir, "orders")
    imports = spark.sql(f"SELECT o_orderkey AS class_name, {_CLIENT} AS path, substr(o_orderpriority, 1, 1) = '2' AS is_wildcard FROM orders")
    said = spark.sql("SELECT o_orderkey AS class_name, CASE WHEN o_orderstatus = 'F' THEN 'WebMvcTest' ELSE 'WebFluxTest' END AS short_name FROM orders")
    return T.sub_frameworks(imports, R.import_evidence(said, imports, T.allowed(spark, T.SPRING_ANNOTATIONS)))


@query("""SELECT o_orderkey AS class_name, CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'junit3' WHEN '5' THEN 'junit4' ELSE 'testng' END AS framework
FROM orders WHERE substr(o_orderpriority, 1, 1) <> '4'""")
def sym_testing_frameworks(spark, sf_dir):
    views.tables(spark, sf_dir, "orders")
    return T.frameworks(spark.sql(f"SELECT o_orderkey AS class_name, {_IMPORT} AS path FROM orders"), T.TESTING_PACKAGES)


_EDGES = """SELECT p_partkey AS class_name, CAST(floor(p_partkey / 4) AS BIGINT) AS parent, 'extends' AS kind FROM part WHERE p_partkey >= 4
UNION ALL SELECT p_partkey, -CAST(floor(p_partkey / 3) AS BIGINT), 'implements' FROM part WHERE p_partkey >= 3
UNION ALL SELECT -p_partkey, -CAST(floor(p_partkey / 5) AS BIGINT), 'extends' FROM part WHERE p_partkey >= 5"""


@query(f"""WITH RECURSIVE e AS ({_EDGES}),
up AS (SELECT child, child AS ancestor, 0 AS depth, true AS extended FROM (SELECT class_name AS child FROM e UNION SELECT parent FROM e) n
  UNION SELECT child, parent, depth + 1, extended AND kind = 'extends' FROM up JOIN e ON e.class_name = up.ancestor)
SELECT child, ancestor, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'class' WHEN bool_or(extended) THEN 'super' ELSE 'interface' END AS relation FROM up GROUP BY child, ancestor""")
def sym_fixture_owners(spark, sf_dir):
    views.tables(spark, sf_dir, "part")
    return T.fixture_owners(spark.sql(_EDGES))


@query("""WITH b AS (SELECT l_orderkey, bool_or(l_linenumber % 2 = 1 AND l_returnflag = 'N') AS url, bool_or((l_linenumber % 2 = 1 AND l_returnflag = 'R' AND l_quantity > 40) OR (l_linenumber % 2 = 0 AND l_quantity > 45)) AS other FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AND coalesce(url, false) AND NOT coalesce(other, false) THEN 'GET'
  WHEN o_orderstatus = 'O' AND substr(o_orderpriority, 1, 1) IN ('1', '2') AND o_totalprice > 100000 THEN 'GET' WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'UNKNOWN' ELSE 'PUT' END AS http_method
FROM orders LEFT JOIN b ON l_orderkey = o_orderkey""")
def cls_verb_defaults(spark, sf_dir):
    views.tables(spark, sf_dir, "orders", "lineitem")
    events = spark.sql("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'okhttp' WHEN 'O' THEN 'micronaut-client' ELSE 'feign' END AS framework, 'event' AS request_role, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'UNKNOWN' ELSE 'PUT' END AS http_method, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'exchange' WHEN '2' THEN 'retrieve' ELSE 'send' END AS method_name, array(CASE WHEN o_totalprice > 100000 THEN 'java.lang.String' ELSE 'io.micronaut.http.HttpRequest' END) AS argument_types FROM orders")
    builders = spark.sql("SELECT l_orderkey AS o_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_quantity > 45 THEN 'newBuilder' ELSE 'header' END WHEN l_returnflag = 'N' THEN 'url' WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'method' ELSE 'build' END AS method_name, CASE WHEN l_linenumber % 2 = 0 THEN 'okhttp3.Request' ELSE 'okhttp3.Request.Builder' END AS receiver_type FROM lineitem")
    return V.verb_defaults(events, builders, "o_orderkey").select("o_orderkey", "http_method")
