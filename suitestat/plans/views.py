"""Views of test-suite facts over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Test steps from events: a test is a user's six-day block, a project a tenth of the users.
STEPS = """
SELECT user_id % 10 AS project_id, test_id, event_id,
  row_number() OVER (PARTITION BY test_id ORDER BY ts, event_id) AS pos,
  CASE WHEN event_type = 'signup' THEN 'request-build'
       WHEN event_type IN ('view', 'purchase') THEN 'http-request'
       ELSE 'response-check' END AS kind,
  CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'HEAD' ELSE 'GET' END
       WHEN event_type = 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'PUT' WHEN 1 THEN 'PATCH'
            WHEN 2 THEN 'DELETE' WHEN 3 THEN 'OPTIONS' ELSE 'POST' END END AS http_method,
  CASE WHEN event_type IN ('view', 'purchase') THEN
       concat('/', CASE k % 4 WHEN 0 THEN 'items' WHEN 1 THEN 'orders' WHEN 2 THEN 'users' ELSE 'carts' END,
              CASE WHEN k % 3 = 0 THEN '' ELSE concat('/', CAST(k AS VARCHAR(9))) END) END AS http_path,
  CASE WHEN event_type = 'error' THEN 'status'
       WHEN event_type = 'click' THEN CASE k % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'body' ELSE 'header' END END AS assertion_role,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 7 = 0 THEN NULL ELSE 400 + (k % 2) * 100 + k % 5 END
       WHEN event_type = 'click' AND k % 3 = 0 THEN 200 + k % 5 END AS status_code,
  CASE event_id % 4 WHEN 0 THEN 'test-method' WHEN 1 THEN 'test-helper' WHEN 2 THEN 'fixture' ELSE 'fixture-helper' END AS origin_kind,
  CASE WHEN event_id % 4 < 2 THEN 'test' WHEN event_id % 8 < 4 THEN 'setup' ELSE 'teardown' END AS phase,
  CASE k % 5 WHEN 0 THEN 'mockmvc' WHEN 1 THEN 'rest-assured' WHEN 2 THEN 'webtestclient' WHEN 3 THEN 'okhttp' ELSE 'jax-rs' END AS framework,
  k
FROM (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
        user_id * 10 + CAST(floor((day(ts) - 1) / 6) AS BIGINT) AS test_id FROM events) AS raw_events
"""

#: Endpoints of production code: templates over the resources of the steps, some never called.
ENDPOINTS = """
SELECT p_partkey AS endpoint_id, p_partkey % 10 AS project_id,
  CASE WHEN p_size % 13 = 0 THEN 'UNKNOWN' ELSE CASE p_partkey % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' WHEN 4 THEN 'PATCH' ELSE 'HEAD' END END AS http_method,
  p_size % 13 = 0 AND p_partkey % 2 = 0 AS is_method_wildcard,
  CASE WHEN p_size % 17 = 0 THEN '/**' ELSE
    concat(CASE WHEN p_size % 11 = 0 THEN '/api' ELSE '' END,
      CASE p_size % 5 WHEN 0 THEN '/items' WHEN 1 THEN '/orders' WHEN 2 THEN '/users' WHEN 3 THEN '/carts' ELSE '/reports' END,
      CASE WHEN p_size % 2 = 0 THEN '/{id}' ELSE '' END) END AS path_template,
  p_brand AS class_name, p_name AS method_signature
FROM part
"""

#: Declared parameters of endpoints, from the line items of each part.
PARAMS = """
SELECT DISTINCT l_partkey AS endpoint_id, concat('p', CAST(l_linenumber AS VARCHAR(9))) AS name,
  CASE l_linenumber % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'query' WHEN 2 THEN 'path' ELSE 'body' END AS source,
  l_linenumber % 4 = 2 OR l_linenumber = 1 AS required
FROM lineitem
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of driver tables, for the SQL texts."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(STEPS)


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(ENDPOINTS)


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return spark.sql(PARAMS)
