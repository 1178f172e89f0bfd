"""Queries on URLs, endpoint coverage, parameters and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.functions import urls as U
from suitestat.operators import coverage as C
from suitestat.operators import parameters as P
from suitestat.operators import sequences as S
from suitestat.operators import stats_corpus as T
from suitestat.plans import views
from suitestat.plans.registry import query
from suitestat.plans.sqltext import ENDP, PAR, RES, SEG, summary
from suitestat.plans.views import ENDPOINTS, PARAMS, STEPS

_URL = r"""p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)[?]?([^#]*)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)[?]?([^#]*)', 2) AS authority,
  regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)[?]?([^#]*)', 3) AS path, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)[?]?([^#]*)', 4) AS query FROM pages)"""


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


@query(f"WITH {_URL} SELECT page_id, scheme, authority, path, query, regexp_extract(lower(authority), '^([^:]*)', 1) AS host, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: regexp_extract(x, '^([^=]*)', 1)))), ',') AS names FROM p")
def url_parts(spark, sf_dir):
    part = {x: U.url_part("url", x) for x in ("scheme", "authority", "path", "query")}
    return _pages(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in part.items()], U.hostname("url").alias("host"), F.array_join(F.array_sort(U.query_names("url")), ",").alias("names"))


@query(f"""WITH {_URL}, n AS (SELECT page_id, rtrim(regexp_replace(concat('/', CASE WHEN path = '' THEN '/' ELSE path END), '/+', '/', 'g'), '/') AS x FROM p), m AS (SELECT page_id, CASE WHEN x = '' THEN '/' ELSE x END AS normal FROM n)
SELECT page_id, normal, 'external' AS target, len(list_filter(string_split(normal, '/'), lambda s: s <> '')) AS depth, rtrim(concat('/pages', normal), '/') AS joined, CAST(NULL AS VARCHAR) AS request_path FROM m""")
def url_paths(spark, sf_dir):
    n = U.normalize_path("url")
    return _pages(spark, sf_dir).select("page_id", n.alias("normal"), U.request_target("url").alias("target"), U.route_depth(n).alias("depth"), U.join_paths(F.lit("/pages/"), "url").alias("joined"), U.normalize_request_path("url").alias("request_path"))


@query(f"""WITH {_URL}, s AS (SELECT page_id, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|[0-9a-fA-F]{{24}}|[0-9a-fA-F]{{32}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$') THEN '{{id}}' WHEN s LIKE '%*%' OR s LIKE '%\\%%' ESCAPE '\\' THEN NULL ELSE s END) AS x FROM p),
k AS (SELECT page_id, CASE WHEN len(list_filter(x, lambda s: s IS NULL)) = 0 THEN concat('/', array_to_string(x, '/')) END AS request_path FROM s)
SELECT page_id, request_path, regexp_replace(request_path, '/[{{]id[}}]$', '') AS resource_key FROM k""")
def url_resource_keys(spark, sf_dir):
    path = U.normalize_request_path(F.regexp_replace("url", r"^[a-z]+://[^/?#]*", ""))
    return _pages(spark, sf_dir).select("page_id", path.alias("request_path")).withColumn("resource_key", U.resource_key("request_path"))


# ---- endpoint coverage: templates are tested against the paths of the steps

_MATCH = f"""
steps AS ({STEPS}), endpoints AS ({ENDPOINTS}),
el AS (SELECT * FROM endpoints WHERE http_method <> 'UNKNOWN' OR is_method_wildcard),
rq AS (SELECT DISTINCT project_id, http_method, http_path FROM steps WHERE kind = 'http-request' AND http_path IS NOT NULL),
pat AS (SELECT *, CASE WHEN path_template = '/**' THEN '^(/[^/]+)*$' ELSE concat('^', replace(path_template, '/{{id}}', '/[^/]+'), '$') END AS pattern, concat('^', replace(replace(path_template, '/api', ''), '/{{id}}', '/[^/]+'), '$') AS suffix FROM el),
d AS (SELECT r.project_id, r.http_method, r.http_path, e.endpoint_id, concat(e.http_method, e.path_template) AS route, CASE WHEN regexp_matches(r.http_path, e.pattern) THEN 1 ELSE 3 END AS tier
  FROM rq r JOIN pat e ON e.project_id = r.project_id AND (e.http_method = r.http_method OR (e.http_method = 'UNKNOWN' AND e.is_method_wildcard))
  WHERE regexp_matches(r.http_path, e.pattern) OR (e.path_template LIKE '/api/%' AND r.http_path LIKE '/%/%' AND regexp_matches(r.http_path, e.suffix))),
b AS (SELECT *, min(tier) OVER w AS best, min(route) OVER (PARTITION BY project_id, http_method, http_path, tier) = max(route) OVER (PARTITION BY project_id, http_method, http_path, tier) AS one FROM d WINDOW w AS (PARTITION BY project_id, http_method, http_path)),
m AS (SELECT project_id, http_method, http_path, endpoint_id, tier FROM b WHERE tier = best AND (tier < 3 OR one))""".replace("{{", "{").replace("}}", "}")


def _match(spark, sf_dir):
    steps = views.steps(spark, sf_dir).filter("kind = 'http-request'")
    e = views.endpoints(spark, sf_dir)
    return steps, e, C.match_groups(steps, e)


@query(f"WITH {_MATCH} SELECT * FROM m")
def cov_matches(spark, sf_dir):
    steps = views.steps(spark, sf_dir).filter("kind = 'http-request'")
    return C.match(steps, views.endpoints(spark, sf_dir)).drop("path_truncated")


@query(f"""WITH {_MATCH}, t AS (SELECT m.project_id, endpoint_id, count(DISTINCT test_id) AS covering_tests, count(*) AS requests FROM m JOIN steps s ON s.kind = 'http-request' AND s.project_id = m.project_id AND s.http_method = m.http_method AND s.http_path = m.http_path GROUP BY ALL)
SELECT el.project_id, el.endpoint_id, el.http_method, el.path_template, coalesce(covering_tests, 0) AS covering_tests, coalesce(requests, 0) AS requests, coalesce(covering_tests, 0) > 0 AS is_covered FROM el LEFT JOIN t USING (project_id, endpoint_id)""")
def cov_endpoint_coverage(spark, sf_dir):
    steps, e, m = _match(spark, sf_dir)
    return C.endpoint_coverage(e, steps, m).select("project_id", "endpoint_id", "http_method", "path_template", "covering_tests", "requests", "is_covered")


@query(f"WITH {_MATCH}, c AS (SELECT DISTINCT project_id, endpoint_id FROM m) SELECT el.project_id, count(*) AS endpoints, count(c.endpoint_id) AS covered, round(CAST(count(c.endpoint_id) AS DOUBLE) / count(*), 4) AS coverage_ratio FROM el LEFT JOIN c USING (project_id, endpoint_id) GROUP BY el.project_id")
def cov_project_ratio(spark, sf_dir):
    steps, e, m = _match(spark, sf_dir)
    return C.coverage_summary(C.endpoint_coverage(e, steps, m), "project_id")


@query(f"""WITH {_MATCH}, {SEG.replace(f"steps AS ({STEPS}),", "")},
f AS (SELECT * FROM (SELECT project_id, test_id, seq, http_method, http_path, row_number() OVER (PARTITION BY test_id, seq ORDER BY pos) AS rn FROM seg WHERE kind = 'http-request') WHERE rn = 1),
k AS (SELECT project_id, test_id, seq, CASE WHEN status_code IS NULL THEN 'unknown' ELSE concat(CAST(status_code // 100 AS VARCHAR), 'xx') END AS range, count(*) AS n FROM seg WHERE kind = 'response-check' AND assertion_role = 'status' GROUP BY ALL)
SELECT f.project_id, m.endpoint_id, k.range, CAST(sum(k.n) AS BIGINT) AS checks FROM f JOIN m ON m.project_id = f.project_id AND m.http_method = f.http_method AND m.http_path = f.http_path JOIN k ON k.test_id = f.test_id AND k.seq = f.seq GROUP BY ALL""")
def cov_outcomes(spark, sf_dir):
    _, e, m = _match(spark, sf_dir)
    return C.outcomes(S.segment(views.steps(spark, sf_dir)), e, m)


@query(f"""WITH endpoints AS ({ENDPOINTS}), {PAR}, s AS (SELECT endpoint_id, {", ".join(f"count(*) FILTER (source = '{x}') AS {x}_params" for x in ("path", "query", "header", "form", "body"))}, count(*) FILTER (required) AS required_params, count(*) FILTER (NOT required) AS optional_params, count(*) AS total_params FROM params GROUP BY endpoint_id)
SELECT e.endpoint_id, len(list_filter(string_split(path_template, '/'), lambda x: x <> '')) AS depth, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("path_params", "query_params", "header_params", "form_params", "body_params", "required_params", "optional_params", "total_params"))} FROM endpoints e LEFT JOIN s USING (endpoint_id)""")
def cov_surface(spark, sf_dir):
    return C.surface(views.endpoints(spark, sf_dir), views.params(spark, sf_dir))


@query("SELECT p_brand, p_type, max_by(p_name, p_partkey) AS p_name, max(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_type")
def cov_deduplicate(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_type", "p_name", "p_partkey")
    return C.deduplicate(parts, "p_partkey", "p_brand", "p_type")


@query(f"""WITH endpoints AS ({ENDPOINTS}), b AS (SELECT DISTINCT class_name, method_signature FROM endpoints)
SELECT b.class_name, b.method_signature, count(DISTINCT l_orderkey) AS tests FROM lineitem JOIN part ON p_partkey = l_partkey JOIN b ON b.class_name = p_brand AND b.method_signature = p_name GROUP BY ALL""")
def cov_handler_calls(spark, sf_dir):
    e = views.endpoints(spark, sf_dir)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    calls = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("test_id"), F.col("p_brand").alias("receiver_type"), F.col("p_name").alias("callee_signature"))
    own = parts.select(F.col("p_brand").alias("class_name"), F.col("p_brand").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    return C.handler_calls(calls, e, own)


# ---- parameters: a test is an order, a request a line

_USE = f"""{PAR}, rq AS (SELECT l_partkey AS endpoint_id, l_orderkey AS test_id, l_orderkey * 10 + l_linenumber AS request_id,
  list_distinct(['p' || CAST(1 + l_suppkey % 7 AS VARCHAR), 'p' || CAST(1 + l_orderkey % 7 AS VARCHAR)]) AS names, l_returnflag = 'R' AS has_body FROM lineitem),
used AS (SELECT DISTINCT endpoint_id, test_id, request_id, concat(source, ':', name) AS key FROM rq JOIN params USING (endpoint_id)
  WHERE source = 'path' OR (source = 'body' AND has_body) OR (source IN ('query', 'header') AND list_contains(names, name)))"""


def _use(spark, sf_dir):
    p = views.params(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = lambda c: F.concat(F.lit("P"), (1 + F.col(c) % 7).cast("string"))
    names = F.array(name("l_suppkey"), name("l_orderkey"))
    rq = lines.select(F.col("l_partkey").alias("endpoint_id"), F.col("l_orderkey").alias("test_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), names.alias("query_names"), names.alias("header_names"), F.array().cast("array<string>").alias("form_names"), (F.col("l_returnflag") == "R").alias("has_body"))
    return p, rq, P.exercised(rq, p)


@query(f"WITH {_USE} SELECT * FROM used")
def par_exercised(spark, sf_dir):
    return _use(spark, sf_dir)[2]


@query(f"""WITH {_USE}, h AS (SELECT DISTINCT endpoint_id, key FROM used), r AS (SELECT p.*, h.key IS NOT NULL AS u FROM params p LEFT JOIN h ON h.endpoint_id = p.endpoint_id AND h.key = concat(p.source, ':', p.name)),
c AS (SELECT endpoint_id, count(*) AS total, count(*) FILTER (u) AS exercised, count(*) FILTER (required) AS required_total, count(*) FILTER (required AND u) AS required_exercised, count(*) FILTER (NOT required) AS optional_total, count(*) FILTER (NOT required AND u) AS optional_exercised FROM r GROUP BY endpoint_id)
SELECT *, CAST(exercised AS DOUBLE) / total AS rate, CAST(required_exercised AS DOUBLE) / nullif(required_total, 0) AS required_rate, CAST(optional_exercised AS DOUBLE) / nullif(optional_total, 0) AS optional_rate,
  CASE WHEN exercised = total THEN 'fully' WHEN exercised = 0 THEN 'unexercised' ELSE 'partial' END AS status FROM c""")
def par_rates(spark, sf_dir):
    p, _, used = _use(spark, sf_dir)
    return P.parameter_rates(p, used)


@query(f"WITH {_USE}, h AS (SELECT DISTINCT endpoint_id, key FROM used) SELECT p.endpoint_id, p.source, count(*) AS total, count(h.key) AS exercised, CAST(count(h.key) AS DOUBLE) / count(*) AS rate FROM params p LEFT JOIN h ON h.endpoint_id = p.endpoint_id AND h.key = concat(p.source, ':', p.name) GROUP BY p.endpoint_id, p.source")
def par_rates_by_source(spark, sf_dir):
    p, _, used = _use(spark, sf_dir)
    return P.rates_by_source(p, used)


_SETS = _USE + """,
opt AS (SELECT DISTINCT endpoint_id, concat(source, ':', name) AS key FROM params WHERE NOT required),
pr AS (SELECT endpoint_id, test_id, request_id, list_sort(list_distinct(list(key))) AS present FROM used JOIN opt USING (endpoint_id, key) GROUP BY ALL),
sets AS (SELECT rq.endpoint_id, coalesce(present, []) AS present, count(DISTINCT rq.test_id) AS tests FROM rq LEFT JOIN pr USING (endpoint_id, test_id, request_id) GROUP BY ALL)"""


def _sets(spark, sf_dir):
    p, rq, used = _use(spark, sf_dir)
    return p, P.optional_sets(rq, used, p)


@query(f"WITH {_SETS}, k AS (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY tests DESC, present) AS rank FROM sets) SELECT endpoint_id, array_to_string(present, ',') AS present, tests, CAST(rank AS INT) AS rank, rank <= 256 AS listed FROM k")
def par_optional_sets(spark, sf_dir):
    return _sets(spark, sf_dir)[1].withColumn("present", F.array_join("present", ","))


@query(f"WITH {_SETS} SELECT DISTINCT endpoint_id, array_to_string(list_filter(present, lambda x: starts_with(x, 'query:')), ',') AS present FROM sets")
def par_projected_sets(spark, sf_dir):
    return P.project_sets(_sets(spark, sf_dir)[1], "query").withColumn("present", F.array_join("present", ","))


@query(f"WITH {_SETS}, s AS (SELECT endpoint_id, key, count(DISTINCT list_contains(present, key)) AS states FROM opt JOIN sets USING (endpoint_id) GROUP BY ALL) SELECT endpoint_id, count(*) FILTER (states = 2) AS covered, count(*) AS total FROM s GROUP BY endpoint_id")
def par_one_way(spark, sf_dir):
    p, sets = _sets(spark, sf_dir)
    return P.one_way(sets, p)


@query(f"""WITH {_SETS}, s AS (SELECT a.endpoint_id, a.key AS k1, b.key AS k2, count(DISTINCT concat(list_contains(present, a.key), '-', list_contains(present, b.key))) AS states FROM opt a JOIN opt b ON a.endpoint_id = b.endpoint_id AND a.key < b.key JOIN sets ON sets.endpoint_id = a.endpoint_id GROUP BY ALL)
SELECT endpoint_id, count(*) FILTER (states = 4) AS covered_pairs, CAST(sum(states) AS BIGINT) AS states, count(*) AS pairs FROM s GROUP BY endpoint_id""")
def par_two_way(spark, sf_dir):
    p, sets = _sets(spark, sf_dir)
    return P.two_way(sets, p)


# ---- resources

_RCOV = f"""{RES}, {ENDP}, seen AS (SELECT project_id, resource_key, list_distinct(flatten(list(exercised))) AS ex, count(DISTINCT test_id) AS tests, count(DISTINCT CASE WHEN len(exercised) = 4 THEN test_id END) AS full_crud_tests, count(DISTINCT CASE WHEN exercised = ['read'] THEN test_id END) AS read_only_tests FROM rseqs GROUP BY ALL),
rcov AS (SELECT a.project_id, a.resource_key, a.endpoints, a.available, list_filter(a.available, lambda x: list_contains(coalesce(ex, []), x)) AS exercised, list_filter(a.available, lambda x: NOT list_contains(coalesce(ex, []), x)) AS missing, coalesce(tests, 0) AS tests, coalesce(full_crud_tests, 0) AS full_crud_tests, coalesce(read_only_tests, 0) AS read_only_tests FROM avail a LEFT JOIN seen USING (project_id, resource_key))"""


def _rcov(spark, sf_dir):
    r = S.resource_sequences(S.resource_steps(views.steps(spark, sf_dir)))
    return S.resource_coverage(r, S.availability(views.endpoints(spark, sf_dir)))


@query(f"WITH {_RCOV} SELECT * REPLACE (array_to_string(available, ',') AS available, array_to_string(exercised, ',') AS exercised, array_to_string(missing, ',') AS missing) FROM rcov")
def seq_resource_coverage(spark, sf_dir):
    d = _rcov(spark, sf_dir)
    return d.withColumns({c: F.array_join(c, ",") for c in ("available", "exercised", "missing")})


@query(f"""WITH {_RCOV} SELECT len(available) > 1 AS multi, count(*) AS resources, count(*) FILTER (tests > 0) AS tested, count(*) FILTER (len(available) > 0 AND len(missing) = 0) AS fully, count(*) FILTER (full_crud_tests > 0) AS with_full_crud_test,
  count(*) FILTER (exercised = ['read'] AND len(list_filter(available, lambda x: x <> 'read')) > 0) AS read_only_when_writable, avg(CAST(len(available) - len(missing) AS DOUBLE) / len(available)) FILTER (tests > 0 AND len(available) > 0) AS completeness FROM rcov GROUP BY multi""")
def st2_resource_exercise(spark, sf_dir):
    return T.resource_exercise(_rcov(spark, sf_dir))


@query(f"WITH {_RCOV} SELECT op AS operation, count(*) FILTER (list_contains(available, op)) AS available, count(*) FILTER (list_contains(exercised, op)) AS exercised, CAST(count(*) FILTER (list_contains(exercised, op)) AS DOUBLE) / nullif(count(*) FILTER (list_contains(available, op)), 0) AS rate FROM rcov, unnest(['create', 'read', 'update', 'delete']) AS u(op) GROUP BY op")
def st2_per_operation(spark, sf_dir):
    return T.per_operation(_rcov(spark, sf_dir))


_COV = f"""{_MATCH}, t AS (SELECT m.project_id, endpoint_id, count(DISTINCT test_id) AS tests FROM m JOIN steps s ON s.kind = 'http-request' AND s.project_id = m.project_id AND s.http_method = m.http_method AND s.http_path = m.http_path GROUP BY ALL),
cov AS (SELECT el.*, coalesce(tests, 0) AS covering_tests FROM el LEFT JOIN t USING (project_id, endpoint_id))"""


def _cov(spark, sf_dir):
    steps, e, m = _match(spark, sf_dir)
    return C.endpoint_coverage(e, steps, m)


@query(f"""WITH {_COV}, v AS (SELECT CASE WHEN is_method_wildcard AND http_method = 'UNKNOWN' THEN 'WILDCARD' ELSE http_method END AS verb, covering_tests > 0 AS hit FROM cov)
SELECT d.verb, count(v.verb) AS endpoints, count(*) FILTER (v.hit) AS covered, CASE WHEN count(v.verb) > 0 THEN CAST(count(*) FILTER (v.hit) AS DOUBLE) / count(v.verb) END AS share FROM unnest(['GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS', 'TRACE', 'WILDCARD']) AS d(verb) LEFT JOIN v USING (verb) GROUP BY d.verb""")
def st2_coverage_by_verb(spark, sf_dir):
    return T.coverage_by_verb(_cov(spark, sf_dir))


@query(f"WITH {_COV}, bk AS (SELECT CASE WHEN covering_tests = 0 THEN '0' WHEN covering_tests <= 3 THEN '1-3' ELSE '>3' END AS bucket, len(list_filter(string_split(path_template, '/'), lambda x: x <> '')) AS depth FROM cov) SELECT bucket, {summary('depth')} FROM bk GROUP BY bucket")
def st2_coverage_buckets(spark, sf_dir):
    return T.coverage_buckets(_cov(spark, sf_dir).withColumn("depth", U.route_depth("path_template")), "depth")


@query(f"WITH {_COV}, e2 AS (SELECT * FROM cov WHERE covering_tests > 0) SELECT (SELECT count(*) FROM cov) AS endpoints, (SELECT CAST(count(*) FILTER (covering_tests > 0) AS DOUBLE) / count(*) FROM cov) AS covered_share, {summary('covering_tests')} FROM e2")
def st2_coverage_payload(spark, sf_dir):
    return T.coverage_payload(_cov(spark, sf_dir))


@query()
def st2_grouping_comparison(spark, sf_dir):
    steps, e, m = _match(spark, sf_dir)
    return C.grouping_comparison(C.production_keys(S.resource_steps(steps), m, e))


@query()
def st2_prefix_comparison(spark, sf_dir):
    steps, e, _ = _match(spark, sf_dir)
    # Every other request goes through a deploy prefix that the code doesn't declare.
    asked = steps.withColumn("http_path", F.when(F.col("k") % 2 == 0, F.concat(F.lit("/app"), "http_path")).otherwise(F.col("http_path")))
    none = spark.createDataFrame([], "project_id bigint, prefix string")
    more = C.has_lead_segment(asked, ["app"]).withColumn("prefix", F.lit("/app"))
    return C.coverage_with_prefixes(asked, e, none, more)
