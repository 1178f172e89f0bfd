"""Queries on test labels, assertions, cohorts, projects and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from suitestat.operators import aggregates as A
from suitestat.operators import coverage as C
from suitestat.operators import parameters as P
from suitestat.operators import sequences as S
from suitestat.operators import stats_corpus as T
from suitestat.operators import stats_tests as K
from suitestat.plans import views
from suitestat.plans.queries_coverage import _COV, _RCOV, _USE, _cov, _match, _MATCH, _use
from suitestat.plans.queries_sequences import _TESTS
from suitestat.plans.registry import query
from suitestat.plans.sqltext import CRUD, ENDP, PAR, RES, SEG, SEQS, summary
from suitestat.plans.views import ENDPOINTS, PARAMS, STEPS

_R = ("1xx", "2xx", "3xx", "4xx", "5xx", "unknown")
_FLAGS = f"""steps AS ({STEPS}), c AS (SELECT *, CASE WHEN status_code BETWEEN 100 AND 599 THEN concat(CAST(status_code // 100 AS VARCHAR), 'xx') ELSE 'unknown' END AS rng FROM steps WHERE kind = 'response-check'),
t AS (SELECT project_id, test_id, {", ".join(f"count(*) FILTER (assertion_role = '{r}') AS {r}_checks" for r in ("status", "body", "header"))}, {", ".join(f"count(*) FILTER (assertion_role = 'status' AND rng = '{r}') AS n_{r}" for r in _R)} FROM c GROUP BY ALL)"""


def _flags(spark, sf_dir):
    return S.failure_flags(views.steps(spark, sf_dir))


_ROLE3 = "unnest(['status', 'body', 'header']) AS u(role)"
_VAL3 = "CASE role WHEN 'status' THEN status_checks WHEN 'body' THEN body_checks ELSE header_checks END"


@query(f"WITH {_FLAGS}, r AS (SELECT role, {_VAL3} AS value FROM t, {_ROLE3}) SELECT role, CAST(sum(value) AS BIGINT) AS checks, {summary('value')}, CAST(sum(value) AS DOUBLE) / (SELECT sum(value) FROM r) AS proportion FROM r GROUP BY role")
def st1_assertion_targets(spark, sf_dir):
    return K.assertion_targets(_flags(spark, sf_dir))


_SURF = "CASE WHEN status_checks + body_checks + header_checks = 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN status_checks > 0 THEN 'status' END, CASE WHEN body_checks > 0 THEN 'body' END, CASE WHEN header_checks > 0 THEN 'header' END], lambda x: x IS NOT NULL), '+') END"


@query(f"""WITH {_FLAGS}, l AS (SELECT {_SURF} AS s FROM t), m AS (SELECT CASE WHEN s IN ('status', 'body', 'header') THEN concat(s, '-only') ELSE s END AS label FROM l)
SELECT coalesce(d.label, m.label) AS label, count(m.label) AS n, CAST(count(m.label) AS DOUBLE) / (SELECT count(*) FROM m) AS proportion FROM unnest({list(K.SURFACES)!r}) AS d(label) FULL JOIN m USING (label) GROUP BY coalesce(d.label, m.label)""")
def st1_surface_combinations(spark, sf_dir):
    return K.label_table(_flags(spark, sf_dir), K.surface_label(), K.SURFACES)


@query(f"WITH {_FLAGS}, r AS (SELECT test_id, u.range, CASE u.range {' '.join(f'''WHEN '{x}' THEN n_{x}''' for x in _R)} END AS v FROM t, unnest({list(_R)!r}) AS u(range) WHERE status_checks > 0) SELECT range, CAST(sum(v) AS BIGINT) AS checks, count(*) FILTER (v > 0) AS tests, count(*) AS asserting, CAST(sum(v) AS DOUBLE) / (SELECT sum(v) FROM r) AS check_share, CAST(count(*) FILTER (v > 0) AS DOUBLE) / count(*) AS test_share FROM r GROUP BY range")
def st1_status_ranges(spark, sf_dir):
    return K.status_ranges(_flags(spark, sf_dir))


@query(f"""WITH {_FLAGS}, m AS (SELECT CASE WHEN n_2xx > 0 AND n_4xx > 0 AND n_5xx > 0 THEN 'success-and-both-errors' WHEN n_2xx > 0 AND n_4xx > 0 THEN 'success-and-client-error' WHEN n_2xx > 0 AND n_5xx > 0 THEN 'success-and-server-error' WHEN n_2xx > 0 THEN 'success-only' WHEN n_4xx + n_5xx > 0 THEN 'error-only' ELSE 'other-only' END AS mix FROM t WHERE status_checks > 0)
SELECT mix, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM m) AS proportion FROM m GROUP BY mix""")
def st1_status_outcome_mix(spark, sf_dir):
    return K.outcome_mix(_flags(spark, sf_dir))


# An order stands for a test: its priority for the auth label, its status for the oracle.
_AUTH = ("bypassed", "mocked", "test-token", "real-flow", "unknown", "none")
_AUTH_OF = {"1-URGENT": "real-flow", "2-HIGH": "test-token", "3-MEDIUM": "mocked", "4-NOT SPECIFIED": "none", "5-LOW": "bypassed"}


@query(f"""WITH m AS (SELECT CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _AUTH_OF.items())} ELSE 'unknown' END AS label FROM orders)
SELECT d.label, count(m.label) AS n, CAST(count(m.label) AS DOUBLE) / (SELECT count(*) FROM m) AS proportion FROM unnest({list(_AUTH)!r}) AS d(label) LEFT JOIN m USING (label) GROUP BY d.label""")
def st1_auth_labels(spark, sf_dir):
    label = F.lit("unknown")
    for k, v in _AUTH_OF.items():
        label = F.when(F.col("o_orderpriority") == k, v).otherwise(label)
    return K.label_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), label, _AUTH)


@query("SELECT o_orderstatus AS label, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) AS proportion FROM orders GROUP BY o_orderstatus")
def st1_oracle_types(spark, sf_dir):
    return K.label_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderstatus"), ("F", "O", "P"))


# A test's dispatch frameworks are its labels.
_LAB = f"steps AS ({STEPS}), t AS (SELECT test_id, list_distinct(list(framework) FILTER (kind = 'http-request')) AS labels, count(*) AS steps, count(*) FILTER (kind = 'http-request') AS requests FROM steps GROUP BY test_id HAVING count(*) FILTER (kind = 'http-request') > 0)"
_FW = ("mockmvc", "rest-assured", "webtestclient", "okhttp", "jax-rs", "karate")


def _labelled(spark, sf_dir):
    s = views.steps(spark, sf_dir)
    return s.groupBy("test_id").agg(F.collect_set(F.when(F.col("kind") == "http-request", F.col("framework"))).alias("labels"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("kind") == "http-request").alias("requests")).filter("requests > 0")


@query(f"WITH {_LAB}, e AS (SELECT test_id, unnest(labels) AS label FROM t) SELECT d.label, count(DISTINCT e.test_id) AS n, (SELECT count(*) FROM t) AS total, CAST(count(DISTINCT e.test_id) AS DOUBLE) / (SELECT count(*) FROM t) AS proportion FROM unnest({list(_FW)!r}) AS d(label) LEFT JOIN e USING (label) GROUP BY d.label")
def st1_dispatch_labels(spark, sf_dir):
    return K.overlapping_labels(_labelled(spark, sf_dir), "test_id", "labels", _FW)


@query(f"WITH {_LAB}, k AS (SELECT len(labels) AS n FROM t) SELECT {summary('n')}, CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*) AS share_multiple FROM k")
def st1_label_counts(spark, sf_dir):
    return K.label_counts(_labelled(spark, sf_dir), "labels")


@query(f"WITH {_LAB}, e AS (SELECT unnest(labels) AS label, steps, requests FROM t), l AS (SELECT label, m AS metric, CASE m WHEN 'steps' THEN steps ELSE requests END AS value FROM e, unnest(['steps', 'requests']) AS u(m)) SELECT label, metric, {summary('value')} FROM l GROUP BY label, metric")
def st1_metrics_per_label(spark, sf_dir):
    return K.metrics_by_label(_labelled(spark, sf_dir), "labels", ("steps", "requests"))


@query(f"""WITH steps AS ({STEPS}), t AS (SELECT test_id, count(*) AS steps, count(*) FILTER (kind = 'http-request') AS requests, count(*) FILTER (kind = 'response-check') AS checks FROM steps GROUP BY test_id),
c AS (SELECT CASE WHEN requests > 0 THEN 'api' ELSE 'non-api' END AS label, * FROM t UNION ALL SELECT 'checking', * FROM t WHERE checks > 0), l AS (SELECT label, m AS metric, CASE m WHEN 'steps' THEN steps WHEN 'requests' THEN requests ELSE checks END AS value FROM c, unnest(['steps', 'requests', 'checks']) AS u(m))
SELECT label, metric, {summary('value')} FROM l GROUP BY label, metric""")
def st1_cohort_metrics(spark, sf_dir):
    s = views.steps(spark, sf_dir)
    k = lambda x: F.count_if(F.col("kind") == x)
    t = s.groupBy("test_id").agg(F.count(F.lit(1)).alias("steps"), k("http-request").alias("requests"), k("response-check").alias("checks"))
    cohort = F.array_compact(F.array(F.when(F.col("requests") > 0, "api").otherwise("non-api"), F.when(F.col("checks") > 0, "checking")))
    return K.metrics_by_label(t.withColumn("cohorts", cohort), "cohorts", ("steps", "requests", "checks"))


_KINDS = ("request-build", "http-request", "response-check")


@query(f"""WITH steps AS ({STEPS}), s AS (SELECT *, CASE WHEN origin_kind LIKE 'fixture%' THEN 'fixture' ELSE origin_kind END AS loc FROM steps), ids AS (SELECT DISTINCT test_id FROM s),
g AS (SELECT test_id, kk AS kind, ll AS location, (SELECT count(*) FROM s WHERE s.test_id = ids.test_id AND s.kind = kk AND (ll = 'total' OR s.loc = ll)) AS v FROM ids, unnest({list(_KINDS)!r}) AS a(kk), unnest(['test-method', 'test-helper', 'fixture', 'total']) AS b(ll))
SELECT kind, location, {summary('v')} FROM g GROUP BY kind, location""")
def st1_behaviour_location(spark, sf_dir):
    return K.behaviour_location(views.steps(spark, sf_dir), S.origin("origin_kind"))


@query(f"WITH steps AS ({STEPS}) SELECT framework, count(*) AS call_sites, count(*) FILTER (kind = 'http-request') AS events, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM steps) AS site_share FROM steps GROUP BY framework")
def st1_dispatch_frameworks(spark, sf_dir):
    s = views.steps(spark, sf_dir).groupBy("framework").agg(F.count(F.lit(1)).alias("call_sites"), F.count_if(F.col("kind") == "http-request").alias("events"))
    return s.withColumn("site_share", A.count_share("call_sites", F.sum("call_sites").over(Window.partitionBy())))


_FWC = list(K.FRAMEWORK_CATEGORY)


@query(f"""WITH c AS (SELECT p_partkey, list_distinct([{_FWC!r}[1 + p_size % {len(_FWC)}], {_FWC!r}[1 + p_partkey % {len(_FWC)}]]) AS f FROM part), e AS (SELECT p_partkey, unnest(f) AS name FROM c),
k AS (SELECT *, CASE {' '.join(f"WHEN name = '{a}' THEN '{b}'" for a, b in K.FRAMEWORK_CATEGORY.items())} END AS category FROM e)
SELECT 'framework' AS kind, name, count(DISTINCT p_partkey) AS n FROM k GROUP BY name UNION ALL SELECT 'category', category, count(DISTINCT p_partkey) FROM k GROUP BY category""")
def st1_testing_frameworks(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in _FWC])
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array(F.get(names, F.col("p_size") % len(_FWC)), F.get(names, (F.col("p_partkey") % len(_FWC)).cast("int"))).alias("f"))
    return K.framework_table(p, "p_partkey", "f")


# ---- request construction: names and builders of the lines of an order


@query("SELECT name, count(*) AS occurrences, count(DISTINCT l_orderkey) AS tests FROM (SELECT l_orderkey, unnest([lower(l_returnflag), lower(l_linestatus), 'x-' || CAST(l_suppkey % 5 AS VARCHAR)]) AS name FROM lineitem) GROUP BY name")
def st2_header_vocabulary(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.array("l_returnflag", F.concat(F.lit(" "), "l_linestatus"), F.concat(F.lit("X-"), (F.col("l_suppkey") % 5).cast("string"))).alias("names"))
    return K.vocabulary(d, "l_orderkey", "names")


@query("""WITH x AS (SELECT l_orderkey, s AS surface, CASE s WHEN 'body' THEN l_returnflag = 'R' WHEN 'query' THEN l_suppkey % 3 = 0 ELSE l_linestatus = 'O' END AS has FROM lineitem, unnest(['body', 'query', 'header']) AS u(s))
SELECT surface, count(*) FILTER (has) AS events, count(DISTINCT CASE WHEN has THEN l_orderkey END) AS tests, count(*) AS total, CAST(count(*) FILTER (has) AS DOUBLE) / count(*) AS proportion FROM x GROUP BY surface""")
def st2_event_surfaces(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return K.event_surfaces(d, "l_orderkey", {"body": F.col("l_returnflag") == "R", "query": F.col("l_suppkey") % 3 == 0, "header": F.col("l_linestatus") == "O"})


_PROP = "['body', 'header', 'query', 'path']"


@query(f"""WITH b AS (SELECT l_orderkey, list_distinct(list({_PROP}[1 + l_suppkey % 4])) AS ps FROM lineitem GROUP BY l_orderkey), g AS (SELECT count(*) AS groups, count(*) FILTER (list_contains(ps, 'body')) AS body_groups FROM b), e AS (SELECT list_contains(ps, 'body') AS b, unnest(ps) AS property FROM b)
SELECT property, count(*) AS n, count(*) FILTER (b) AS n_with_body, any_value(groups) AS groups, any_value(body_groups) AS body_groups, CAST(count(*) AS DOUBLE) / any_value(groups) AS share, CAST(count(*) FILTER (b) AS DOUBLE) / any_value(body_groups) AS share_with_body FROM e, g GROUP BY property""")
def st2_builder_properties(spark, sf_dir):
    prop = F.get(F.array(*[F.lit(x) for x in ("body", "header", "query", "path")]), (F.col("l_suppkey") % 4).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.array(prop)).alias("groups"))
    return K.builder_properties(d, "groups")


_PRE = ("db-seeding", "mq-seeding", "fs-seeding", "container-bootstrap")


@query(f"""WITH o AS (SELECT l_orderkey, list({list(_PRE)!r}[1 + l_partkey % 4]) AS pre FROM lineitem GROUP BY l_orderkey), x AS (SELECT k AS label, len(list_filter(pre, lambda y: y = k)) AS n FROM o, unnest({list(_PRE)!r}) AS u(k))
SELECT label, count(*) FILTER (n > 0) AS tests, {summary('n')} FROM x GROUP BY label""")
def st2_state_conditions(spark, sf_dir):
    pre = F.get(F.array(*[F.lit(x) for x in _PRE]), (F.col("l_partkey") % 4).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(pre).alias("pre"))
    return K.state_conditions(d, "pre", _PRE)


@query(f"""WITH o AS (SELECT l_orderkey, list({list(_PRE)!r}[1 + l_partkey % 4]) AS pre, list(['db', 'mq', 'fs'][1 + l_suppkey % 3]) AS post FROM lineitem GROUP BY l_orderkey)
SELECT m AS medium, count(*) FILTER (list_contains(pre, m || '-seeding')) AS pre, count(*) FILTER (list_contains(post, m)) AS post, count(*) FILTER (list_contains(pre, m || '-seeding') AND list_contains(post, m)) AS both FROM o, unnest(['db', 'mq', 'fs']) AS u(m) GROUP BY m""")
def st2_state_co_occurrence(spark, sf_dir):
    pre = F.get(F.array(*[F.lit(x) for x in _PRE]), (F.col("l_partkey") % 4).cast("int"))
    post = F.get(F.array(F.lit("db"), F.lit("mq"), F.lit("fs")), (F.col("l_suppkey") % 3).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(pre).alias("pre"), F.collect_list(post).alias("post"))
    return K.co_occurring(d, "pre", "post")


# ---- endpoints and parameters


@query(f"""WITH endpoints AS ({ENDPOINTS}), {PAR}, s AS (SELECT e.endpoint_id, count(p.name) AS total, count(*) FILTER (p.required) AS req FROM endpoints e LEFT JOIN params p USING (endpoint_id) GROUP BY e.endpoint_id), l AS (SELECT m AS metric, CASE m WHEN 'total_params' THEN total ELSE req END AS value FROM s, unnest(['total_params', 'required_params']) AS u(m))
SELECT metric, {summary('value')} FROM l GROUP BY metric""")
def st2_surface_summaries(spark, sf_dir):
    return T.surface_summaries(C.surface(views.endpoints(spark, sf_dir), views.params(spark, sf_dir)), "total_params", "required_params")


_OUT = f"""{_MATCH}, {SEG.replace(f"steps AS ({STEPS}),", "")},
f AS (SELECT * FROM (SELECT project_id, test_id, seq, http_method, http_path, row_number() OVER (PARTITION BY test_id, seq ORDER BY pos) AS rn FROM seg WHERE kind = 'http-request') WHERE rn = 1),
k AS (SELECT project_id, test_id, seq, CASE WHEN status_code IS NULL THEN 'unknown' ELSE concat(CAST(status_code // 100 AS VARCHAR), 'xx') END AS range, count(*) AS n FROM seg WHERE kind = 'response-check' AND assertion_role = 'status' GROUP BY ALL),
outc AS (SELECT f.project_id, m.endpoint_id, k.range, CAST(sum(k.n) AS BIGINT) AS checks FROM f JOIN m ON m.project_id = f.project_id AND m.http_method = f.http_method AND m.http_path = f.http_path JOIN k ON k.test_id = f.test_id AND k.seq = f.seq GROUP BY ALL)"""


def _outcomes(spark, sf_dir):
    _, e, m = _match(spark, sf_dir)
    return C.outcomes(S.segment(views.steps(spark, sf_dir)), e, m)


@query(f"WITH {_OUT}, e AS (SELECT project_id, endpoint_id, bool_or(range = '2xx') AS ok, bool_or(range IN ('4xx', '5xx')) AS bad FROM outc GROUP BY ALL), l AS (SELECT CASE WHEN ok AND bad THEN 'both' WHEN ok THEN 'success-only' WHEN bad THEN 'error-only' ELSE 'neither' END AS mix FROM e) SELECT mix, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM l) AS proportion FROM l GROUP BY mix")
def st2_endpoint_outcome_mix(spark, sf_dir):
    return T.outcome_mix(_outcomes(spark, sf_dir))


@query(f"WITH {_OUT}, g AS (SELECT count(*) AS a FROM (SELECT DISTINCT project_id, endpoint_id FROM outc)) SELECT range, CAST(sum(checks) AS BIGINT) AS checks, count(*) AS endpoints, CAST(sum(checks) AS DOUBLE) / (SELECT sum(checks) FROM outc) AS check_share, any_value(a) AS asserted, CAST(count(*) AS DOUBLE) / any_value(a) AS endpoint_share FROM outc, g GROUP BY range")
def st2_asserted_ranges(spark, sf_dir):
    return T.asserted_ranges(_outcomes(spark, sf_dir))


_RATE = f"""{_USE}, h AS (SELECT DISTINCT endpoint_id, key FROM used), r AS (SELECT p.*, h.key IS NOT NULL AS u FROM params p LEFT JOIN h ON h.endpoint_id = p.endpoint_id AND h.key = concat(p.source, ':', p.name)),
rates AS (SELECT endpoint_id, CAST(count(*) FILTER (u) AS DOUBLE) / count(*) AS rate, CAST(count(*) FILTER (required AND u) AS DOUBLE) / nullif(count(*) FILTER (required), 0) AS required_rate, CAST(count(*) FILTER (NOT required AND u) AS DOUBLE) / nullif(count(*) FILTER (NOT required), 0) AS optional_rate FROM r GROUP BY endpoint_id)"""


@query(f"WITH {_RATE}, l AS (SELECT m AS metric, CASE m WHEN 'rate' THEN rate WHEN 'required_rate' THEN required_rate ELSE optional_rate END AS value FROM rates, unnest(['rate', 'required_rate', 'optional_rate']) AS u(m)) SELECT metric, {summary('value')} FROM l WHERE value IS NOT NULL GROUP BY metric")
def st2_holistic_rates(spark, sf_dir):
    p, _, used = _use(spark, sf_dir)
    return T.holistic_rates(P.parameter_rates(p, used), "rate", "required_rate", "optional_rate")


@query(f"WITH {_RATE}, s AS (SELECT endpoint_id, source, count(*) AS t, count(*) FILTER (u) AS e, CAST(count(*) FILTER (u) AS DOUBLE) / count(*) AS rate FROM r GROUP BY endpoint_id, source) SELECT source, {summary('rate')}, CAST(sum(e) AS DOUBLE) / sum(t) AS pooled_rate FROM s GROUP BY source")
def st2_rates_by_source(spark, sf_dir):
    p, _, used = _use(spark, sf_dir)
    return T.rates_by_source(P.rates_by_source(p, used))


@query(f"WITH {_RATE} SELECT count(*) AS endpoints, count(*) FILTER (optional_rate = 1) AS all_exercised, count(*) FILTER (optional_rate = 0) AS none_exercised, CAST(count(*) FILTER (optional_rate = 1) AS DOUBLE) / count(*) AS all_share, CAST(count(*) FILTER (optional_rate = 0) AS DOUBLE) / count(*) AS none_share FROM rates WHERE optional_rate IS NOT NULL")
def st2_optional_extremes(spark, sf_dir):
    p, _, used = _use(spark, sf_dir)
    return T.optional_extremes(P.parameter_rates(p, used))


# ---- resources

_LIFE = f"""{RES}, life AS (SELECT *, regexp_matches(ops, '[cud].*r') AS raw, regexp_matches(ops, 'c.*d') AS clean, CASE WHEN ops = '' THEN 'other' WHEN len(exercised) = 4 THEN 'full-crud' WHEN exercised = ['read'] THEN 'read-only' WHEN exercised = ['create'] THEN 'create-and-trust'
    WHEN exercised = ['create', 'read', 'update'] AND regexp_matches(ops, 'c.*u.*r') THEN 'create-update-verify' WHEN exercised = ['create', 'read', 'delete'] AND regexp_matches(ops, 'c.*r.*d') THEN 'create-verify-cleanup'
    WHEN exercised = ['create', 'read'] AND regexp_matches(ops, 'c.*r') THEN 'create-verify' WHEN exercised = ['read', 'delete'] AND regexp_matches(ops, 'd.*r') THEN 'delete-verify' WHEN NOT list_contains(exercised, 'read') THEN 'write-only' ELSE 'other' END AS lifecycle FROM rseqs)"""


def _life(spark, sf_dir):
    return S.resource_sequences(S.resource_steps(views.steps(spark, sf_dir))).withColumn("lifecycle", S.lifecycle())


@query(f"WITH {_LIFE} SELECT d.lifecycle, count(l.ops) AS n, CAST(count(l.ops) AS DOUBLE) / (SELECT count(*) FROM life) AS proportion FROM unnest({list(S.LIFECYCLES)!r}) AS d(lifecycle) LEFT JOIN life l USING (lifecycle) GROUP BY d.lifecycle")
def st2_lifecycle_labels(spark, sf_dir):
    return T.lifecycle_labels(_life(spark, sf_dir), S.LIFECYCLES)


@query(f"WITH {_LIFE}, t AS (SELECT test_id, count(DISTINCT lifecycle) AS k, bool_or(raw) AS raw, bool_or(clean) AS clean FROM life GROUP BY test_id) SELECT count(*) AS tests, count(*) FILTER (k > 1) AS multi_label, count(*) FILTER (raw) AS read_after_write, count(*) FILTER (clean) AS cleanup_delete FROM t")
def st2_lifecycle_per_test(spark, sf_dir):
    return T.lifecycle_per_test(_life(spark, sf_dir))


@query(f"WITH steps AS ({STEPS}), x AS (SELECT CASE WHEN http_method IN ('GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS') THEN http_method ELSE 'UNKNOWN' END AS key FROM steps WHERE kind = 'http-request') SELECT d.key, count(x.key) AS n, CAST(count(x.key) AS DOUBLE) / (SELECT count(*) FROM x) AS proportion FROM unnest({list(S.METHODS)!r}) AS d(key) LEFT JOIN x USING (key) GROUP BY d.key")
def st2_method_distribution(spark, sf_dir):
    return T.method_distribution(views.steps(spark, sf_dir), S.canonical_method("http_method"), S.METHODS)


@query(f"WITH steps AS ({STEPS}), x AS (SELECT {CRUD.format('http_method')} AS key FROM steps WHERE kind = 'http-request') SELECT d.key, count(x.key) AS n, CAST(count(x.key) AS DOUBLE) / (SELECT count(key) FROM x) AS proportion FROM unnest(['create', 'read', 'update', 'delete']) AS d(key) LEFT JOIN x USING (key) GROUP BY d.key")
def st2_crud_distribution(spark, sf_dir):
    return T.method_distribution(views.steps(spark, sf_dir), S.crud("http_method"), A.CRUD)


@query(f"WITH {_RCOV}, c AS (SELECT CASE WHEN len(available) = 1 THEN concat(available[1], '-only') ELSE array_to_string(available, '-') END AS combination FROM rcov WHERE len(available) > 0) SELECT d.combination, count(c.combination) AS n, (SELECT count(*) FROM c) AS total, CAST(count(c.combination) AS DOUBLE) / (SELECT count(*) FROM c) AS proportion FROM unnest({A.subsets()!r}) AS d(combination) LEFT JOIN c USING (combination) GROUP BY d.combination")
def st2_availability_profile(spark, sf_dir):
    return A.combination_table(S.availability(views.endpoints(spark, sf_dir)), "available")


_SCOPE = f"""steps AS ({STEPS}), s AS (SELECT test_id, count(*) FILTER (kind = 'http-request') AS rq, count(DISTINCT CASE WHEN kind = 'http-request' THEN regexp_replace(http_path, '/[0-9]+$', '') END) AS rs, count(DISTINCT CASE WHEN kind = 'http-request' THEN concat(http_method, regexp_replace(http_path, '/[0-9]+$', '/id')) END) AS ep FROM steps GROUP BY test_id)"""
_LEVEL = "CASE WHEN {0} = 0 THEN 'none' WHEN {0} = 1 THEN 'single' ELSE 'multi' END"


@query(f"WITH {_SCOPE}, l AS (SELECT {_LEVEL.format('rq')} AS requests, {_LEVEL.format('rs')} AS resources, {_LEVEL.format('ep')} AS endpoints FROM s) SELECT requests, resources, endpoints, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY requests, resources) AS share_of_parent FROM l GROUP BY requests, resources, endpoints")
def st2_test_scope(spark, sf_dir):
    s = views.steps(spark, sf_dir)
    asked = F.col("kind") == "http-request"
    key = F.regexp_replace("http_path", "/[0-9]+$", "")
    t = s.groupBy("test_id").agg(F.count_if(asked).alias("requests"), F.count_distinct(F.when(asked, key)).alias("resources"), F.count_distinct(F.when(asked, F.concat("http_method", F.regexp_replace("http_path", "/[0-9]+$", "/id")))).alias("endpoints"))
    return T.test_scope(t)


# ---- projects: a nation's customers stand for projects where many are needed

_CPLX = f"""{_TESTS}, res AS (SELECT project_id, test_id, true AS all_resolved FROM te), proj AS (SELECT project_id, count(*) AS api_tests, count(*) AS resolved_tests, count(*) FILTER (sequences > 1) AS multi_tests, CAST(sum(sequences) AS BIGINT) AS total_sequences, max(sequences) AS max_sequences, avg(sequences) AS mean_sequences FROM te GROUP BY project_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY api_tests DESC, multi_tests DESC, total_sequences DESC, project_id) AS rank FROM proj)"""


def _proj(spark, sf_dir):
    seg = S.segment(views.steps(spark, sf_dir))
    return T.complexity(S.sequence_summary(seg, S.sequences(seg)))


@query(f"WITH {_CPLX} SELECT project_id, api_tests, resolved_tests, multi_tests, total_sequences, max_sequences, mean_sequences FROM proj")
def st2_project_complexity(spark, sf_dir):
    return _proj(spark, sf_dir)


@query(f"WITH {_CPLX} SELECT project_id, api_tests, multi_tests, total_sequences, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= greatest(1, ceil((SELECT count(*) FROM ranked) * 0.4))")
def st2_top_sample(spark, sf_dir):
    return T.select_sample(T.rank_projects(_proj(spark, sf_dir)), percent=40).select("project_id", "api_tests", "multi_tests", "total_sequences", "rank")


@query(f"WITH {_CPLX}, s AS (SELECT * FROM ranked WHERE rank <= 3) SELECT (SELECT count(*) FROM ranked) AS ranked_projects, count(*) AS selected_projects, CAST(sum(api_tests) AS BIGINT) AS api_tests, CAST(sum(total_sequences) AS BIGINT) AS sequences, 'top' AS mode FROM s")
def st2_sample_payload(spark, sf_dir):
    ranked = T.rank_projects(_proj(spark, sf_dir))
    return T.sample_payload(T.select_sample(ranked, count=3), ranked, "top")


@query(f"WITH {_CPLX} SELECT project_id, CAST(sum(api_tests) AS BIGINT) AS api_tests, count(*) AS projects FROM proj GROUP BY ROLLUP (project_id)")
def st2_inventory(spark, sf_dir):
    return T.inventory(_proj(spark, sf_dir))


@query()
def st2_random_sample(spark, sf_dir):
    return T.random_sample(T.rank_projects(_proj(spark, sf_dir)), 4, 7)


@query("""WITH p AS (SELECT c_custkey, count(DISTINCT o_orderkey) AS t, c_custkey % 3 AS e FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), q AS (SELECT concat(CASE WHEN e > 0 THEN 'endpoints' ELSE 'no-endpoints' END, '/', CASE WHEN t > 0 THEN 'tests' ELSE 'no-tests' END) AS quadrant FROM p)
SELECT d.quadrant, count(q.quadrant) AS n, CAST(count(q.quadrant) AS DOUBLE) / (SELECT count(*) FROM q) AS proportion FROM unnest(['endpoints/tests', 'endpoints/no-tests', 'no-endpoints/tests', 'no-endpoints/no-tests']) AS d(quadrant) LEFT JOIN q USING (quadrant) GROUP BY d.quadrant""")
def st2_project_quadrants(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("t"))
    return T.quadrants(c.join(o, c["c_custkey"] == o["o_custkey"], "left").select((F.col("c_custkey") % 3).alias("endpoints"), F.coalesce("t", F.lit(0)).alias("api_tests")))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def st2_population_gate(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "project_id")
    gate = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "project_id")
    return T.gated(lines, gate).agg(F.count(F.lit(1)).alias("n"))
