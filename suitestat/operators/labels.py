"""Labels of tests from evidence rows: oracle, authentication, dispatch, dependencies, preconditions, observed state.

Evidence is found by rule joins: an annotation rule matches a short name, a call rule
matches a receiver's dotted prefix and a method name.  A test's label follows from the
evidence by precedence, and the signals that speak for each label are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitestat.functions.urls import request_target
from suitestat.operators.rules import prefixes

#: Annotation -> (family, label).
ANNOTATION_RULES = {
    "WithMockUser": ("auth", "mocked"), "WithUserDetails": ("auth", "mocked"), "WithAnonymousUser": ("auth", "bypassed"), "PermitAll": ("auth", "bypassed"),
    "Mock": ("dependency", "mocked"), "Spy": ("dependency", "mocked"), "MockBean": ("dependency", "mocked"), "MockitoBean": ("dependency", "mocked"), "InjectMocks": ("dependency", "mocked"),
    "AutoConfigureWireMock": ("dependency", "virtualized"), "WireMockTest": ("dependency", "virtualized"), "Testcontainers": ("dependency", "containerized"), "Container": ("dependency", "containerized"),
    "Sql": ("precondition", "db-seeding"), "DataSet": ("precondition", "db-seeding"), "DatabaseSetup": ("precondition", "db-seeding"),
    "ExpectedDataSet": ("state", "db"), "ExpectedDatabase": ("state", "db"), "Property": ("oracle", "property-based"),
}
#: Fixed values: (receiver prefix, method or * for any) -> (family, label).
CALL_RULES = {
    ("org.springframework.security.test", "*"): ("auth", "mocked"), ("io.restassured", "oauth2"): ("auth", "test-token"), ("io.restassured", "basic"): ("auth", "test-token"),
    ("org.springframework.http", "setBearerAuth"): ("auth", "test-token"), ("org.springframework.http", "setBasicAuth"): ("auth", "test-token"), ("org.keycloak", "*"): ("auth", "real-flow"), ("com.auth0", "*"): ("auth", "real-flow"), ("com.okta", "*"): ("auth", "real-flow"),
    ("org.mockito", "*"): ("dependency", "mocked"), ("com.github.tomakehurst.wiremock", "*"): ("dependency", "virtualized"), ("org.mockserver", "*"): ("dependency", "virtualized"), ("org.testcontainers", "*"): ("dependency", "containerized"),
    ("au.com.dius.pact", "*"): ("oracle", "contract"), ("net.jqwik", "*"): ("oracle", "property-based"), ("org.quicktheories", "*"): ("oracle", "property-based"),
}
AUTH_ORDER = ("real-flow", "test-token", "mocked", "bypassed", "unknown")
ORACLE_ORDER = ("property-based", "contract", "example", "implicit")
IN_PROCESS = ("mockmvc", "webtestclient")


def annotation_evidence(annotations: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(test_id, family, label, signal) from annotations (test_id, short_name); rules: short_name, family, label."""
    if rules is None:
        rules = annotations.sparkSession.createDataFrame([(k, *v) for k, v in ANNOTATION_RULES.items()], "short_name string, family string, label string")
    return annotations.join(F.broadcast(rules), "short_name").select("test_id", "family", "label", F.concat(F.lit("@"), "short_name").alias("signal"))  # a rule table


def call_evidence(calls: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(test_id, family, label, signal) from calls (test_id, receiver_type, method_name): an equi join on the prefixes of the receiver.

    rules: prefix, method_name (* for any), family, label.
    """
    if rules is None:
        rules = calls.sparkSession.createDataFrame([(*k, *v) for k, v in CALL_RULES.items()], "prefix string, rule_method string, family string, label string")
    else:
        rules = rules.withColumnRenamed("method_name", "rule_method")
    rows = calls.select("test_id", "receiver_type", "method_name", F.explode(prefixes(F.col("receiver_type"))).alias("prefix")).join(F.broadcast(rules), "prefix")  # a rule table
    hit = rows.filter((F.col("rule_method") == "*") | (F.col("rule_method") == F.col("method_name")))
    return hit.select("test_id", "family", "label", F.concat_ws(".", "prefix", "method_name").alias("signal"))


def precedence(tests: DataFrame, evidence: DataFrame, order: Sequence[str], default: str) -> DataFrame:
    """SEQ-21/23: the label of each test that comes first in the order, the default without evidence; and its signals."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("label"))
    best = evidence.withColumn("_r", rank).filter("_r > 0").groupBy("test_id", "label", "_r").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    best = best.groupBy("test_id").agg(F.min_by(F.struct("label", "signals"), "_r").alias("_b"))
    return tests.join(best, "test_id", "left").select("test_id", F.coalesce("_b.label", F.lit(default)).alias("label"), F.coalesce("_b.signals", F.array().cast("array<string>")).alias("signals"))


def label_sets(tests: DataFrame, evidence: DataFrame) -> DataFrame:
    """SEQ-24/25: the distinct labels of each test, sorted; none is an empty array."""
    per = evidence.groupBy("test_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return tests.join(per, "test_id", "left").select("test_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def dispatch_labels(requests: DataFrame) -> DataFrame:
    """SEQ-22: how a test's requests are sent: in-process, local or remote network; unknown without evidence. requests: test_id, framework, path."""
    target = request_target("path", True)
    label = F.when(F.col("framework").isin(*IN_PROCESS), "in-process").when(target == "external", "remote-network").when(target == "local", "local-network").otherwise("unknown")
    seen = requests.groupBy("test_id").agg(F.array_sort(F.collect_set(label)).alias("_l"))
    known = F.filter("_l", lambda x: x != "unknown")
    return seen.select("test_id", F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("unknown"))).alias("labels"))


def state_observations(reads: DataFrame, assertions: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """SEQ-26: (test_id, call_id, medium, tier): reads of a medium that an assertion uses.

    reads: test_id, call_id, medium, start, stop, target (the variable that gets the
    value, or null); assertions: test_id, start, stop, names (variables in it);
    assignments: test_id, name, pos of other values that variables get.  Each may have
    scope (the frames of helpers down to the method, a string; without it all is one scope).
    nested: the read stands within an assertion of its scope.  binding: an assertion after
    it names the variable, and the variable has no other value by then: a use takes the
    last assignment before it.  Both are one pass over a scope in order of places: a running
    maximum of the ends of assertions, and an as-of join of uses to assignments by variable.
    Nulls in places bind nothing; an empty table of assertions gives no rows.
    """
    scoped = lambda d: d if "scope" in d.columns else d.withColumn("scope", F.lit(""))
    r, a = scoped(reads), scoped(assertions)
    keys = ["test_id", "scope"]
    spans = a.select(*keys, "start", "stop", F.lit(None).cast(r.schema["call_id"].dataType).alias("call_id"), F.lit(None).cast("string").alias("medium"))
    both = spans.unionByName(r.select(*keys, "start", "stop", "call_id", "medium"))
    w = Window.partitionBy(*keys).orderBy("start", F.col("medium").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.max(F.when(F.col("medium").isNull(), F.col("stop"))).over(w)
    nested = both.withColumn("_until", until).filter("medium is not null and _until >= stop").select("test_id", "call_id", "medium", F.lit("nested").alias("tier"))
    value = F.struct("call_id", "medium")
    sets = r.filter("target is not null").select(*keys, F.col("target").alias("name"), F.col("stop").alias("pos"), F.lit(0).alias("_use"), value.alias("_v"))
    none = F.lit(None).cast(sets.schema["_v"].dataType)
    if assignments is not None:
        sets = sets.unionByName(scoped(assignments).select(*keys, "name", "pos", F.lit(0).alias("_use"), none.alias("_v")))
    uses = a.select(*keys, F.explode(F.array_distinct("names")).alias("name"), F.col("start").alias("pos"), F.lit(1).alias("_use"), none.alias("_v"))
    # A use at the very end of an assignment is before it: pos orders uses first.
    before = Window.partitionBy(*keys, "name").orderBy("pos", F.desc("_use"), "_v").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_use") == 0, F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(before)
    bound = sets.unionByName(uses).withColumn("_last", last).filter("_use = 1 and _last.v is not null").select("test_id", "_last.v.call_id", "_last.v.medium", F.lit("binding").alias("tier"))
    return nested.unionByName(bound).groupBy("test_id", "call_id", "medium").agg(F.max("tier").alias("tier"))


#: Annotations that give a parameterised test its rows.
PARAMETER_SOURCES = {"ValueSource": "static", "CsvSource": "static", "EnumSource": "static", "NullSource": "static", "EmptySource": "static", "CsvFileSource": "dynamic", "MethodSource": "dynamic", "ArgumentsSource": "dynamic", "DataProvider": "dynamic"}


def parameterization(annotations: DataFrame) -> DataFrame:
    """SEQ-28, ST2-13: per test, its source annotations and whether they are static, dynamic or mixed."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in PARAMETER_SOURCES.items() for x in kv]), F.col("short_name"))
    per = annotations.withColumn("_k", kind).filter("_k is not null").groupBy("test_id").agg(F.array_sort(F.collect_set("short_name")).alias("sources"), F.array_sort(F.collect_set("_k")).alias("kinds"))
    return per.select("test_id", "sources", F.when(F.size("kinds") == 2, "mixed").otherwise(F.get("kinds", 0)).alias("kind"))


def inherited_roles(calls: DataFrame, *keys: str) -> DataFrame:
    """CLS-29: members of a chain without a role take that of the nearest member before them that has one."""
    w = Window.partitionBy(*keys, "chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("role", F.coalesce("role", F.last("role", ignorenulls=True).over(w)))


def mocked_calls(calls: DataFrame, parents: DataFrame, wrappers: Sequence[str] = ("when", "given", "doReturn", "verify")) -> DataFrame:
    """CLS-16: calls inside a stubbing or verification wrapper, with the wrapper's kind. calls: call_id, method_name; parents: call_id, parent_id."""
    up = parents.join(calls.select(F.col("call_id").alias("parent_id"), F.col("method_name").alias("wrapper_method")), "parent_id").filter(F.col("wrapper_method").isin(*wrappers))
    return calls.join(up.select("call_id", "wrapper_method"), "call_id").withColumn("mocking", F.when(F.col("wrapper_method") == "verify", "verification").otherwise("stubbing"))


def declarative_requests(calls: DataFrame, mapped: DataFrame, clients: DataFrame) -> DataFrame:
    """CLS-17, EXT-19/20: calls of mapped methods of client interfaces as requests: verb and joined target.

    calls: call_id, receiver_type, callee_signature; mapped: class_name, method_signature, http_method, path; clients: class_name, base.
    """
    from suitestat.functions.urls import join_request_paths

    m = mapped.join(clients, "class_name").withColumnRenamed("class_name", "receiver_type").withColumnRenamed("method_signature", "callee_signature")
    return calls.join(m, ["receiver_type", "callee_signature"]).select("call_id", "http_method", join_request_paths("base", "path").alias("path"))


def fixture_rows(interactions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """SYM-27: per fixture, requests and verifications that it makes. interactions: owner, kind; fixtures: owner, phase."""
    per = interactions.groupBy("owner").agg(F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "verification").alias("verifications"))
    return fixtures.join(per, "owner", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("requests", "verifications")})


def api_tests(requests: DataFrame, tests: DataFrame) -> DataFrame:
    """SYM-29: each test with is_api_test: it dispatches a request."""
    hit = requests.filter("role = 'event'").select("test_id").distinct().withColumn("_a", F.lit(True))
    return tests.join(hit, "test_id", "left").withColumn("is_api_test", F.coalesce("_a", F.lit(False))).drop("_a")


def applicable_fixtures(fixtures: DataFrame, tests: DataFrame) -> DataFrame:
    """SYM-12/28: fixtures of a class for each of its tests: always-run ones, those that share a group, and those whose groups are unknown (ambiguous).

    fixtures: class_name, method_signature, always_run, groups (null: unknown); tests: class_name, test_id, groups.
    """
    t = tests.select("class_name", "test_id", F.col("groups").alias("test_groups"))
    j = fixtures.join(t, "class_name")
    no_groups = F.size(F.coalesce("groups", F.array().cast("array<string>"))) == 0
    unknown = F.col("groups").isNull()
    runs = F.col("always_run") | unknown | no_groups | F.arrays_overlap("groups", "test_groups")
    return j.filter(F.coalesce(runs, F.lit(False))).withColumn("ambiguous", unknown & ~F.col("always_run"))

