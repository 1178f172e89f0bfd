"""Assertions and arguments of call sites: roles, node kinds, status context, guards and recovered paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.operators.rules import assertion_role, prefixes, status_argument

#: Node kinds by method name; names not listed are direct.
NODE_KIND = {"assertThat": "wrapper", "andExpect": "wrapper", "expect": "wrapper", "status": "subject", "body": "subject", "header": "subject", "content": "subject", "isEqualTo": "verifier", "equalTo": "verifier", "is": "verifier", "isOk": "verifier", "isCreated": "verifier", "isNotFound": "verifier", "value": "verifier"}
#: Matchers that compare by equality, and so carry a status code.
EQUALITY = ("is", "equalTo", "isEqualTo", "eq", "assertEquals")
#: Assertion libraries by package.
ASSERTION_PACKAGES = ("org.junit", "org.assertj", "org.hamcrest", "com.google.common.truth", "org.testng", "io.restassured.matcher")
#: HTTP response roles and the assertion role that they stand for.
RESPONSE_ROLE = {"status-assertion": "status", "body-assertion": "body", "header-assertion": "header"}
def _map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def node_kind(method_name: Column) -> Column:
    """CLS-31: wrapper, subject, verifier or direct."""
    return F.coalesce(_map(NODE_KIND, method_name), F.lit("direct"))


def countable(kind: Column) -> Column:
    """CLS-31: only direct calls and verifiers count as checks."""
    return kind.isin("direct", "verifier")


def response_role(role: Column) -> Column:
    """CLS-32: the assertion role of a call with an HTTP response role."""
    return _map(RESPONSE_ROLE, role)


def role_of_arguments(calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """CLS-30: the role of a call from the calls in its arguments: the only one that they have, else general. arguments: call_id, role."""
    per = arguments.filter("role is not null").groupBy("call_id").agg(F.collect_set("role").alias("_r"))
    return calls.join(per, "call_id", "left").withColumn("role", F.coalesce("role", F.when(F.size("_r") == 1, F.get("_r", 0)), F.lit("general"))).drop("_r")


def status_chain(calls: DataFrame, *keys: str) -> DataFrame:
    """CLS-33: verifiers, with in_status: a status subject comes before them in the chain."""
    w = Window.partitionBy(*keys, "chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max((F.col("kind") == "subject") & (F.col("role") == "status")).over(w)
    return calls.withColumn("in_status", F.coalesce(before, F.lit(False))).filter("kind = 'verifier'")


def promoted(matchers: DataFrame, wrappers: DataFrame) -> DataFrame:
    """CLS-34: matchers in an argument take their wrapper's role. matchers: call_id, parent_id; wrappers: call_id, role."""
    w = wrappers.select(F.col("call_id").alias("parent_id"), F.col("role").alias("_r"))
    return matchers.join(w, "parent_id", "left").withColumn("role", F.coalesce("_r", "role")).drop("_r")


def helper_return_types(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """CLS-39: empty receiver types filled with the return type of the helper whose result is called. calls: call_id, receiver_type, helper; methods: method, return_type."""
    m = methods.select(F.col("method").alias("helper"), F.col("return_type").alias("_t"))
    return calls.join(m, "helper", "left").withColumn("receiver_type", F.coalesce(F.nullif("receiver_type", F.lit("")), "_t")).drop("_t")


def recovered_path(path: Column, helper_path: Column) -> Column:
    """CLS-25/41: the helper's path for an event without one; before its query for one that has only a query; the longer of two if one starts with the other."""
    return (
        F.when(path.isNull() | (path == ""), helper_path)
        .when(path.startswith("?"), F.concat(F.coalesce(helper_path, F.lit("")), path))
        .when(helper_path.startswith(path) & (F.length(helper_path) > F.length(path)), helper_path)
        .otherwise(path)
    )


def is_status_evidence(receiver_known: Column, is_response: Column, confident: Column) -> Column:
    """CLS-42: a status needs a known receiver or an HTTP response, or a method that means nothing else."""
    return F.coalesce(confident | receiver_known | is_response, F.lit(False))


def domain_status(argument_types: Column, project_prefixes: list[str]) -> Column:
    """CLS-43: a status that is compared with a type of the project is not an HTTP status."""
    out = F.lit(False)
    for p in project_prefixes:
        out = out | F.exists(argument_types, _starts(p))
    return out


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def matcher_status(method_name: Column, arguments: Column) -> Column:
    """CLS-44: the status code of an equality matcher; other matchers have none."""
    return F.when(method_name.isin(*EQUALITY), status_argument(arguments))


def is_assertion_library(receiver_type: Column) -> Column:
    """CLS-45: the receiver belongs to an assertion library, at a package boundary."""
    return F.coalesce(F.arrays_overlap(prefixes(receiver_type), F.array(*[F.lit(p) for p in ASSERTION_PACKAGES])), F.lit(False))


def classify(calls: DataFrame) -> DataFrame:
    """CLS-27/31/44/45: role, node kind, status code and whether each call counts. calls: method_name, args, receiver_type."""
    m = F.col("method_name")
    out = calls.withColumn("role", F.coalesce(assertion_role(m), F.when(is_assertion_library(F.col("receiver_type")), "general"))).withColumn("kind", node_kind(m))
    return out.withColumn("status_code", matcher_status(m, F.col("args"))).withColumn("counts", F.col("role").isNotNull() & countable(F.col("kind")))
