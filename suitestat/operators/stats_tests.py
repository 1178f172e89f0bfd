"""Statistics over tests: labels, assertions, cohorts, frameworks, request construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.operators.aggregates import count_share, domain, observed_and_canonical, summary

ROLES = ("status", "body", "header")
SURFACES = ("none", "status-only", "body-only", "header-only", "status+body", "status+header", "body+header", "status+body+header")
#: Testing frameworks by category.
FRAMEWORK_CATEGORY = {
    "junit3": "unit", "junit4": "unit", "junit5": "unit", "testng": "unit",
    "assertj": "assertion", "hamcrest": "assertion", "google-truth": "assertion",
    "mockito": "mocking", "easymock": "mocking", "powermock": "mocking", "jmockit": "mocking", "jmock": "mocking",
    "spring-test": "integration", "rest-assured": "api", "karate": "api", "pact": "api", "citrus": "api",
}


def surface_label() -> Column:
    """SRC-09: which of status, body and header a test asserts: none, x-only, or joined by +."""
    parts = F.array_compact(F.array(*[F.when(F.col(f"{r}_checks") > 0, r) for r in ROLES]))
    return F.when(F.size(parts) == 0, "none").when(F.size(parts) == 1, F.concat(F.get(parts, 0), F.lit("-only"))).otherwise(F.array_join(parts, "+"))


def label_table(df: DataFrame, label: Column, keys: Sequence[str]) -> DataFrame:
    """Rows by label, every key listed, others after them (ST1-03, ST1-04, ST1-15, ST2-14)."""
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = observed_and_canonical(counts, "label", keys)
    return out.withColumn("proportion", count_share("n", F.sum("n").over(Window.partitionBy()))).drop("rank")


def overlapping_labels(df: DataFrame, key: str, labels: str, keys: Sequence[str]) -> DataFrame:
    """ST1-16/21: tests under each label; a test counts under each label that it has, and all tests are the total."""
    per = df.select(key, F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count_distinct(key).alias("n"))
    out = observed_and_canonical(per, "label", keys).drop("rank")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return out.crossJoin(total).withColumn("proportion", count_share("n", "total"))  # one row of totals


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """ST1-16: a summary of how many labels tests have, and the share with several."""
    k = F.size(F.array_distinct(labels))
    return df.agg(*summary(k), F.try_divide(F.count_if(k > 1).cast("double"), F.count(F.lit(1))).alias("share_multiple"))


def metrics_by_label(df: DataFrame, labels: str, metrics: Sequence[str]) -> DataFrame:
    """ST1-20/22/23: a summary of each metric by label or overlapping cohort."""
    rows = df.select(F.explode(F.array_distinct(labels)).alias("label"), *metrics)
    return rows.unpivot(["label"], list(metrics), "metric", "value").groupBy("label", "metric").agg(*summary("value"))


def assertion_targets(tests: DataFrame) -> DataFrame:
    """ST1-01/02: checks by role with their share, and a summary of a test's checks of the role."""
    rows = tests.unpivot([], [f"{r}_checks" for r in ROLES], "role", "value").withColumn("role", F.regexp_replace("role", "_checks$", ""))
    out = rows.groupBy("role").agg(F.sum("value").alias("checks"), *summary("value"))
    return out.withColumn("proportion", count_share("checks", F.sum("checks").over(Window.partitionBy())))


def status_ranges(tests: DataFrame, ranges: Sequence[str] = ("1xx", "2xx", "3xx", "4xx", "5xx", "unknown")) -> DataFrame:
    """ST1-05/06: checks of each status range and tests with one, over all status checks and over all tests that check a status."""
    rows = tests.filter("status_checks > 0").unpivot(["test_id"], [f"n_{r}" for r in ranges], "range", "value").withColumn("range", F.regexp_replace("range", "^n_", ""))
    out = rows.groupBy("range").agg(F.sum("value").alias("checks"), F.count_if(F.col("value") > 0).alias("tests"), F.count(F.lit(1)).alias("asserting"))
    return out.withColumn("check_share", count_share("checks", F.sum("checks").over(Window.partitionBy()))).withColumn("test_share", count_share("tests", "asserting"))


def outcome_mix(tests: DataFrame) -> DataFrame:
    """ST1-07/08: tests that check a status by what they expect, success with errors split by the side of the error."""
    ok, client, server = (F.col(f"n_{r}") > 0 for r in ("2xx", "4xx", "5xx"))
    label = (
        F.when(ok & client & server, "success-and-both-errors").when(ok & client, "success-and-client-error").when(ok & server, "success-and-server-error")
        .when(ok, "success-only").when(client | server, "error-only").otherwise("other-only")
    )
    out = tests.filter("status_checks > 0").groupBy(label.alias("mix")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("proportion", count_share("n", F.sum("n").over(Window.partitionBy())))


def framework_table(df: DataFrame, key: str, frameworks: str) -> DataFrame:
    """ST1-17: classes by testing framework and by category."""
    names = domain(df.sparkSession, "framework", list(FRAMEWORK_CATEGORY)).select("framework", F.element_at(F.create_map(*[F.lit(x) for kv in FRAMEWORK_CATEGORY.items() for x in kv]), F.col("framework")).alias("category"))
    rows = df.select(key, F.explode(F.array_distinct(frameworks)).alias("framework")).join(F.broadcast(names), "framework")  # a fixed list
    per = rows.groupBy("framework").agg(F.count_distinct(key).alias("n")).select(F.lit("framework").alias("kind"), F.col("framework").alias("name"), "n")
    by = rows.groupBy("category").agg(F.count_distinct(key).alias("n")).select(F.lit("category").alias("kind"), F.col("category").alias("name"), "n")
    return per.unionByName(by)


def behaviour_location(steps: DataFrame, origin: Column) -> DataFrame:
    """ST1-24/25: builders, requests and verifications of a test by where they stand, and in total (location null): a summary over tests.

    Grouping sets give the parts and the total of one pass; tests without a unit count as 0.
    """
    rows = steps.withColumn("location", origin)
    places = [r[0] for r in [("test-method",), ("test-helper",), ("fixture",)]]
    per = rows.groupBy("test_id").agg(*[F.count_if((F.col("kind") == k) & (F.col("location") == p)).alias(f"{k}|{p}") for k in ("request-build", "http-request", "response-check") for p in places], *[F.count_if(F.col("kind") == k).alias(f"{k}|total") for k in ("request-build", "http-request", "response-check")])
    long = per.unpivot(["test_id"], [c for c in per.columns if c != "test_id"], "cell", "value")
    cell = F.split("cell", r"\|")
    return long.groupBy(F.get(cell, 0).alias("kind"), F.get(cell, 1).alias("location")).agg(*summary("value"))


def vocabulary(requests: DataFrame, key: str, names: str) -> DataFrame:
    """ST2-19: header names in lower case with occurrences and tests."""
    rows = requests.select(key, F.explode(names).alias("name")).withColumn("name", F.lower(F.trim("name"))).filter("name <> ''")
    out = rows.groupBy("name").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(key).alias("tests"))
    return out


def event_surfaces(requests: DataFrame, key: str, surfaces: dict[str, Column]) -> DataFrame:
    """ST2-16: requests and tests with each surface."""
    rows = requests.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("surface"), c.alias("has")) for n, c in surfaces.items()])).alias("x"))
    out = rows.groupBy("x.surface").agg(F.count_if("x.has").alias("events"), F.count_distinct(F.when(F.col("x.has"), F.col(key))).alias("tests"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("proportion", count_share("events", "total"))


def builder_properties(requests: DataFrame, groups: str) -> DataFrame:
    """ST2-18/20: properties that correlated builders set, over all groups and over groups with a body builder."""
    g = requests.filter(F.size(groups) > 0)
    has_body = F.exists(F.col(groups), lambda b: F.array_contains(b, "body"))
    rows = g.select(has_body.alias("b"), F.explode(F.array_distinct(F.flatten(groups))).alias("property"))
    total = g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(has_body).alias("body_groups"))
    out = rows.groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("n_with_body"))
    return out.crossJoin(total).withColumn("share", count_share("n", "groups")).withColumn("share_with_body", count_share("n_with_body", "body_groups"))  # one row of totals


def _is(key: str):
    return lambda x: x == key


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def state_conditions(tests: DataFrame, labels: str, keys: Sequence[str]) -> DataFrame:
    """ST2-46: entries of a test under each label, zeros included, summarised; tests with the label."""
    rows = tests.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.size(F.filter(labels, _is(k))).alias("n")) for k in keys])).alias("x"))
    return rows.groupBy("x.label").agg(F.count_if(F.col("x.n") > 0).alias("tests"), *summary(F.col("x.n")))


def co_occurring(tests: DataFrame, before: str, after: str, media: Sequence[str] = ("db", "mq", "fs")) -> DataFrame:
    """ST2-47: tests that seed a medium and observe it."""
    rows = tests.select(F.explode(F.array(*[F.struct(F.lit(m).alias("medium"), F.exists(before, _starts(m)).alias("pre"), F.exists(after, _starts(m)).alias("post")) for m in media])).alias("x"))
    return rows.groupBy("x.medium").agg(F.count_if("x.pre").alias("pre"), F.count_if("x.post").alias("post"), F.count_if(F.col("x.pre") & F.col("x.post")).alias("both"))
