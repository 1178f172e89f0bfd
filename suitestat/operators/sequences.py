"""Sequences: segmentation of a test's steps, fingerprints, resources, CRUD life cycles and per-test labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.functions.urls import normalize_request_path, resource_key
from suitestat.operators.aggregates import CRUD, VERBS, canonical

#: CRUD class of a verb.
CRUD_OF = {"POST": "create", "GET": "read", "HEAD": "read", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE", "CONNECT")


def crud(method: str | Column) -> Column:
    """SEQ-08: create, read, update, delete or null."""
    m = F.upper(F.col(method) if isinstance(method, str) else method)
    out = F.when(m == "POST", "create")
    for verb, op in list(CRUD_OF.items())[1:]:
        out = out.when(m == verb, op)
    return out


def verb(method: str | Column) -> Column:
    """PRJ-04: the verb in upper case if it maps to a CRUD class, else null."""
    m = F.upper(F.col(method) if isinstance(method, str) else method)
    return F.when(m.isin(*VERBS), m)


def canonical_method(method: str | Column) -> Column:
    """PRJ-03: a known method in upper case, else UNKNOWN."""
    m = F.upper(F.col(method) if isinstance(method, str) else method)
    return F.coalesce(F.when(m.isin(*METHODS), m), F.lit("UNKNOWN"))


def status_range(code: str | Column, given: Column | None = None) -> Column:
    """PRJ-18: a range that is given, else that of the code, else unknown."""
    c = F.col(code) if isinstance(code, str) else code
    of = F.when(c.between(100, 599), F.concat(F.floor(c / 100).cast("string"), F.lit("xx")))
    return F.coalesce(given, of, F.lit("unknown")) if given is not None else F.coalesce(of, F.lit("unknown"))


def origin(kind: str | Column) -> Column:
    """PRJ-01: test-method, test-helper or fixture."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isin("fixture", "fixture-helper"), "fixture").otherwise(k)


def segment(steps: DataFrame, test: str = "test_id", pos: str = "pos") -> DataFrame:
    """SEQ-02: the steps that belong to a sequence, with seq (from 1 in each test).

    A build or a request after a request opens a new island; a check stays only if
    its island has had its request; islands without a request go.  All windows share
    one partitioning by test, so the steps shuffle once.
    """
    w = Window.partitionBy(test).orderBy(pos)
    opener = F.when(F.col("kind") != "response-check", F.col("kind"))
    before = F.last(opener, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = steps.withColumn("_opens", F.when(opener.isNotNull() & (before == "http-request"), 1).otherwise(0))
    s = s.withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(test, "_island")
    is_request = F.when(F.col("kind") == "http-request", 1)
    s = s.withColumn("_asked", F.count(is_request).over(island.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_requests", F.count(is_request).over(island))
    s = s.filter((F.col("_requests") > 0) & ((F.col("kind") != "response-check") | (F.col("_asked") > 0)))
    return s.withColumn("seq", F.dense_rank().over(Window.partitionBy(test).orderBy("_island")).cast("long")).drop("_opens", "_island", "_asked", "_requests")


def step_fingerprint() -> Column:
    """SEQ-03: kind:VERB:path for builds and requests, kind:role for checks; * where unknown."""
    path = F.coalesce(normalize_request_path(F.col("http_path")), F.lit("*"))
    asked = F.concat_ws(":", "kind", F.upper(F.coalesce("http_method", F.lit("*"))), path)
    return F.when(F.col("kind") == "response-check", F.concat_ws(":", "kind", F.coalesce("assertion_role", F.lit("*")))).otherwise(asked)


def sequences(segmented: DataFrame, *keys: str) -> DataFrame:
    """One row for each sequence: length, counts by kind and by checked role, CRUD classes, verbs, fingerprint."""
    keys = keys or ("project_id", "test_id")
    kind, role = F.col("kind"), F.col("assertion_role")
    asked = F.when(kind == "http-request", F.col("http_method"))
    checks = lambda r: F.count_if((kind == "response-check") & (role == r))
    s = segmented.withColumn("_fp", step_fingerprint())
    return s.groupBy(*keys, "seq").agg(
        F.count(F.lit(1)).alias("length"),
        *[F.count_if(kind == k).alias(n) for k, n in (("request-build", "builds"), ("http-request", "requests"), ("response-check", "checks"))],
        *[checks(r).alias(f"{r}_checks") for r in ("status", "body", "header")],
        canonical(F.collect_set(crud(asked)), CRUD).alias("operations"),
        canonical(F.collect_set(verb(asked)), VERBS).alias("verbs"),
        F.bool_and(F.when(kind == "http-request", (canonical_method("http_method") != "UNKNOWN") & normalize_request_path(F.col("http_path")).isNotNull())).alias("resolved"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_fp"))), lambda x: x["_fp"]), "|").alias("fingerprint"),
    )


def sequence_summary(segmented: DataFrame, seqs: DataFrame, *keys: str) -> DataFrame:
    """SEQ-04 with PRJ-22..24: per test, counts of steps and of distinct verbs, resources, endpoints and fingerprints."""
    keys = keys or ("project_id", "test_id")
    asked = segmented.filter("kind = 'http-request'")
    path = normalize_request_path(F.col("http_path"))
    method = F.when(F.coalesce(F.col("http_method"), F.lit("")) != "", F.upper("http_method"))
    a = asked.withColumn("_p", path).withColumn("_m", method)
    per = a.groupBy(*keys).agg(
        F.count_distinct("_m").alias("methods"),
        F.count_distinct(resource_key(F.col("_p"))).alias("resources"),
        F.count_distinct(F.when(F.col("_m").isNotNull() & F.col("_p").isNotNull(), F.concat_ws(" ", "_m", "_p"))).alias("endpoints"),
        F.count(F.when(F.col("_m").isNotNull() & F.col("_p").isNotNull(), 1)).alias("resolved_requests"),
        F.count(F.lit(1)).alias("requests"),
    )
    fps = seqs.groupBy(*keys, "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("steps"))
    prints = fps.groupBy(*keys).agg(F.sum("n").alias("sequences"), F.count(F.lit(1)).alias("fingerprints"), F.count_if(F.col("n") > 1).alias("repeated_fingerprints"), F.sum("steps").alias("steps"))
    out = prints.join(per, list(keys))
    return out.withColumn("has_repeated", F.col("repeated_fingerprints") > 0).withColumn("re_dispatches", F.col("resolved_requests") > F.col("endpoints")).withColumn("all_resolved", F.col("resolved_requests") == F.col("requests"))


def shared_fingerprints(seqs: DataFrame) -> DataFrame:
    """PRJ-24: per test, whether one of its sequences is in another test of its project too."""
    pairs = seqs.select("project_id", "test_id", "fingerprint").distinct()
    twice = pairs.groupBy("project_id", "fingerprint").agg(F.count(F.lit(1)).alias("tests"))
    return pairs.join(twice, ["project_id", "fingerprint"]).groupBy("project_id", "test_id").agg(F.bool_or(F.col("tests") > 1).alias("shares_sequence"))


def fan(segmented: DataFrame, *keys: str) -> DataFrame:
    """PRJ-15: for each request, the builds before it and the checks after it in its sequence."""
    keys = keys or ("project_id", "test_id")
    w = Window.partitionBy(*keys, "seq").orderBy("pos")
    before = F.count(F.when(F.col("kind") == "request-build", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.count(F.when(F.col("kind") == "response-check", 1)).over(w.rowsBetween(1, Window.unboundedFollowing))
    return segmented.withColumn("fan_in", before).withColumn("fan_out", after).filter("kind = 'http-request'").select(*keys, "seq", "pos", "fan_in", "fan_out")


# ---- resources


def resource_steps(steps: DataFrame) -> DataFrame:
    """SEQ-07: requests with a usable path, by resource key."""
    path = normalize_request_path(F.col("http_path"))
    return steps.filter("kind = 'http-request'").withColumn("normalized_path", path).filter("normalized_path is not null").withColumn("resource_key", resource_key(F.col("normalized_path"))).withColumn("operation", crud("http_method"))


def ordered(first: str, second: str) -> Column:
    """SEQ-10: in the operation string, first before second (letters c, r, u, d)."""
    return F.col("ops").rlike(f"{first}.*{second}")


def lifecycle(available: Column | None = None) -> Column:
    """SEQ-12: the label of an operation string ops (letters in order, unmapped verbs left out); available is an array of classes, null if unknown."""
    o, has = F.col("ops"), lambda *x: F.array_sort(F.array(*[F.lit(i) for i in x]))
    kinds = F.array_sort(F.array_distinct(F.filter(F.split(o, ""), lambda x: x != "")))
    full = F.lit(True) if available is None else F.coalesce(F.size(F.array_except(F.array(*[F.lit(c) for c in CRUD]), available)) == 0, F.lit(True))
    writes = F.lit(True) if available is None else F.coalesce(F.arrays_overlap(available, F.array(F.lit("create"), F.lit("update"), F.lit("delete"))), F.lit(True))
    return (
        F.when(o == "", "other")
        .when((kinds == has("c", "d", "r", "u")) & full, "full-crud")
        .when((kinds == has("r")) & writes, "read-only")
        .when(kinds == has("c"), "create-and-trust")
        .when((kinds == has("c", "r", "u")) & o.rlike("c.*u.*r"), "create-update-verify")
        .when((kinds == has("c", "d", "r")) & o.rlike("c.*r.*d"), "create-verify-cleanup")
        .when((kinds == has("c", "r")) & o.rlike("c.*r"), "create-verify")
        .when((kinds == has("d", "r")) & o.rlike("d.*r"), "delete-verify")
        .when(o.rlike("[cud]") & ~o.contains("r"), "write-only")
        .otherwise("other")
    )


LIFECYCLES = ("full-crud", "read-only", "create-and-trust", "create-verify", "create-update-verify", "create-verify-cleanup", "delete-verify", "write-only", "other")


def resource_sequences(rsteps: DataFrame, *keys: str) -> DataFrame:
    """SEQ-07/09/10/13: per test and resource, the operation string, flags and exercised classes."""
    keys = keys or ("project_id", "test_id")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("operation").isNotNull(), F.struct("pos", F.substring("operation", 1, 1).alias("o"))))), lambda x: x["o"]), "")
    out = rsteps.groupBy(*keys, "resource_key").agg(letters.alias("ops"), F.count(F.lit(1)).alias("steps"), canonical(F.collect_set("operation"), CRUD).alias("exercised"), canonical(F.collect_set(verb("http_method")), VERBS).alias("verbs"), F.bool_or(canonical_method("http_method") != "UNKNOWN").alias("method_resolved"))
    return out.withColumn("read_after_write", F.col("ops").rlike("[cud].*r")).withColumn("cleanup_delete", ordered("c", "d"))


def availability(endpoints: DataFrame) -> DataFrame:
    """SEQ-14: per project and resource, its endpoints and the classes they offer; wildcard verbs offer none."""
    e = endpoints.withColumn("resource_key", resource_key(normalize_request_path(F.col("path_template")))).filter("resource_key is not null")
    op = F.when(~F.col("is_method_wildcard"), crud("http_method"))
    return e.groupBy("project_id", "resource_key").agg(F.count(F.lit(1)).alias("endpoints"), canonical(F.collect_set(op), CRUD).alias("available"))


def resource_coverage(rseqs: DataFrame, available: DataFrame) -> DataFrame:
    """SEQ-16: per production resource, classes exercised by tests and missing, and its tests by kind."""
    seen = rseqs.groupBy("project_id", "resource_key").agg(
        canonical(F.flatten(F.collect_set("exercised")), CRUD).alias("exercised"),
        F.count_distinct("test_id").alias("tests"),
        F.count_distinct(F.when(F.size("exercised") == 4, F.col("test_id"))).alias("full_crud_tests"),
        F.count_distinct(F.when((F.size("exercised") == 1) & F.array_contains("exercised", "read"), F.col("test_id"))).alias("read_only_tests"),
    )
    none = F.array().cast("array<string>")
    out = available.join(seen, ["project_id", "resource_key"], "left")
    out = out.withColumn("exercised", F.array_intersect("available", F.coalesce("exercised", none))).withColumn("missing", F.array_except("available", "exercised"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("tests", "full_crud_tests", "read_only_tests")})


# ---- labels of a test


def failure_flags(steps: DataFrame, *keys: str) -> DataFrame:
    """SEQ-17..20: checks by role and by status range, and whether 4xx or 5xx is asserted."""
    keys = keys or ("project_id", "test_id")
    check = steps.filter("kind = 'response-check'").withColumn("range", status_range("status_code"))
    role, status = F.col("assertion_role"), F.col("assertion_role") == "status"
    return check.groupBy(*keys).agg(
        *[F.count_if(role == r).alias(f"{r}_checks") for r in ("status", "body", "header")],
        *[F.count_if(status & (F.col("range") == r)).alias(f"n_{r}") for r in ("1xx", "2xx", "3xx", "4xx", "5xx", "unknown")],
        F.coalesce(F.bool_or(status & (F.col("range") == "4xx")), F.lit(False)).alias("asserts_4xx"),
        F.coalesce(F.bool_or(status & (F.col("range") == "5xx")), F.lit(False)).alias("asserts_5xx"),
    )


def status_codes(steps: DataFrame, *keys: str) -> DataFrame:
    """SEQ-19: status checks by exact code."""
    return steps.filter("kind = 'response-check' and assertion_role = 'status' and status_code is not null").groupBy(*keys, "status_code").agg(F.count(F.lit(1)).alias("n"))


def interactions(steps: DataFrame) -> DataFrame:
    """SEQ-05/06: requests, builders and verifications as one ordered stream with a view name; unknown roles are no verification."""
    k = F.col("kind")
    view = F.when(k == "http-request", "request").when(k == "request-build", "builder").when(F.col("assertion_role").isin("status", "body", "header"), "verification")
    return steps.withColumn("view", view).filter("view is not null")
