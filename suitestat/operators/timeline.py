"""SYM-16/17/19, SEQ-01: the calls of a test in the order in which they run, helpers spliced in where they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitestat.operators.graph import evaluation_order

#: Assertion roles that check a response.
RESPONSE_CHECKS = ("status", "body", "header")


def timeline(calls: DataFrame, entries: DataFrame, max_depth: int = 1) -> DataFrame:
    """(root, phase, entry, path, depth, owner, call_id, ...): every call that a test runs, and its place.

    calls: owner (a method), call_id, start, stop, callee (the helper that it calls, null
    for others) and any other columns; entries: root (a test), entry (the order of its
    fixtures and its body), phase, method.  path sorts the calls of a root: the place of
    the entry, the place of the call in its method (receivers and arguments come before
    the call that uses them), and for a call of a helper the place of the call that runs
    it before its own.  So a call stands before what it runs, and one sort gives the whole
    order.  Helpers open to max_depth calls; a method that runs already isn't opened again.
    A null callee or a method without calls runs nothing; entries that repeat run again.
    A level is one join; calls are placed once.
    """
    if max_depth < 0:
        raise ValueError("max_depth is 0 or more")
    placed = evaluation_order(calls, "owner")
    now = entries.select("root", "phase", "entry", F.col("method").alias("owner"), F.array(F.col("entry").cast("long")).alias("_at"), F.array("method").alias("_running"))
    out = None
    for depth in range(max_depth + 1):
        step = now.join(placed, "owner").withColumn("path", F.concat("_at", F.array(F.col("place").cast("long")))).withColumn("depth", F.lit(depth))
        row = step.drop("_at", "_running", "place")
        out = row if out is None else out.unionByName(row)
        opens = step.filter(F.col("callee").isNotNull() & ~F.array_contains("_running", F.col("callee")))
        now = opens.select("root", "phase", "entry", F.col("callee").alias("owner"), F.col("path").alias("_at"), F.concat("_running", F.array("callee")).alias("_running"))
    return out


def call_steps(events: DataFrame) -> DataFrame:
    """SEQ-01: (root, order, kind, phase, owner, call_id, framework, http_method, http_path, assertion_role, status_code): the steps of each test.

    events: timeline() of classified calls: request_role, framework, http_method, http_path,
    assertion_role, counts (the assertion is a check), status_code.  A builder is a
    request-build, an event an http-request, a counted check of a response a
    response-check; other calls are no steps.  A verb that is UNKNOWN and an empty path are null.
    """
    checks = F.coalesce(F.col("counts") & F.col("assertion_role").isin(*RESPONSE_CHECKS), F.lit(False))
    kind = F.when(F.col("request_role") == "builder", "request-build").when(F.col("request_role") == "event", "http-request").when(checks, "response-check")
    steps = events.withColumn("kind", kind).filter("kind is not null")
    order = F.row_number().over(Window.partitionBy("root").orderBy("path", "owner", "call_id"))
    asks = F.col("kind") != "response-check"
    return steps.select(
        "root", order.alias("order"), "kind", "phase", "owner", "call_id", "framework",
        F.when(asks, F.nullif("http_method", F.lit("UNKNOWN"))).alias("http_method"), F.when(asks, F.nullif("http_path", F.lit(""))).alias("http_path"),
        F.when(~asks, F.col("assertion_role")).alias("assertion_role"), F.when(~asks, F.col("status_code")).alias("status_code"),
    )
