"""Statistics over endpoints, parameters, resources, tests and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.operators.aggregates import CRUD, count_share, domain, global_rank, summary, top_count

COVERAGE_VERBS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE", "WILDCARD")


def coverage_by_verb(coverage: DataFrame) -> DataFrame:
    """ST2-04: endpoints and covered endpoints by verb, wildcards apart, every verb listed."""
    v = F.when(F.col("is_method_wildcard") & (F.col("http_method") == "UNKNOWN"), "WILDCARD").otherwise(F.upper("http_method"))
    counts = coverage.groupBy(v.alias("verb")).agg(F.count(F.lit(1)).alias("endpoints"), F.count_if("is_covered").alias("covered"))
    out = domain(coverage.sparkSession, "verb", COVERAGE_VERBS).join(counts, "verb", "left").drop("rank")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("endpoints", "covered")})
    return out.withColumn("share", count_share("covered", "endpoints"))


def coverage_buckets(coverage: DataFrame, metric: str) -> DataFrame:
    """ST2-05: a surface metric by how many tests cover an endpoint: 0, 1-3, >3."""
    n = F.col("covering_tests")
    return coverage.groupBy(F.when(n == 0, "0").when(n <= 3, "1-3").otherwise(">3").alias("bucket")).agg(*summary(metric))


def coverage_payload(coverage: DataFrame) -> DataFrame:
    """ST2-06: endpoints, covered share, and tests per covered endpoint."""
    tests = F.when(F.col("is_covered"), F.col("covering_tests"))
    return coverage.agg(F.count(F.lit(1)).alias("endpoints"), F.try_divide(F.count_if("is_covered").cast("double"), F.count(F.lit(1))).alias("covered_share"), *summary(tests))


def surface_summaries(surface: DataFrame, *metrics: str) -> DataFrame:
    """ST2-01..03: a summary of each surface metric."""
    return surface.unpivot([], list(metrics), "metric", "value").groupBy("metric").agg(*summary("value"))


def outcome_mix(outcomes: DataFrame) -> DataFrame:
    """ST2-09: endpoints with asserted statuses by success only, error only, both or neither."""
    ok, bad = F.bool_or(F.col("range") == "2xx"), F.bool_or(F.col("range").isin("4xx", "5xx"))
    e = outcomes.groupBy("project_id", "endpoint_id").agg(ok.alias("ok"), bad.alias("bad"))
    label = F.when(F.expr("ok and bad"), "both").when(F.col("ok"), "success-only").when(F.col("bad"), "error-only").otherwise("neither")
    out = e.groupBy(label.alias("mix")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("proportion", count_share("n", F.sum("n").over(Window.partitionBy())))


def asserted_ranges(outcomes: DataFrame) -> DataFrame:
    """ST2-10: checks and endpoints by asserted range, over all checks and over all asserted endpoints."""
    out = outcomes.groupBy("range").agg(F.sum("checks").alias("checks"), F.count_distinct("project_id", "endpoint_id").alias("endpoints"))
    total = outcomes.agg(F.count_distinct("project_id", "endpoint_id").alias("asserted"))
    out = out.withColumn("check_share", count_share("checks", F.sum("checks").over(Window.partitionBy())))
    return out.crossJoin(total).withColumn("endpoint_share", count_share("endpoints", "asserted"))  # one row


def holistic_rates(rates: DataFrame, *columns: str) -> DataFrame:
    """ST2-22: a summary of each rate; endpoints without a denominator are not in it."""
    return rates.unpivot([], list(columns), "metric", "value").filter("value is not null").groupBy("metric").agg(*summary("value"))


def rates_by_source(by_source: DataFrame) -> DataFrame:
    """ST2-23/24: per source, a summary of the endpoints' rates and the pooled rate."""
    return by_source.groupBy("source").agg(*summary("rate"), F.try_divide(F.sum("exercised").cast("double"), F.sum("total")).alias("pooled_rate"))


def optional_extremes(rates: DataFrame) -> DataFrame:
    """ST2-25: endpoints whose optional parameters are all, or none of them, exercised."""
    r = F.col("optional_rate")
    return rates.filter(r.isNotNull()).agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(r == 1).alias("all_exercised"), F.count_if(r == 0).alias("none_exercised")).withColumns({"all_share": count_share("all_exercised", "endpoints"), "none_share": count_share("none_exercised", "endpoints")})


def lifecycle_labels(rseqs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """ST2-27: (test, resource) pairs by label, every label listed."""
    counts = rseqs.groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))
    out = domain(rseqs.sparkSession, "lifecycle", labels).join(counts, "lifecycle", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("lifecycle", "n", count_share("n", F.sum("n").over(Window.partitionBy())).alias("proportion"))


def lifecycle_per_test(rseqs: DataFrame) -> DataFrame:
    """ST2-28: tests with a resource, with several labels, with a read after a write, with a cleanup."""
    t = rseqs.groupBy("test_id").agg(F.count_distinct("lifecycle").alias("k"), F.bool_or("read_after_write").alias("raw"), F.bool_or("cleanup_delete").alias("clean"))
    return t.agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("k") > 1).alias("multi_label"), F.count_if("raw").alias("read_after_write"), F.count_if("clean").alias("cleanup_delete"))


def method_distribution(steps: DataFrame, value: Column, keys: tuple[str, ...]) -> DataFrame:
    """ST2-29/30: dispatched requests by verb or by CRUD class, every key listed; requests without one are left out."""
    counts = steps.filter("kind = 'http-request'").withColumn("key", value).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = domain(steps.sparkSession, "key", keys).join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("key", "n", count_share("n", F.sum("n").over(Window.partitionBy())).alias("proportion"))


def resource_exercise(resources: DataFrame) -> DataFrame:
    """ST2-32/34/35/38/39: resources of one and of several operations: tested, fully exercised, only ever read, with a full-CRUD test; mean completeness of tested ones."""
    a, m = F.size("available"), F.size("missing")
    writable = F.arrays_overlap("available", F.array(F.lit("create"), F.lit("update"), F.lit("delete")))
    only_read = (F.size("exercised") == 1) & F.array_contains("exercised", "read")
    done = F.when((F.col("tests") > 0) & (a > 0), (a - m).cast("double") / a)
    return resources.groupBy((a > 1).alias("multi")).agg(F.count(F.lit(1)).alias("resources"), F.count_if(F.col("tests") > 0).alias("tested"), F.count_if((a > 0) & (m == 0)).alias("fully"), F.count_if(F.col("full_crud_tests") > 0).alias("with_full_crud_test"), F.count_if(only_read & writable).alias("read_only_when_writable"), F.avg(done).alias("completeness"))


def per_operation(resources: DataFrame) -> DataFrame:
    """ST2-37: per operation, resources that offer it and resources that exercise it."""
    rows = resources.select(F.explode(F.array(*[F.struct(F.lit(o).alias("operation"), F.array_contains("available", o).alias("a"), F.array_contains("exercised", o).alias("e")) for o in CRUD])).alias("x"))
    out = rows.groupBy("x.operation").agg(F.count_if("x.a").alias("available"), F.count_if("x.e").alias("exercised"))
    return out.withColumn("rate", count_share("exercised", "available"))


def full_traversal(rseqs: DataFrame, available_verbs: DataFrame) -> DataFrame:
    """ST2-43: resources of which one sequence uses every verb that they offer."""
    j = rseqs.join(available_verbs, ["project_id", "resource_key"]).filter(F.size("available_verbs") > 0)
    r = j.groupBy("project_id", "resource_key").agg(F.bool_or(F.size(F.array_except("available_verbs", "verbs")) == 0).alias("whole"))
    return r.agg(F.count(F.lit(1)).alias("resources"), F.count_if("whole").alias("traversed"))


def test_scope(tests: DataFrame) -> DataFrame:
    """ST2-48: tests by requests, resources and endpoints: none, one, several at each level, with the share of the parent."""
    level = lambda c: F.when(F.col(c) == 0, "none").when(F.col(c) == 1, "single").otherwise("multi")
    rows = tests.select(level("requests").alias("requests"), level("resources").alias("resources"), level("endpoints").alias("endpoints"))
    out = rows.groupBy("requests", "resources", "endpoints").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share_of_parent", count_share("n", F.sum("n").over(Window.partitionBy("requests", "resources"))))


# ---- projects


def quadrants(projects: DataFrame) -> DataFrame:
    """ST2-49: projects by presence of endpoints and of API tests, all four cells."""
    e, t = F.col("endpoints") > 0, F.col("api_tests") > 0
    cell = lambda a, b: F.concat(F.when(a, "endpoints").otherwise("no-endpoints"), F.lit("/"), F.when(b, "tests").otherwise("no-tests"))
    counts = projects.groupBy(cell(e, t).alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))
    out = domain(projects.sparkSession, "quadrant", ("endpoints/tests", "endpoints/no-tests", "no-endpoints/tests", "no-endpoints/no-tests")).join(counts, "quadrant", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).select("quadrant", "n", count_share("n", F.sum("n").over(Window.partitionBy())).alias("proportion"))


def gated(frame: DataFrame, gate: DataFrame, key: str = "project_id") -> DataFrame:
    """ST2-51: rows of the projects that pass a gate."""
    return frame.join(gate.select(key).distinct(), key, "left_semi")


def complexity(tests: DataFrame) -> DataFrame:
    """ST2-54: per project, API tests, resolved tests, tests of several sequences, and total, greatest and mean sequences."""
    return tests.groupBy("project_id").agg(F.count(F.lit(1)).alias("api_tests"), F.count_if("all_resolved").alias("resolved_tests"), F.count_if(F.col("sequences") > 1).alias("multi_tests"), F.sum("sequences").alias("total_sequences"), F.max("sequences").alias("max_sequences"), F.avg("sequences").alias("mean_sequences"))


RANK_ORDER = ("api_tests", "multi_tests", "total_sequences")


def rank_projects(projects: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """ST2-55: projects with API tests that are not excluded, with their rank in a total order (counts descending, then the id)."""
    p = projects.filter("api_tests > 0")
    if excluded is not None:
        p = p.join(excluded, "project_id", "left_anti")
    return global_rank(p, *[F.desc(c) for c in RANK_ORDER], F.col("project_id"))


def select_sample(ranked: DataFrame, count: int | None = None, percent: float | None = None) -> DataFrame:
    """ST2-56/57: the first count, or the first percent (ceil, at least 1); exactly one of both is given."""
    if (count is None) == (percent is None):
        raise ValueError("give exactly one of count and percent")
    if count is not None:
        return ranked.filter(F.col("rank") <= count)
    whole = ranked.agg(top_count(F.max("rank"), percent).alias("_k"))
    return ranked.crossJoin(whole).filter(F.col("rank") <= F.col("_k")).drop("_k")  # one row


def random_sample(pool: DataFrame, count: int, seed: int, key: str = "project_id") -> DataFrame:
    """ST2-58: a reproducible draw, in rank order: the same seed gives the same rows."""
    return pool.orderBy(F.xxhash64(F.lit(seed), key), key).limit(count).orderBy("rank")


def sample_payload(selected: DataFrame, ranked: DataFrame, mode: str) -> DataFrame:
    """ST2-59: how many projects were ranked and selected, and the totals of the selected."""
    total = ranked.agg(F.count(F.lit(1)).alias("ranked_projects"))
    mine = selected.agg(F.count(F.lit(1)).alias("selected_projects"), F.sum("api_tests").alias("api_tests"), F.sum("total_sequences").alias("sequences"))
    return total.crossJoin(mine).withColumn("mode", F.lit(mode))  # one row each


def inventory(projects: DataFrame) -> DataFrame:
    """ST2-53: projects with API tests by their number, and a total row (null project)."""
    p = projects.filter("api_tests > 0")
    return p.rollup("project_id").agg(F.sum("api_tests").alias("api_tests"), F.count(F.lit(1)).alias("projects"))
