"""Statistics of resources by verb and by full-CRUD capability, and of what tests do per event, sequence and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.functions.urls import normalize_request_path, resource_key
from suitestat.operators.aggregates import CRUD, VERBS, canonical, combination_table, complete_shares, concentration, count_share, share, summary
from suitestat.operators.sequences import crud, verb


def resolved_combination(rsteps: DataFrame, value: Column, order: tuple[str, ...], *keys: str) -> DataFrame:
    """PRJ-20: per (test, resource) sequence, the mapped values in order, or null where a request's method does not map."""
    keys = keys or ("project_id", "test_id")
    whole = F.bool_and(value.isNotNull())
    return rsteps.groupBy(*keys, "resource_key").agg(F.when(whole, canonical(F.collect_set(value), order)).alias("combination"))


def distinct_resources(rsteps: DataFrame, *keys: str) -> DataFrame:
    """PRJ-25: per test, distinct resources of all phases and of the test phase, and both among requests with a known verb."""
    keys = keys or ("project_id", "test_id")
    known, test = verb("http_method").isNotNull(), F.col("phase") == "test"
    count = lambda on: F.count_distinct(F.when(on, F.col("resource_key")))
    return rsteps.groupBy(*keys).agg(F.count_distinct("resource_key").alias("resources"), count(test).alias("test_resources"), count(known).alias("resolved_resources"), count(known & test).alias("resolved_test_resources"))


def verb_availability(endpoints: DataFrame) -> DataFrame:
    """Per project and resource, the verbs and the CRUD classes that its endpoints offer; wildcard verbs offer none."""
    e = endpoints.withColumn("resource_key", resource_key(normalize_request_path(F.col("path_template")))).filter("resource_key is not null")
    own = lambda x: F.when(~F.col("is_method_wildcard"), x)
    return e.groupBy("project_id", "resource_key").agg(canonical(F.collect_set(own(verb("http_method"))), VERBS).alias("available_verbs"), canonical(F.collect_set(own(crud("http_method"))), CRUD).alias("available"))


def exercising_verbs(rseqs: DataFrame, resources: DataFrame) -> DataFrame:
    """PRJ-30: the verbs of each (test, resource) sequence that refers to a production resource; a sequence counts once."""
    return rseqs.select("project_id", "test_id", "resource_key", "verbs").distinct().join(resources.select("project_id", "resource_key").distinct(), ["project_id", "resource_key"])


def verb_exercise(rseqs: DataFrame, available: DataFrame) -> DataFrame:
    """Per production resource, verbs exercised and missing, and whether one sequence uses all that it offers."""
    per = exercising_verbs(rseqs, available).join(available, ["project_id", "resource_key"])
    per = per.groupBy("project_id", "resource_key").agg(F.array_distinct(F.flatten(F.collect_set("verbs"))).alias("_seen"), F.bool_or(F.size(F.array_except("available_verbs", "verbs")) == 0).alias("_whole"), F.count(F.lit(1)).alias("sequences"))
    out = available.join(per, ["project_id", "resource_key"], "left")
    out = out.withColumn("exercised_verbs", F.array_intersect("available_verbs", F.coalesce("_seen", F.array().cast("array<string>"))))
    return out.withColumn("missing_verbs", F.array_except("available_verbs", "exercised_verbs")).withColumn("traversed", F.coalesce("_whole", F.lit(False))).withColumn("sequences", F.coalesce("sequences", F.lit(0)).cast("long")).drop("_seen", "_whole")


def _exercise(group: Column) -> list[Column]:
    """Resources of a group, those tested, those with every verb tested, and two rates."""
    tested = group & (F.size("exercised_verbs") > 0)
    fully = tested & (F.size("missing_verbs") == 0)
    return [F.count_if(group).alias("resources"), F.count_if(tested).alias("tested"), F.count_if(fully).alias("fully")]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn("tested_share", count_share("tested", "resources")).withColumn("fully_share_of_tested", count_share("fully", "tested"))


def verb_fully_exercised(resources: DataFrame) -> DataFrame:
    """ST2-41: resources that offer a verb: how many are tested, and how many have every verb tested."""
    return _rates(resources.agg(*_exercise(F.size("available_verbs") > 0)))


def verb_exercise_by_breadth(resources: DataFrame) -> DataFrame:
    """ST2-42: the same for resources of one verb and of several."""
    some = resources.filter(F.size("available_verbs") > 0)
    return _rates(some.groupBy((F.size("available_verbs") > 1).alias("multi")).agg(*_exercise(F.lit(True))))


def verb_exercise_when_capable(resources: DataFrame) -> DataFrame:
    """ST2-44: the same for resources that offer all four CRUD classes."""
    return _rates(resources.agg(*_exercise(F.size("available") == len(CRUD))))


def verb_availability_profile(resources: DataFrame) -> DataFrame:
    """ST2-40: resources by the verbs that they offer: every single verb (0 where none does), and combinations as observed; shares of the resources with a verb."""
    some = resources.filter(F.size("available_verbs") > 0).withColumn("profile", F.array_join("available_verbs", "-"))
    counts = some.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    single = complete_shares(counts, "profile", VERBS, F.lit(0)).select("profile", "n")
    every = single.unionByName(counts.filter(~F.col("profile").isin(*VERBS)))
    return every.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("proportion", count_share("n", "total"))  # a row for each combination of verbs


def single_sequence_traversal(resources: DataFrame) -> DataFrame:
    """ST2-43: of the resources of several verbs with a sequence, those of which one sequence uses every verb."""
    own = (F.size("available_verbs") > 1) & (F.col("sequences") > 0)
    out = resources.agg(F.count_if(own).alias("resources"), F.count_if(own & F.col("traversed")).alias("traversed"))
    return out.withColumn("proportion", count_share("traversed", "resources"))


def combinations_when_capable(coverage: DataFrame) -> DataFrame:
    """ST2-36: what tests exercise of the resources that offer all four CRUD classes: every combination, with shares of all of those, tested or not."""
    able = coverage.filter(F.size("available") == len(CRUD))
    total = able.agg(F.count(F.lit(1)).alias("capable"), F.count_if(F.size("exercised") == 0).alias("none_exercised"))
    return combination_table(able, "exercised").select("combination", "n").crossJoin(total).withColumn("proportion", count_share("n", "capable"))  # one row


def resources_per_test(tests: DataFrame, rseqs: DataFrame) -> DataFrame:
    """ST2-31: distinct resources of each test, tests without one included, and the share with several."""
    per = rseqs.groupBy("test_id").agg(F.count_distinct("resource_key").alias("n"))
    n = tests.select("test_id").distinct().join(per, "test_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    multi = F.col("n") > 1
    return n.agg(*summary("n"), *share(multi, "multi", "tests", "multi_share"))


def asserted_codes(codes: DataFrame) -> DataFrame:
    """ST2-11: checks and endpoints by asserted code, over all checks and all asserted endpoints; codes: project_id, endpoint_id, status_code, checks."""
    out = codes.groupBy("status_code").agg(F.sum("checks").alias("checks"), F.count_distinct(F.when(F.col("checks") > 0, F.struct("project_id", "endpoint_id"))).alias("endpoints"))
    total = codes.agg(F.count_distinct("project_id", "endpoint_id").alias("asserted"))
    out = out.withColumn("check_share", count_share("checks", F.sum("checks").over(Window.partitionBy())))  # a row for each code
    return out.crossJoin(total).withColumn("endpoint_share", count_share("endpoints", "asserted"))  # one row


def code_checks(segmented: DataFrame) -> DataFrame:
    """Status checks of each sequence by exact code, for crediting to endpoints as ranges are."""
    own = segmented.filter("kind = 'response-check' and assertion_role = 'status' and status_code is not null")
    return own.groupBy("project_id", "test_id", "seq", "status_code").agg(F.count(F.lit(1)).alias("n"))


def fan_summaries(fans: DataFrame) -> DataFrame:
    """ST1-27: summaries of builds before and checks after each dispatch."""
    return fans.unpivot([], ["fan_in", "fan_out"], "metric", "value").groupBy("metric").agg(*summary("value"))


def verification_concentration(sequences: DataFrame, checks: str = "checks") -> DataFrame:
    """ST1-28: the share of all checks that the top percents of sequences hold, and the shares of sequences with none, at most one, more than five and more than ten."""
    c = F.col(checks)
    at = sequences.agg(*[F.avg(x.cast("double")).alias(n) for n, x in (("zero_share", c == 0), ("at_most_one_share", c <= 1), ("above_five_share", c > 5), ("above_ten_share", c > 10))])
    return concentration(sequences, checks).crossJoin(at)  # one row


def exception_assertions(steps: DataFrame) -> DataFrame:
    """ST1-09: tests with an assertion that something is thrown."""
    return steps.groupBy("test_id").agg(F.bool_or(F.coalesce(F.col("assertion_role") == "exception", F.lit(False))).alias("has")).agg(*share("has"))


def extraction_usage(tests: DataFrame) -> DataFrame:
    """ST2-15: of tests (extractions, requests), the share that extracts from responses, a summary, and the share among tests of several requests."""
    some, multi = F.col("extractions") > 0, F.col("requests") >= 2
    several = [F.count_if(multi).alias("multi_tests"), F.count_if(multi & some).alias("multi_extracting"), F.try_divide(F.count_if(multi & some).cast("double"), F.count_if(multi)).alias("multi_share")]
    return tests.agg(*share(some, "extracting", "tests", "extracting_share"), *several, *summary("extractions"))


def names_per_event(events: DataFrame) -> DataFrame:
    """ST2-17: summaries of the query and header names of each request event."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    return events.select(size("query_names").alias("query_names"), size("header_names").alias("header_names")).unpivot([], ["query_names", "header_names"], "metric", "value").groupBy("metric").agg(*summary("value"))


def api_test_universe(projects: DataFrame, *metrics: str) -> DataFrame:
    """ST2-50: of the projects with API tests, a summary and the total of each count."""
    members = projects.filter("api_tests > 0")
    return members.unpivot([], list(metrics), "metric", "value").groupBy("metric").agg(*summary("value"), F.sum("value").alias("total"))
