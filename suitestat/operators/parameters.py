"""Parameter coverage: which declared parameters requests exercise, and how optional ones combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.operators.aggregates import count_share

SET_LIMIT = 256


def with_keys(params: DataFrame) -> DataFrame:
    """PAR-02: source:name in lower case."""
    return params.withColumn("key", F.concat_ws(":", "source", F.lower("name")))


def exercised(matched: DataFrame, params: DataFrame, merge_forms: bool = True) -> DataFrame:
    """PAR-01: (endpoint_id, test_id, request_id, key) for each declared parameter that a matched request uses.

    matched: endpoint_id, test_id, request_id, query_names, header_names, form_names
    (arrays), has_body.  Path parameters always count; an aggregate query counts if
    any name is there; with merge_forms, form names count for queries too.
    An endpoint's parameters are one array, which tasks hold by endpoint; requests stream
    past them unsorted, are made distinct as a row each, by one sort, and open into keys last.
    """
    low = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    m = matched.withColumns({"_q": F.array_union(low("query_names"), low("form_names")) if merge_forms else low("query_names"), "_h": low("header_names"), "_f": low("form_names")})
    p = with_keys(params)
    aggregate = F.col("is_aggregate") if "is_aggregate" in p.columns else F.lit(False)
    scorable = ~F.col("is_unscorable") if "is_unscorable" in p.columns else F.lit(True)
    declared = p.filter(scorable).groupBy("endpoint_id").agg(F.collect_set(F.struct("key", "source", F.lower("name").alias("name"), aggregate.alias("aggregate"))).alias("_p"))

    def use(x):
        return (
            F.when(x["source"] == "path", True)
            .when(x["source"] == "query", (x["aggregate"] & (F.size("_q") > 0)) | F.array_contains("_q", x["name"]))
            .when(x["source"] == "header", F.array_contains("_h", x["name"]))
            .when(x["source"] == "form", F.array_contains("_f", x["name"]))
            .when(x["source"] == "body", F.col("has_body"))
        )

    met = m.join(declared.hint("shuffle_hash"), "endpoint_id")
    request = ["endpoint_id", "test_id", "request_id"]
    used = met.select(*request, F.transform(F.filter("_p", use), lambda x: x["key"]).alias("_keys")).filter(F.size("_keys") > 0)
    w = Window.partitionBy(*request).orderBy("_keys")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    once = used.select(*request, F.collect_list("_keys").over(whole).alias("_all"), F.row_number().over(w).alias("_n")).filter("_n = 1")
    return once.select(*request, F.explode(F.array_distinct(F.flatten("_all"))).alias("key"))


def _optional(params: DataFrame) -> DataFrame:
    """(endpoint_id, _optional): the keys of the optional parameters of each endpoint that has some, sorted; tasks hold them by endpoint."""
    return with_keys(params).filter(~F.col("required")).groupBy("endpoint_id").agg(F.array_sort(F.collect_set("key")).alias("_optional")).hint("shuffle_hash")


def parameter_rates(params: DataFrame, used: DataFrame) -> DataFrame:
    """PAR-03/08/09: per endpoint, scorable and exercised parameters, the rate (null without any), and the status."""
    p = with_keys(params)
    scorable = ~F.col("is_unscorable") if "is_unscorable" in p.columns else F.lit(True)
    hit = used.select("endpoint_id", "key").distinct().withColumn("_u", F.lit(True))
    rows = p.join(hit, ["endpoint_id", "key"], "left").withColumn("_u", F.coalesce("_u", F.lit(False))).withColumn("_s", scorable)
    out = rows.groupBy("endpoint_id").agg(
        F.count_if("_s").alias("total"),
        F.count_if(F.col("_s") & F.col("_u")).alias("exercised"),
        F.count_if(F.col("_s") & F.col("required")).alias("required_total"),
        F.count_if(F.col("_s") & F.col("required") & F.col("_u")).alias("required_exercised"),
        F.count_if(F.col("_s") & ~F.col("required")).alias("optional_total"),
        F.count_if(F.col("_s") & ~F.col("required") & F.col("_u")).alias("optional_exercised"),
    )
    out = out.withColumns({"rate": count_share("exercised", "total"), "required_rate": count_share("required_exercised", "required_total"), "optional_rate": count_share("optional_exercised", "optional_total")})
    return out.withColumn("status", F.when(F.col("total") == 0, "unscorable").when(F.col("exercised") == F.col("total"), "fully").when(F.col("exercised") == 0, "unexercised").otherwise("partial"))


def rates_by_source(params: DataFrame, used: DataFrame) -> DataFrame:
    """Rates of each endpoint and source that it declares."""
    hit = used.select("endpoint_id", "key").distinct().withColumn("_u", F.lit(True))
    rows = with_keys(params).join(hit, ["endpoint_id", "key"], "left")
    return rows.groupBy("endpoint_id", "source").agg(F.count(F.lit(1)).alias("total"), F.count("_u").alias("exercised")).withColumn("rate", count_share("exercised", "total"))


def optional_sets(requests: DataFrame, used: DataFrame, params: DataFrame) -> DataFrame:
    """PAR-04: distinct sets of present optional parameters of each endpoint, with tests, rank and whether the set is within the report's limit.

    requests: endpoint_id, test_id, request_id (a request without optional parameters is the empty set).
    """
    request = ["endpoint_id", "test_id", "request_id"]
    present = used.join(_optional(params), "endpoint_id").filter(F.array_contains("_optional", F.col("key"))).select(*request, "key", F.lit(False).alias("_asked"))
    # A request is a row without a key, so its keys and the request itself meet by one grouping.
    asked = requests.select(*request, F.lit(None).cast("string").alias("key"), F.lit(True).alias("_asked"))
    rows = asked.unionByName(present).groupBy(*request).agg(F.array_sort(F.collect_set("key")).alias("present"), F.bool_or("_asked").alias("_asked")).filter("_asked")
    sets = rows.groupBy("endpoint_id", "present").agg(F.count_distinct("test_id").alias("tests"))
    w = Window.partitionBy("endpoint_id").orderBy(F.desc("tests"), "present")
    return sets.withColumn("rank", F.row_number().over(w)).withColumn("listed", F.col("rank") <= SET_LIMIT)


def _states(*states: Column) -> Column:
    """How many of the states a group has rows of."""
    return sum((F.bool_or(s).cast("long") for s in states[1:]), F.bool_or(states[0]).cast("long"))


def project_sets(sets: DataFrame, source: str) -> DataFrame:
    """PAR-05: the sets cut to one source, distinct."""
    return sets.select("endpoint_id", F.filter("present", lambda x: x.startswith(source + ":")).alias("present")).distinct()


def one_way(sets: DataFrame, params: DataFrame) -> DataFrame:
    """PAR-06: per endpoint, optional parameters seen both present and absent."""
    met = sets.select("endpoint_id", "present").join(_optional(params), "endpoint_id").select("endpoint_id", "present", F.explode("_optional").alias("key"))
    has = F.array_contains("present", F.col("key"))
    seen = met.groupBy("endpoint_id", "key").agg(_states(has, ~has).alias("states"))
    return seen.groupBy("endpoint_id").agg(F.count_if(F.col("states") == 2).alias("covered"), F.count(F.lit(1)).alias("total"))


def two_way(sets: DataFrame, params: DataFrame) -> DataFrame:
    """PAR-07: per endpoint, pairs of optional parameters with all four states seen, states seen, and pairs."""
    pairs = F.flatten(F.transform("_optional", lambda a: F.transform(F.filter("_optional", lambda b: a < b), lambda b: F.struct(a.alias("key"), b.alias("other")))))
    met = sets.select("endpoint_id", "present").join(_optional(params), "endpoint_id").select("endpoint_id", "present", F.explode(pairs).alias("_p"))
    a, b = F.array_contains("present", F.col("_p.key")), F.array_contains("present", F.col("_p.other"))
    seen = met.groupBy("endpoint_id", F.col("_p.key").alias("key"), F.col("_p.other").alias("other")).agg(_states(a & b, a & ~b, ~a & b, ~a & ~b).alias("states"))
    return seen.groupBy("endpoint_id").agg(F.count_if(F.col("states") == 4).alias("covered_pairs"), F.sum("states").alias("states"), F.count(F.lit(1)).alias("pairs"))
