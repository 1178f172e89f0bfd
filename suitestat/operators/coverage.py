"""Endpoint coverage: observed requests matched to endpoint templates by tiers, and what follows from the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.functions.urls import normalize_path, observed_path, segments, strip_prefix

VARIABLE = r"^\{(\*?)([^{}:]+)(?::(.+))?\}$"
MIN_SUFFIX = 2
#: What a request is matched by, and the endpoints of a group that one part of it has, about.
REQUEST = ["project_id", "http_method", "http_path", "path_truncated"]
GROUP_PART = 1024


def eligible(endpoints: DataFrame) -> DataFrame:
    """COV-02: without endpoints whose verb is unknown and no wildcard."""
    return endpoints.filter((F.upper(F.coalesce("http_method", F.lit("UNKNOWN"))) != "UNKNOWN") | F.col("is_method_wildcard"))


def methods_match(production: Column, wildcard: Column, observed: Column) -> Column:
    """COV-01: equal verbs, or any known verb against a wildcard; UNKNOWN never matches."""
    p, o = F.upper(F.coalesce(production, F.lit("UNKNOWN"))), F.upper(F.coalesce(observed, F.lit("UNKNOWN")))
    return (o != "UNKNOWN") & F.when(p == "UNKNOWN", wildcard).otherwise(p == o)


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?+()\[\]{}*])", r"\\$1")


def _glob(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\*", -1), _escaped), "[^/]*")


def segment_pattern(segment: Column) -> Column:
    """COV-03: the pattern of one segment; ** for a segment that takes any number of them.

    A constraint is taken as written in Java source (two backslashes for one); variables
    within text match at least one character.
    """
    name, constraint = F.regexp_extract(segment, VARIABLE, 2), F.regexp_extract(segment, VARIABLE, 3)
    star = F.regexp_extract(segment, VARIABLE, 1) == "*"
    whole = segment.rlike(VARIABLE)
    java = lambda x: F.concat(F.lit("(?:"), F.replace(F.trim(x), F.lit("\\\\"), F.lit("\\")), F.lit(")"))
    del name
    # Text with variables: cut at the braces; every second piece is a variable.
    pieces = F.split(F.regexp_replace(segment, r"\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", "\u0001$1\u0001"), "\u0001", -1)
    variable = lambda x: F.when(x.contains(":"), java(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))).otherwise(F.lit("[^/]+"))
    mixed = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, variable(x)).otherwise(_glob(x))), "")
    return (
        F.when(segment == "**", "**")
        .when(whole & star & (constraint == ""), "**")
        .when(whole & star, _escaped(segment))
        .when(whole & (constraint != ""), java(constraint))
        .when(whole, "[^/]+")
        .when(segment.contains("{"), mixed)
        .when(segment.contains("**"), _escaped(segment))
        .otherwise(_glob(segment))
    )


def path_pieces(parts: Column) -> Column:
    """COV-04: of each segment, its piece of the pattern of a whole path: /a/b, where ** takes no segment or more."""
    return F.transform(F.transform(parts, segment_pattern), lambda q: F.when(q == "**", "(?:/[^/]+)*").otherwise(F.concat(F.lit("/"), q)))


def path_pattern(parts: Column) -> Column:
    """COV-04: the pattern of a whole path from its segments."""
    return F.concat(F.lit("^"), F.array_join(path_pieces(parts), ""), F.lit("$"))


WHOLE, CUT, SUFFIX = 1, 2, 3


def templates(endpoints: DataFrame) -> DataFrame:
    """The distinct templates of eligible endpoints: project_id, method, is_method_wildcard, path_template, route, and variants array<struct<kind, n, first, pattern>>.

    A variant is a pattern and what a path must have for it: n segments (-1: any
    number) and that first segment (*: any).  COV-05: the tail of a CUT path must be a
    variable without star and constraint.  COV-07: a SUFFIX drops only literal segments
    and starts with one.
    """
    e = eligible(endpoints).select("project_id", F.upper("http_method").alias("method"), "is_method_wildcard", "path_template").distinct()
    e = e.withColumn("_s", segments(normalize_path(F.col("path_template")))).withColumn("_q", path_pieces(F.col("_s")))
    literal = lambda s: ~s.contains("{") & ~s.contains("*")
    size, last = F.size("_s"), F.get("_s", F.size("_s") - 1)
    # A constraint may match several segments, as ** and {*rest} do.
    e = e.withColumn("_fixed", ~F.exists("_s", lambda s: s.contains("**") | s.contains("{*") | s.contains(":")))

    def variant(kind: int, drop: Column, keep: Column) -> Column:
        first = F.when(keep > 0, F.get(F.col("_s"), drop))
        pattern = F.concat(F.lit("^"), F.array_join(F.slice(F.col("_q"), drop + 1, keep), ""), F.lit("$"))
        return F.struct(F.lit(kind).alias("kind"), F.when(F.col("_fixed"), keep).otherwise(-1).alias("n"), F.when(literal(first), first).otherwise("*").alias("first"), pattern.alias("pattern"))

    plain = last.rlike(VARIABLE) & (F.regexp_extract(last, VARIABLE, 1) == "") & (F.regexp_extract(last, VARIABLE, 3) == "")
    # With the first lead segments literal, 1 .. lead - 1 of them can go and leave a literal first.
    lead = F.coalesce(F.nullif(F.array_position(F.transform("_s", literal), False), F.lit(0)) - 1, size).cast("int")
    drops = F.when(lead >= 2, F.sequence(F.lit(1), lead - 1)).otherwise(F.array().cast("array<int>"))
    whole, cut = F.array(variant(WHOLE, F.lit(0), size)), F.array(variant(CUT, F.lit(0), F.greatest(size - 1, F.lit(0))))
    none = F.slice(whole, 1, 0)
    e = e.withColumn("variants", F.concat(whole, F.when((size > 0) & plain, cut).otherwise(none), F.transform(drops, lambda d: variant(SUFFIX, d, size - d))))
    return e.withColumn("route", F.concat_ws(" ", "method", F.array_join("_s", "/"))).drop("_s", "_q", "_fixed")


def _hits(paths: DataFrame, variants: DataFrame) -> DataFrame:
    """paths (project_id, verb, _p, ...) with each variant whose pattern they match: equal project, verb, number of segments and first segment, or variants that leave those open."""
    whole = F.when(F.col("_p") == "/", "").otherwise(F.col("_p"))
    parts = F.split(F.col("_w"), "/")
    n, first = F.size(parts) - 1, F.get(parts, 1)
    key = lambda n, first: F.struct(n.alias("n"), first.alias("first"))
    keys = F.array(key(n, first), key(n, F.lit("*")), key(F.lit(-1), first), key(F.lit(-1), F.lit("*")))
    asked = paths.withColumn("_w", whole).withColumn("_k", F.explode(keys)).withColumns({"n": F.col("_k.n"), "first": F.col("_k.first")}).drop("_k")
    return asked.join(variants, ["project_id", "verb", "n", "first"]).filter(F.rlike(F.col("_w"), F.col("pattern")))


def endpoint_groups(endpoints: DataFrame) -> DataFrame:
    """(project_id, endpoint_id, group) of eligible endpoints: group is the sorted set of their templates, so endpoints that the same requests match share one."""
    e = eligible(endpoints).select("project_id", "endpoint_id", F.struct(F.upper("http_method").alias("method"), "is_method_wildcard", "path_template").alias("_t"))
    return e.groupBy("project_id", "endpoint_id").agg(F.array_sort(F.collect_set("_t")).alias("group"))


def match_groups(requests: DataFrame, endpoints: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """COV-04..08: (project_id, http_method, http_path, path_truncated, group, tier) for each distinct request that matches.

    Each distinct (project, verb, path, cut) is matched once (COV-08), against each
    distinct template once.  Tiers: 1 direct, 2 after an application prefix is stripped,
    3 by a unique suffix.  A request keeps the matches of its first tier only (COV-06).
    Paths meet templates on project, verb, number of segments and first segment, wildcard
    endpoints under each verb that is observed; the pattern is tested on what those keys
    leave.  What is counted for requests is counted for a group of endpoints
    (endpoint_groups) and handed to its endpoints last, so requests never meet endpoints in pairs.
    """
    cut = F.col("path_truncated") if "path_truncated" in requests.columns else F.lit(False)
    asked = requests.select("project_id", "http_method", "http_path", cut.alias("path_truncated")).filter("http_path is not null").distinct()
    seen = observed_path(F.col("http_path"))
    asked = asked.withColumn("_p", seen["path"]).filter(F.col("_p").isNotNull() & (seen["target"] != "external") & (F.upper(F.coalesce("http_method", F.lit("UNKNOWN"))) != "UNKNOWN"))
    asked = asked.withColumn("verb", F.upper("http_method"))
    own = ["project_id", "method", "is_method_wildcard", "path_template"]
    t = templates(endpoints)
    verbs = asked.groupBy("project_id").agg(F.collect_set("verb").alias("_verbs"))
    under = F.when(F.col("method") != "UNKNOWN", F.array("method")).when(F.col("is_method_wildcard"), F.col("_verbs"))
    v = t.join(verbs, "project_id").withColumn("verb", F.explode(under)).withColumn("x", F.explode("variants")).select(*own, "route", "verb", "x.*")
    able = (F.col("kind") == WHOLE) | ((F.col("kind") == CUT) & F.col("path_truncated")) | ((F.col("kind") == SUFFIX) & ~F.col("path_truncated") & (F.size(segments("_p")) >= MIN_SUFFIX))
    tier = F.when(F.col("kind") == SUFFIX, 3).otherwise(1)
    tiers = _hits(asked, v).filter(able).select(*REQUEST, *own[1:], "route", tier.alias("tier")).distinct()
    if prefixes is not None:
        rest = asked.join(prefixes.select("project_id", "prefix").distinct(), "project_id").withColumn("_p", strip_prefix(segments("_p"), segments(normalize_path(F.col("prefix"))))).filter("_p is not null")
        tiers = tiers.unionByName(_hits(rest, v.filter(F.col("kind") != SUFFIX)).filter(able).select(*REQUEST, *own[1:], "route", F.lit(2).alias("tier")).distinct())
    w = Window.partitionBy(*REQUEST)
    best = tiers.withColumn("_best", F.min("tier").over(w)).filter("tier = _best")
    # A suffix counts only if one route has it.
    one = F.min("route").over(w) == F.max("route").over(w)
    best = best.withColumn("_one", one).filter("tier < 3 or _one").select(*REQUEST, *own[1:], "tier")
    g = endpoint_groups(endpoints).select("project_id", "group").distinct().withColumn("_t", F.explode("group")).select("project_id", "group", "_t.*")
    return best.join(g, own).select(*REQUEST, "group", "tier").distinct()


def match(requests: DataFrame, endpoints: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """COV-04..08: match_groups() with a row for each endpoint: (project_id, http_method, http_path, path_truncated, endpoint_id, tier).

    A group of many endpoints meets its requests in parts, so no task holds a whole group.
    """
    members = endpoint_groups(endpoints)
    parts = members.groupBy("project_id", "group").agg(F.ceil(F.count(F.lit(1)) / GROUP_PART).cast("int").alias("_parts"))
    hits = match_groups(requests, endpoints, prefixes).join(parts, ["project_id", "group"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    members = members.join(parts, ["project_id", "group"]).withColumn("_part", F.pmod(F.hash("endpoint_id"), F.col("_parts"))).drop("_parts")
    return hits.join(members, ["project_id", "group", "_part"]).select(*REQUEST, "endpoint_id", "tier")


def _requests_with(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests with each group that they match."""
    cut = F.col("path_truncated") if "path_truncated" in requests.columns else F.lit(False)
    return requests.withColumn("path_truncated", cut).join(hits, REQUEST)


def endpoint_coverage(endpoints: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """COV-09: every eligible endpoint with its covering tests. hits: match_groups()."""
    cut = F.col("path_truncated") if "path_truncated" in requests.columns else F.lit(False)
    asked = requests.withColumn("path_truncated", cut).groupBy(*REQUEST, "test_id").agg(F.count(F.lit(1)).alias("_n"))
    tests = _requests_with(asked, hits).groupBy("project_id", "group", "test_id").agg(F.sum("_n").alias("_n"))
    tests = tests.groupBy("project_id", "group").agg(F.count("test_id").alias("covering_tests"), F.sum("_n").alias("requests"))
    per = endpoint_groups(endpoints).join(tests, ["project_id", "group"]).drop("group")
    out = eligible(endpoints).join(per, ["project_id", "endpoint_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("covering_tests", "requests")})
    return out.withColumn("is_covered", F.col("covering_tests") > 0)


def coverage_ratio(covered: Column, total: Column) -> Column:
    """COV-10: 0, not null, where there is nothing to cover."""
    return F.coalesce(F.try_divide(covered.cast("double"), total), F.lit(0.0))


def coverage_summary(coverage: DataFrame, *keys: str) -> DataFrame:
    """COV-17: per project, endpoints, covered endpoints and the rounded ratio."""
    covered, total = F.count_if("is_covered"), F.count(F.lit(1))
    out = [total.alias("endpoints"), covered.alias("covered"), F.round(coverage_ratio(covered, total), 4).alias("coverage_ratio")]
    return coverage.groupBy(*keys).agg(*out) if keys else coverage.agg(*out)


def credited(segmented: DataFrame, endpoints: DataFrame, hits: DataFrame, checks: DataFrame, by: str) -> DataFrame:
    """Checks (project_id, test_id, seq, by, n) of each sequence credited to every endpoint that its first request matches: (project_id, endpoint_id, by, checks). hits: match_groups()."""
    first = Window.partitionBy("project_id", "test_id", "seq").orderBy("pos")
    lead = segmented.filter("kind = 'http-request'").withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("project_id", "test_id", "seq", "http_method", "http_path")
    hit = _requests_with(lead, hits).select("project_id", "test_id", "seq", "group").distinct()
    per = hit.join(checks, ["project_id", "test_id", "seq"]).groupBy("project_id", "group", by).agg(F.sum("n").alias("checks"))
    return endpoint_groups(endpoints).join(per, ["project_id", "group"]).select("project_id", "endpoint_id", by, "checks")


def outcomes(segmented: DataFrame, endpoints: DataFrame, hits: DataFrame) -> DataFrame:
    """COV-11: status checks of each sequence credited to every endpoint that its first request matches: (project_id, endpoint_id, range, checks)."""
    from suitestat.operators.sequences import status_range

    checks = segmented.filter("kind = 'response-check' and assertion_role = 'status'").withColumn("range", status_range("status_code")).groupBy("project_id", "test_id", "seq", "range").agg(F.count(F.lit(1)).alias("n"))
    return credited(segmented, endpoints, hits, checks, "range")


def surface(endpoints: DataFrame, params: DataFrame) -> DataFrame:
    """COV-12: parameters of each endpoint by source, required and optional."""
    sources = ("path", "query", "header", "form", "body")
    per = params.groupBy("endpoint_id").agg(*[F.count_if(F.col("source") == s).alias(f"{s}_params") for s in sources], F.count_if("required").alias("required_params"), F.count_if(~F.col("required")).alias("optional_params"), F.count(F.lit(1)).alias("total_params"))
    out = endpoints.select("endpoint_id", F.size(segments(normalize_path(F.col("path_template")))).cast("long").alias("depth")).join(per, "endpoint_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in per.columns if c != "endpoint_id"})


def deduplicate(endpoints: DataFrame, order: str, *keys: str) -> DataFrame:
    """COV-13: the last row of each key by arrival."""
    every = [c for c in endpoints.columns if c not in keys]
    last = endpoints.groupBy(*keys).agg(F.max_by(F.struct(*every), order).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in every])


def handlers(endpoints: DataFrame) -> DataFrame:
    """COV-14: distinct (class, signature) of endpoints."""
    return endpoints.select("class_name", "method_signature").distinct()


def handler_calls(calls: DataFrame, endpoints: DataFrame, ancestors: DataFrame) -> DataFrame:
    """COV-15/16: per endpoint handler, the tests that call it directly, through the receiver's type or its nearest ancestor that has it.

    calls: test_id, receiver_type, callee_signature; ancestors: class_name, ancestor,
    depth (itself at 0).
    """
    h = handlers(endpoints)
    c = calls.join(h.select(F.col("method_signature").alias("callee_signature")).distinct(), "callee_signature", "left_semi")
    c = c.join(ancestors, c["receiver_type"] == ancestors["class_name"]).join(h.withColumnRenamed("class_name", "ancestor").withColumnRenamed("method_signature", "callee_signature"), ["ancestor", "callee_signature"])
    near = c.groupBy("test_id", "receiver_type", "callee_signature").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("owner"))
    return near.groupBy(F.col("owner").alias("class_name"), F.col("callee_signature").alias("method_signature")).agg(F.count_distinct("test_id").alias("tests"))


# ---- deploy prefixes and production keys


def has_lead_segment(requests: DataFrame, leads: list[str]) -> DataFrame:
    """PRJ-34: projects with a path whose first segment is one of the leads."""
    first = F.get(segments(normalize_path(F.col("http_path"))), 0)
    return requests.filter(first.isin(*leads)).select("project_id").distinct()


def coverage_with_prefixes(requests: DataFrame, endpoints: DataFrame, prefixes: DataFrame, more: DataFrame) -> DataFrame:
    """PRJ-35, ST2-07: covered endpoints per project with the discovered prefixes, and with extra deploy prefixes: (project_id, variant, endpoints, covered, coverage_ratio)."""
    out = None
    for variant, table in (("discovered", prefixes), ("with-deploy-prefixes", prefixes.unionByName(more))):
        cov = endpoint_coverage(endpoints, requests, match_groups(requests, endpoints, table))
        part = coverage_summary(cov, "project_id").withColumn("variant", F.lit(variant))
        out = part if out is None else out.unionByName(part)
    return out


def production_keys(resource_steps: DataFrame, matches: DataFrame, endpoints: DataFrame) -> DataFrame:
    """PRJ-36: resource steps with production_key: the resource of the endpoints that the request matches if they have one key, else the step's own; and whether it was resolved.

    matches: match(), or match_groups(), whose rows don't grow with the endpoints.
    """
    from suitestat.functions.urls import normalize_request_path, resource_key

    of = lambda template: resource_key(normalize_request_path(template))
    request = ["project_id", "http_method", "http_path"]
    if "group" in matches.columns:
        keyed = matches.select(*request, F.explode("group.path_template").alias("_t")).distinct().select(*request, of(F.col("_t")).alias("_k")).filter("_k is not null")
    else:
        keyed = matches.join(endpoints.select("project_id", "endpoint_id", of(F.col("path_template")).alias("_k")).filter("_k is not null"), ["project_id", "endpoint_id"])
    one = keyed.groupBy(*request).agg(F.count_distinct("_k").alias("_n"), F.min("_k").alias("_k")).filter("_n = 1").drop("_n")
    out = resource_steps.join(one, request, "left")
    return out.withColumn("production_key", F.coalesce("_k", "resource_key")).withColumn("resolved", F.col("_k").isNotNull()).drop("_k")


def grouping_comparison(resource_steps_: DataFrame) -> DataFrame:
    """ST2-08: sequences under the observed and under the production grouping: how many read after they write, and how many clean up."""
    from suitestat.operators.sequences import resource_sequences

    out = None
    for name, column in (("observed", "resource_key"), ("production", "production_key")):
        s = resource_sequences(resource_steps_.withColumn("resource_key", F.col(column)))
        part = s.agg(F.count(F.lit(1)).alias("sequences"), F.count_if("read_after_write").alias("read_after_write"), F.count_if("cleanup_delete").alias("cleanup_delete")).withColumn("grouping", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
