"""Rule joins over call sites: longest-prefix matching, roles, arguments and builder chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from suitestat.functions.urls import is_relative_path, join_parts

LITERAL = r'^\s*"((?:[^"\\]|\\.)*)"\s*$'
VERBS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE")


def prefixes(name: Column) -> Column:
    """CLS-01: every prefix of a dotted name that ends at a . or $ boundary, itself included: the keys of a hash join."""
    parts = F.regexp_extract_all(name, F.lit(r"([.$]?[^.$]+)"), 1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))


def best_rule(calls: DataFrame, rules: DataFrame, name: str, *keys: str) -> DataFrame:
    """CLS-02/03, SYM-06: the rule of the longest prefix for each call, then exact before prefix rules, then by rule order.

    rules: rule_id, prefix and what they give; a call without a rule isn't returned.
    Prefixes of a name are few, so the join is an equi join on them.
    """
    rows = calls.select(*keys, F.col(name).alias("_name")).filter("_name is not null").distinct()
    hits = rows.withColumn("prefix", F.explode(prefixes(F.col("_name")))).join(rules, "prefix")
    give = [c for c in rules.columns if c != "prefix"]
    rank = F.struct(-F.length("prefix"), (F.col("prefix") != F.col("_name")).cast("int"), "rule_id")
    return hits.groupBy(*keys, F.col("_name").alias(name)).agg(F.min_by(F.struct("prefix", *give), rank).alias("_r")).select(*keys, name, "_r.*")


def string_literal(argument: Column) -> Column:
    """Text of an argument that is one string literal, else null."""
    return F.when(argument.rlike(LITERAL), F.regexp_replace(F.regexp_extract(argument, LITERAL, 1), r'\\(["\\])', "$1"))


def first_path(arguments: str | Column) -> Column:
    """CLS-08: the first argument that is a literal path."""
    a = F.col(arguments) if isinstance(arguments, str) else arguments
    return F.get(F.filter(F.transform(a, string_literal), lambda x: x.isNotNull() & (is_relative_path(x) | x.rlike(r"^https?://"))), 0)


def verb_argument(method_name: Column, arguments: Column) -> Column:
    """CLS-09: the verb that a method's name or one of its arguments names, else UNKNOWN."""
    named = F.when(F.upper(method_name).isin(*VERBS), F.upper(method_name))
    given = F.get(F.filter(F.transform(arguments, lambda x: F.upper(F.regexp_extract(x, r'(?:^|[."])(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS|TRACE)"?$', 1))), lambda x: x != ""), 0)
    return F.coalesce(named, given, F.lit("UNKNOWN"))


def chains(calls: DataFrame, *keys: str) -> DataFrame:
    """CLS-18/20: builders of a chain merged into its event: what the event lacks comes from the nearest builder before it, names add up.

    calls: keys, chain, pos, role (builder, event), http_method, path, names (array).
    """
    event = F.col("role") == "event"
    e = calls.filter(event).groupBy(*keys, "chain").agg(F.min("pos").alias("event_pos"))
    j = calls.join(e, [*keys, "chain"]).filter(F.col("pos") <= F.col("event_pos"))
    known = lambda c, unknown: F.max_by(F.when(F.col(c) != unknown, F.col(c)), F.when(F.col(c) != unknown, F.col("pos")))
    names = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "names"))), lambda x: x["names"])))
    return j.groupBy(*keys, "chain").agg(F.max("event_pos").alias("event_pos"), F.coalesce(known("http_method", "UNKNOWN"), F.lit("UNKNOWN")).alias("http_method"), known("path", "").alias("path"), names.alias("names"), F.count_if(F.col("role") == "builder").alias("builders"))


def queued(chains_: DataFrame, *keys: str) -> DataFrame:
    """CLS-20/40: a chain of builders without an event goes to the next event of its framework: (keys, framework, pos, event_pos), null if none follows.

    chains_: keys, framework, pos, is_event.
    """
    w = Window.partitionBy(*keys, "framework").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("is_event"), F.col("pos")), ignorenulls=True).over(w)
    return chains_.withColumn("event_pos", nxt).filter(~F.col("is_event"))


def appended_path(parts: Column) -> Column:
    """CLS-21: path of ordered parts (struct text, truncated); null if any but the last is cut."""
    cut = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x["truncated"])
    return F.when((F.size(parts) > 0) & ~cut, F.aggregate(parts, F.lit(""), lambda a, x: join_parts(a, x["text"])))


def status_argument(arguments: Column, names: DataFrame | None = None) -> Column:
    """CLS-28: the first argument that is an integer from 100 to 599."""
    n = F.transform(arguments, lambda x: F.regexp_extract(F.trim(x), r"^(\d{3})$", 1).try_cast("int"))
    return F.get(F.filter(n, lambda x: x.between(100, 599)), 0)


#: Method names of assertion libraries by what they check.
ASSERTION_ROLE = {"statusCode": "status", "status": "status", "isOk": "status", "isCreated": "status", "isNotFound": "status", "body": "body", "jsonPath": "body", "content": "body", "bodyAsString": "body", "header": "header", "headers": "header", "contentType": "header", "assertThrows": "exception", "assertEquals": "general", "assertTrue": "general", "assertThat": "general"}


def assertion_role(method_name: Column) -> Column:
    """CLS-27: the role of an assertion by its method's name, null for other methods."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in ASSERTION_ROLE.items() for x in kv]), method_name)


def import_evidence(annotations: DataFrame, imports: DataFrame, allowed: DataFrame) -> DataFrame:
    """SYM-03: annotations whose class imports them, by name or wildcard, from an allowed package; an explicit import from elsewhere vetoes.

    annotations: class_name, short_name; imports: class_name, path, is_wildcard; allowed: short_name, package.
    """
    a = annotations.join(F.broadcast(allowed), "short_name")  # a fixed list of annotations
    explicit = imports.filter("not is_wildcard").select("class_name", F.regexp_extract("path", r"([^.]+)$", 1).alias("short_name"), F.regexp_replace("path", r"\.[^.]+$", "").alias("_p"))
    wild = imports.filter("is_wildcard").select("class_name", F.regexp_replace("path", r"\.\*$", "").alias("package"))
    named = a.join(explicit, ["class_name", "short_name"], "left").withColumn("_hit", F.col("_p") == F.col("package"))
    by_name = named.filter("_hit").select("class_name", "short_name")
    by_star = named.filter("_p is null").select("class_name", "short_name", "package").join(wild, ["class_name", "package"], "left_semi").select("class_name", "short_name")
    return by_name.unionByName(by_star).distinct()
