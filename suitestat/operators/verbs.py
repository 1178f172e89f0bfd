"""Verbs and names that a request gets from the calls that build it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitestat.operators.rules import string_literal

#: Frameworks whose builders serve each other's events.
COMPATIBLE = (("rest-template", "test-rest-template"),)


def frameworks_match(builder: Column, event: Column) -> Column:
    """CLS-19: the same framework, or two of a group; false where one is null."""
    out = builder == event
    for group in COMPATIBLE:
        out = out | (builder.isin(*group) & event.isin(*group))
    return F.coalesce(out, F.lit(False))


def verb_defaults(events: DataFrame, builders: DataFrame, *keys: str) -> DataFrame:
    """CLS-24: events with GET in place of UNKNOWN, where a request without a verb is a GET.

    okhttp: a chain that sets url on a Request.Builder, and neither calls method on it
    nor copies another request.  micronaut-client: exchange or retrieve with a string
    as first argument.  events: keys, framework, request_role, http_method,
    method_name, argument_types; builders: keys, method_name, receiver_type of the
    merged chain, any number an event (none leaves okhttp's verb unknown).
    """
    receiver = F.regexp_replace(F.regexp_replace(F.coalesce("receiver_type", F.lit("")), r"<.*$", ""), r"\$", ".")
    on_builder = receiver.rlike(r"(?:^|\.)Request\.Builder$")
    copies = (F.col("method_name") == "newBuilder") & receiver.rlike(r"(?:^|\.)Request$")
    chain = builders.groupBy(*keys).agg(F.bool_or(on_builder & (F.col("method_name") == "url")).alias("_url"), F.bool_or((on_builder & (F.col("method_name") == "method")) | copies).alias("_other"))
    open_ = F.col("http_method") == "UNKNOWN"
    okhttp = (F.col("framework") == "okhttp") & F.coalesce("_url", F.lit(False)) & ~F.coalesce("_other", F.lit(False))
    micronaut = (F.col("framework") == "micronaut-client") & (F.col("request_role") == "event") & F.lower("method_name").isin("exchange", "retrieve") & F.coalesce(F.get("argument_types", 0) == "java.lang.String", F.lit(False))
    out = events.join(chain, list(keys), "left").withColumn("http_method", F.when(open_ & (okhttp | micronaut), "GET").otherwise(F.col("http_method")))
    return out.drop("_url", "_other")


def form_names(framework: Column, method_name: Column, arguments: Column) -> Column:
    """CLS-12: names of form fields that a call sets by literals, each once: formParam, formParams (name, value, name, value), multiPart of rest-assured, file of mockmvc, form inserters in a body of the web clients."""
    m = F.lower(method_name)
    literal = lambda a: F.when(a.isNotNull(), string_literal(a))
    first = literal(F.get(arguments, 0))
    part = F.coalesce(first, F.nullif(F.regexp_extract(F.coalesce(F.get(arguments, 0), F.lit("")), r'^\s*new\s+[\w.]*MockMultipartFile\s*\(\s*"([^"\\]*)"', 1), F.lit("")))
    pairs = F.transform(F.filter(arguments, lambda a, i: i % 2 == 0), lambda a: string_literal(a))
    inserted = F.flatten(F.transform(arguments, lambda a: F.regexp_extract_all(a, F.lit(r'(?:fromFormData|fromMultipartData|with)\s*\(\s*"([^"\\]*)"'), 1)))
    one = (m == "formparam") | ((m == "multipart") & (framework == "rest-assured"))
    found = F.when(one, F.array(first)).when(m == "formparams", pairs).when((m == "file") & (framework == "mockmvc"), F.array(part)).when((m == "body") & framework.isin("webtestclient", "webclient"), F.when(F.exists(arguments, lambda a: a.contains("from")), inserted))
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda n: n.isNotNull() & (F.trim(n) != "")))
