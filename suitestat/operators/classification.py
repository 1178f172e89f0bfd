"""Call sites of HTTP clients and tests, classified in passes over a method's calls.

Each pass reads what the passes before it settled:

1. the owner family of a call, from its receiver's type and its method (families);
2. nesting of spans (spans), and calls that a mocking library wraps: they lose their role;
3. calls without a known receiver, along each receiver chain: builders before them in the
   chain, or in their arguments, show the framework, if they show one only;
4. what the arguments say: verb, path, names of headers, queries, path variables and form
   fields, a body, credentials;
5. names that a container variable got before it was passed on.

What builders give to events is in correlation.py.  Calls: keys (a method), call_id,
start, stop (numbers: line * 10000 + column), line, method_name, receiver_type,
receiver_expr, args, arg_types (arrays), values (array: constants that arguments resolve
to, null where unknown), is_constructor, callee_signature.  Nulls in text columns count
as empty, null arrays as arrays of none; rows that repeat a call_id within a method count as one.
Calls whose key is null are classified each by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from suitestat.functions.lineage import cut, written
from suitestat.functions.urls import is_local_host, is_relative_path, query_names, template_variables, url_part
from suitestat.operators import families as K
from suitestat.operators.rules import string_literal
from suitestat.operators.spans import nest

QUOTED = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
VERB = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE|CONNECT"
NAME = r"[A-Za-z_$][\w$]*"

# Which argument holds a path, and which a verb, by family and method.
PATH_AT: dict[str, dict[int, str]] = {
    "rest-assured.request_factory": {0: "get post put delete patch head options", 1: "request"},
    "rest-assured.request_event": {0: "get post put delete patch head options", 1: "request"},
    "rest-assured.request_builder": {0: "baseuri basepath"},
    "test-rest-template.request": {0: "getforentity getforobject headforheaders postforlocation postforentity postforobject put delete patchforobject optionsforallow exchange execute"},
    "rest-template.request": {0: "getforentity getforobject headforheaders postforlocation postforentity postforobject put delete patchforobject optionsforallow exchange execute get post patch head options", 1: "method"},
    "mockmvc.request_factory": {0: "get post put delete patch head options multipart", 1: "multipart request"},
    "webtestclient.request_builder": {0: "uri"},
    "webclient.request": {0: "uri"},
    "rest-client.request": {0: "uri"},
    "java-httpclient.request": {0: "newbuilder uri"},
    "micronaut-client.request": {0: "get post put patch delete head options uri exchange retrieve datastream exchangestream jsonstream", 1: "create"},
    "okhttp.request": {0: "url"},
    "karate.request": {0: "to url path"},
    "pact.request": {0: "path"},
    "citrus.request": {0: "get post put delete patch head options trace path uri"},
    "feign.request": {0: "uri target append", 1: "insert"},
    "apache-httpclient.request": {0: "get post put delete patch head options trace setpath seturi"},
    "jaxrs-client.request": {0: "target path"},
}
VERB_AT: dict[str, dict[int, str]] = {
    "rest-assured.request_factory": {0: "request"},
    "rest-assured.request_event": {0: "request"},
    "test-rest-template.request": {1: "exchange execute"},
    "rest-template.request": {0: "method", 1: "exchange execute"},
    "mockmvc.request_factory": {0: "multipart request"},
    "webtestclient.request_builder": {0: "method"},
    "webclient.request": {0: "method"},
    "rest-client.request": {0: "method"},
    "java-httpclient.request": {0: "method"},
    "micronaut-client.request": {0: "create"},
    "okhttp.request": {0: "method"},
    "karate.request": {0: "method methodjson"},
    "pact.request": {0: "method"},
    "citrus.request": {0: "method"},
    "feign.request": {0: "method"},
    "apache-httpclient.request": {0: "create setmethod"},
    "jaxrs-client.request": {0: "method"},
}
#: Methods that take one path segment without a slash, and methods whose path goes on the one before.
SEGMENT = (("rest-assured.request_builder", "basepath"), ("jaxrs-client.request", "path"), ("karate.request", "path"), ("citrus.request", "path"))
APPENDING = (("jaxrs-client.request", "path"), ("karate.request", "path"))
#: Methods whose literals are no paths, those whose literals may look like media types and still be paths, and top-level media types.
NO_PATH = "header headers addheader setheader contenttype accept acceptcharset cookie cookies".split()
ANY_PATH = "connect delete enqueue exchange exchangetoflux exchangetomono execute get getforentity getforobject head headforheaders method options optionsforallow patch patchforobject path perform post postforentity postforlocation postforobject put request retrieve send sendasync trace uri url".split()
MEDIA = r"^(?:application|audio|example|font|image|message|model|multipart|text|video|\*)/[^/]+$"
#: Words that show credentials, methods that are a header, and setters of a header container.
CREDENTIALS = ("Authorization", "Basic", "Bearer", "X-API-Key")
HEADER_OF = {"accept": "accept", "acceptcharset": "accept-charset", "contentlength": "content-length", "contenttype": "content-type"}
SETTERS = "accept accept-charset accept-language cache-control content-disposition content-length content-type etag expires host if-match if-modified-since if-none-match if-unmodified-since last-modified location origin range".split()
SETTER_OF = {"set" + h.replace("-", ""): h for h in SETTERS} | {"setbasicauth": "authorization", "setbearerauth": "authorization"}
PUTS = "add set put addifabsent addall".split()
#: Standard headers whose constants are known without their class.
STANDARD = "ACCEPT ACCEPT_CHARSET ACCEPT_ENCODING ACCEPT_LANGUAGE ACCEPT_PATCH ACCEPT_RANGES ACCESS_CONTROL_ALLOW_CREDENTIALS ACCESS_CONTROL_ALLOW_HEADERS ACCESS_CONTROL_ALLOW_METHODS ACCESS_CONTROL_ALLOW_ORIGIN ACCESS_CONTROL_EXPOSE_HEADERS ACCESS_CONTROL_MAX_AGE ACCESS_CONTROL_REQUEST_HEADERS ACCESS_CONTROL_REQUEST_METHOD AGE ALLOW AUTHORIZATION CACHE_CONTROL CONNECTION CONTENT_DISPOSITION CONTENT_ENCODING CONTENT_LANGUAGE CONTENT_LENGTH CONTENT_LOCATION CONTENT_RANGE CONTENT_TYPE COOKIE DATE ETAG EXPECT EXPIRES FROM HOST IF_MATCH IF_MODIFIED_SINCE IF_NONE_MATCH IF_RANGE IF_UNMODIFIED_SINCE LAST_MODIFIED LINK LOCATION MAX_FORWARDS ORIGIN PRAGMA PROXY_AUTHENTICATE PROXY_AUTHORIZATION RANGE REFERER RETRY_AFTER SERVER SET_COOKIE TE TRAILER TRANSFER_ENCODING UPGRADE USER_AGENT VARY VIA WARNING WWW_AUTHENTICATE X_CSRF_TOKEN X_FORWARDED_FOR X_FORWARDED_HOST X_FORWARDED_PROTO X_FRAME_OPTIONS X_REQUESTED_WITH".split()
#: Methods that carry a body if they have an argument.
PAYLOAD = "body bodybytearray bodyfile bodyform bodystream bodystring bodyvalue bodywithsinglequotes content methodjson postjson putjson setbody setentity syncbody withbinarydata".split()
#: A mocking library's methods that stub, that stub by an argument, and that verify.
STUBS = "when given doreturn dothrow doanswer donothing docallrealmethod willreturn willthrow willanswer willdonothing willcallrealmethod".split()
ARGUMENT_STUBS = "when given".split()
VERIFIES = "verify then should".split()
MOCKING = "org.mockito."


def no_names() -> Column:
    return F.array().cast("array<string>")


def text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def method() -> Column:
    return F.lower(text("method_name"))


def _at(table: dict[str, dict[int, str]]) -> list[tuple[str, str, list[int]]]:
    found: dict[tuple[str, str], list[int]] = {}
    for family, by in table.items():
        for place, names in by.items():
            for m in names.split():
                found.setdefault((family, m), []).append(place)
    return [(f, m, sorted(p)) for (f, m), p in found.items()]


def _in(pairs: tuple[tuple[str, str], ...], family: Column, m: Column) -> Column:
    return F.concat_ws(" ", family, m).isin(*[" ".join(p) for p in pairs])


# ---- arguments


def path_arguments(spark: SparkSession) -> DataFrame:
    """(family, m, path_at, verb_at): places of paths and verbs, a fixed table."""
    a = spark.createDataFrame(_at(PATH_AT), "family string, m string, path_at array<int>")
    b = spark.createDataFrame(_at(VERB_AT), "family string, m string, verb_at array<int>")
    return a.join(b, ["family", "m"], "full")


def _cut_off(literal: Column, rest: Column) -> Column:
    """A path literal that ends in a slash and is continued by what isn't known."""
    scheme = F.lower(url_part(literal, "scheme"))
    path = url_part(literal, "path")
    part = F.when(scheme.isin("http", "https"), path).otherwise(F.coalesce(F.nullif(path, F.lit("")), literal))
    return F.coalesce((F.length(part) > 1) & part.endswith("/") & (url_part(literal, "query") == "") & rest.contains("+"), F.lit(False))


def _host_only(literal: Column) -> Column:
    """The address of a local host without a path: the path is in a later literal."""
    web = literal.rlike("^https?://")
    bare = url_part(literal, "path").isin("", "/") & (url_part(literal, "query") == "") & (url_part(literal, "fragment") == "")
    return F.coalesce(web & bare & is_local_host(F.lower(F.regexp_extract(literal, r"^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:]*)", 1))), F.lit(False))


def _as_path(t: Column, m: Column, segment: Column) -> Column:
    """The path that a trimmed text stands for, else null."""
    media = F.lower(F.trim(F.regexp_extract(t, r"^([^;]*)", 1))).rlike(MEDIA)
    relative = is_relative_path(t, False) & ~t.rlike(r"^[{\[]") & (t.contains("/") | segment) & ~m.isin(*NO_PATH) & (m.isin(*ANY_PATH) | ~media)
    bare = F.regexp_replace(t, "^/+", "")
    return F.when(t.rlike(r"^(?:/|https?://)"), t).when(relative & (bare != ""), F.concat(F.lit("/"), bare))


def path_of(args: Column, values: Column, places: Column, m: Column, family: Column) -> Column:
    """CLS-08/38: struct of path and truncated: of the arguments at those places, the first constant or literal that is a path."""
    segment = _in(SEGMENT, family, m)
    none = F.array().cast("array<struct<path:string,truncated:boolean>>")

    def of(p: Column) -> Column:
        expr, value = F.get(args, p), F.trim(F.get(values, p))
        whole = F.filter(F.array(F.struct(F.when(value != "", _as_path(value, m, segment)).alias("path"), F.lit(False).alias("truncated"))), lambda x: x["path"].isNotNull())
        between = F.split(expr, QUOTED)
        literals = F.transform(F.regexp_extract_all(expr, F.lit(QUOTED), 1), lambda x, i: F.struct(F.trim(x).alias("t"), F.array_join(F.slice(between, i + 2, F.greatest(F.size(between) - i - 1, F.lit(0))), "").alias("rest")))
        found = F.transform(F.filter(literals, lambda x: (x["t"] != "") & ~_host_only(x["t"])), lambda x: F.struct(_as_path(x["t"], m, segment).alias("path"), _cut_off(x["t"], x["rest"]).alias("truncated")))
        return F.coalesce(F.concat(whole, F.filter(found, lambda x: x["path"].isNotNull())), none)

    return F.get(F.flatten(F.transform(places, of)), 0)


def path_segments(args: Column, values: Column) -> Column:
    """Karate's path(a, b, ...): all segments as one path, up to the first that isn't known."""
    def of(x: Column, i: Column) -> Column:
        t = F.trim(F.coalesce(F.nullif(F.regexp_extract(F.trim(x), r'^"([^"]*)"$', 1), F.lit("")), F.get(values, i)))
        return F.when((t != "") & ~t.rlike("^https?://") & (t.startswith("/") | (is_relative_path(t, False) & ~t.rlike(r"^[{\[]"))), F.regexp_replace(t, r"^/+|/+$", ""))

    known = F.transform(args, of)
    unknown = F.array_position(F.transform(known, lambda x: x.isNull()), True)
    upto = F.when(unknown > 0, F.slice(known, F.lit(1), (unknown - 1).cast("int"))).otherwise(known)
    joined = F.array_join(upto, "/")
    return F.struct(F.when(joined != "", F.concat(F.lit("/"), joined)).otherwise("").alias("path"), (unknown > 0).alias("truncated"))


def verb_in(args: Column) -> Column:
    """CLS-09: the first verb that an argument is: a quoted one, X.GET, or GET alone; null without one."""
    def of(x: Column) -> Column:
        quoted = F.get(F.filter(F.transform(F.regexp_extract_all(x, F.lit(QUOTED), 1), F.upper), lambda v: v.isin(*VERB.split("|"))), 0)
        qualified = F.nullif(F.regexp_extract(x, rf"\b[A-Za-z_][A-Za-z0-9_$.]*\s*\.\s*({VERB})\b", 1), F.lit(""))
        return F.coalesce(quoted, qualified, F.nullif(F.regexp_extract(x, rf"^\s*({VERB})\s*$", 1), F.lit("")))

    return F.get(F.filter(F.transform(args, of), lambda x: x.isNotNull()), 0)


def literal_at(args: Column, i: int = 0) -> Column:
    return F.nullif(F.trim(string_literal(F.get(args, F.lit(i)))), F.lit(""))


def every_other(args: Column, of=None) -> Column:
    """of() of the arguments 0, 2, 4, ...; the literal by default."""
    of = of or (lambda x: F.nullif(F.trim(string_literal(x)), F.lit("")))
    return F.transform(F.filter(args, lambda x, i: i % 2 == 0), of)


def header_name(x: Column) -> Column:
    """CLS-10/36: the header that an argument names: a literal, a header object's literal, a constant of a header class or a standard one; else null."""
    literal = F.coalesce(F.nullif(F.trim(string_literal(x)), F.lit("")), F.nullif(F.trim(F.regexp_extract(x, rf'^\s*new\s+(?:{NAME}\.)*(?:Basic)?Header\s*\(\s*{QUOTED}\s*,', 1)), F.lit("")))
    built = F.regexp_replace(x, QUOTED, "").contains("+")
    pattern = rf"(?:({NAME})\s*\.\s*)?\b([A-Z][A-Z0-9_]*)\s*$"
    owner, constant = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
    known = (constant != "") & (constant != "EMPTY") & (owner.isin("HttpHeaders", "HttpHeaderNames") | ((owner == "") & constant.isin(*STANDARD)))
    return F.coalesce(F.lower(literal), F.when(~built & known, F.lower(F.replace(constant, F.lit("_"), F.lit("-")))))


def _names(found: Column) -> Column:
    """Distinct names without nulls and empty ones, in order."""
    return F.array_distinct(F.filter(F.coalesce(found, no_names()), lambda n: n.isNotNull() & (n != "")))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def has_body(framework: Column, m: Column, verb: Column, args: Column, receiver: Column) -> Column:
    """CLS-15: whether a call gives its request a body, by framework."""
    n = F.size(args)
    at = lambda i: F.coalesce(F.get(args, F.lit(i)), F.lit(""))
    q = r"(?:[\w$]+\.)*"
    entity = (F.trim(at(2)) != "") & ~at(2).rlike(rf"^\s*(?:null|{q}HttpEntity\.EMPTY)\s*$") & ~at(2).rlike(rf"^\s*new\s+{q}HttpEntity\s*(?:<[^>]*>)?\s*\(\s*(?:\)\s*$|null\s*[,)])")
    template = ~F.lower(receiver).rlike(r"^org\.springframework\.http\.requestentity(?:[.$]|$)") & (
        (m.isin("postforentity", "postforobject", "postforlocation", "put", "patchforobject") & (n >= 2)) | ((m == "exchange") & verb.isin("POST", "PUT", "PATCH") & entity)
    )
    publisher = lambda i: (F.trim(at(i)) != "") & ~at(i).rlike(rf"^\s*(?:null|{q}noBody\s*\(\s*\))\s*$")
    rule = (
        F.when(framework.isin("rest-template", "test-rest-template"), template)
        .when(framework == "java-httpclient", (m.isin("post", "put", "patch") & publisher(0)) | ((m == "method") & publisher(1)))
        .when(framework == "okhttp", m.isin("post", "put", "patch") & (n > 0))
        .when(framework == "micronaut-client", m.isin("post", "put", "patch", "delete") & (n >= 2))
        .when(framework == "karate", (m.isin("post", "put", "patch", "postjson", "putjson", "patchjson", "delete") & (n > 0)) | (m.isin("method", "methodjson") & (n >= 2)))
        .when(framework == "jax-rs", (m.isin("post", "put") & (n > 0)) | ((m == "method") & at(1).rlike(rf"^\s*{q}Entity\s*\.\s*[\w$]+\s*\(")))
        .when(framework == "feign", m == "body")
    )
    return (m.isin(*PAYLOAD) & (n > 0)) | F.coalesce(rule, F.lit(False))


def describe(calls: DataFrame) -> DataFrame:
    """Pass 4: http_method, path, truncated, headers, header_names, query_names, path_names, form_names, either_names, has_body and auth_hints of calls that have a family.

    either_names: names of REST Assured's param(), which are form fields or queries
    by the verb that the request ends up with.
    """
    m, family, framework = method(), text("family"), text("framework")
    args, values = F.col("args"), F.col("values")
    ctor = F.coalesce(F.col("is_constructor"), F.lit(False))
    dynamic = (framework == "apache-httpclient") & (K.simple_name(text("receiver_type")) == K.DYNAMIC)
    tables = path_arguments(calls.sparkSession).withColumnRenamed("family", "_f")
    d = calls.withColumn("_m", m).join(F.broadcast(tables), (F.col("_f") == family) & (F.col("m") == F.col("_m")), "left")  # a fixed table
    n = F.size(args)
    last = F.when(n.between(2, 4), F.array(n - 1))
    no = F.array().cast("array<int>")
    path_at = F.when(ctor & dynamic, last).when(ctor, F.when(framework == "apache-httpclient", F.array(F.lit(0)))).when((family == "apache-httpclient.request") & (m == "create"), last).otherwise(F.col("path_at"))
    verb_at = F.when(ctor & dynamic, F.array(F.lit(0))).otherwise(F.col("verb_at"))
    d = d.withColumn("_path_at", F.coalesce(path_at, no)).withColumn("_verb_at", F.coalesce(verb_at, no))
    found = F.when((family == "karate.request") & (m == "path") & (n >= 2), path_segments(args, values)).otherwise(path_of(args, values, F.col("_path_at"), m, family))
    d = d.withColumn("_p", found).withColumn("path", F.coalesce("_p.path", F.lit(""))).withColumn("truncated", F.coalesce("_p.truncated", F.lit(False)))
    given = verb_in(F.filter(F.transform("_verb_at", lambda p: F.get(args, p)), lambda x: x.isNotNull()))
    types = F.transform(F.slice("arg_types", 1, 2), lambda t: F.nullif(F.upper(F.regexp_extract(F.regexp_extract(t, r"([^.]*)$", 1), K.CONSTRUCTED, 1)), F.lit("")))
    typed = F.when((family == "apache-httpclient.request") & m.isin("execute", "executeopen") & F.coalesce(F.col("by_rule"), F.lit(False)), F.get(F.filter(types, lambda t: t.isNotNull()), 0))
    verb = F.coalesce(given, typed, F.col("verb"), F.lit(K.UNKNOWN))
    uri = (framework == "micronaut-client") & (F.col("request_role") == K.EVENT) & m.isin("exchange", "retrieve") & (F.get("arg_types", F.lit(0)) == "java.lang.String")
    d = d.withColumn("http_method", F.when((verb == K.UNKNOWN) & F.coalesce(uri, F.lit(False)), "GET").otherwise(verb))
    low = lambda x: F.lower(x)
    words = ("header", "content-type", *[w.lower() for w in CREDENTIALS])
    headers = F.filter(args, lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low(x).contains(w)))
    hints = F.filter(F.array(*[F.lit(w) for w in CREDENTIALS]), lambda w: F.exists(args, lambda x: low(x).contains(F.lower(w))))
    named = F.when(m.isin(*HEADER_OF), F.array(_lookup(HEADER_OF, m))).when(m.isin("header", "setheader", "addheader"), F.array(header_name(F.trim(F.get(args, F.lit(0)))))).when(m == "headers", every_other(args, lambda x: header_name(F.trim(x))))
    either = (framework == "rest-assured") & m.isin("param", "params")
    one = F.array(literal_at(args))
    of_query = F.transform(F.filter(F.split(F.coalesce(literal_at(args), F.lit("")), "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    asked = (
        F.when(either, no_names())
        .when((family == "pact.request") & m.isin("queryparam", "param", "query", "encodedquery"), of_query)
        .when(m.isin("queryparam", "param", "query"), one)
        .when(m.isin("queryparams", "params", "queries"), every_other(args))
        .when(m == "uri", F.flatten(F.transform(args, lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"\bqueryParams?\s*\(\s*{QUOTED}"), 1), lambda x: F.trim(x)))))
    )
    part = F.coalesce(literal_at(args), F.nullif(F.trim(F.regexp_extract(F.get(args, F.lit(0)), rf"^\s*new\s+(?:{NAME}\.)*MockMultipartFile\s*\(\s*{QUOTED}\s*,", 1)), F.lit("")))
    inserted = F.flatten(F.transform(args, lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"\bfrom(?:FormData|MultipartData)\s*\(\s*{QUOTED}\s*,"), 1), lambda x: F.trim(x))))
    fields = (
        F.when((m == "formparam") | ((m == "multipart") & (framework == "rest-assured")), one)
        .when(m == "formparams", every_other(args))
        .when((m == "file") & (framework == "mockmvc"), F.array(part))
        .when((m == "body") & framework.isin("webtestclient", "webclient"), inserted)
    )
    variables = F.when(m == "pathparam", one).when(m == "pathparams", every_other(args))
    d = d.withColumns(
        {
            "headers": headers,
            "header_names": _names(named),
            "query_names": _names(F.concat(F.array_sort(query_names("path")), F.coalesce(asked, no_names()))),
            "path_names": _names(F.concat(template_variables("path"), F.coalesce(variables, no_names()))),
            "form_names": _names(fields),
            "either_names": F.when(either, _names(F.when(m == "param", one).otherwise(every_other(args)))).otherwise(no_names()),
            "has_body": has_body(framework, m, F.col("http_method"), args, text("receiver_type")),
            "auth_hints": hints,
        }
    )
    void = F.exists(args, lambda x: F.regexp_replace(x, r"\s+", "").isin("Void.class", "java.lang.Void.class", "Void.TYPE", "java.lang.Void.TYPE"))
    web = (framework == "webtestclient") & F.col("response_role").isNotNull()
    role = F.when(web & text("method_name").isin("expectStatus", "expectHeader", "expectCookie"), K.MATCHER).when(web & text("method_name").isin("expectBody", "expectBodyList"), F.when((n > 0) & ~void, K.BODY).otherwise(K.MATCHER))
    d = d.withColumn("response_role", F.coalesce(role, "response_role"))
    return d.drop("_f", "m", "_m", "path_at", "verb_at", "_path_at", "_verb_at", "_p")


# ---- passes over a method's calls


def mocked(calls: DataFrame, *keys: str) -> DataFrame:
    """CLS-16: calls with mocking (kind and wrapper), null where no mocking library wraps them.

    A wrapper is an earlier member of the receiver chain, the nearest one, or a when()
    or given() in whose arguments the call's chain stands.
    """
    m = method()
    ours = text("receiver_type").startswith(MOCKING) | text("callee_signature").startswith(MOCKING)
    kind = F.when(m.isin(*STUBS), "stubbing").when(m.isin(*VERIFIES), "verification")
    wraps = F.when(ours & kind.isNotNull(), F.struct(kind.alias("kind"), text("method_name").alias("wrapper")))
    d = calls.withColumn("_w", wraps)
    before = Window.partitionBy(*keys, "start").orderBy("stop", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    hosts = d.filter(F.col("_w").isNotNull() & m.isin(*ARGUMENT_STUBS)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("call_id").alias("_h"), F.col("_w").alias("_hw"))
    same = F.col("host_id") == F.col("_h")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    chained = d.withColumn("_b", F.last("_w", ignorenulls=True).over(before)).join(hosts, same, "left")
    return chained.withColumn("mocking", F.coalesce("_b", "_hw")).drop("_w", "_b", "_h", "_hw", *[f"_k{i}" for i in range(len(keys))])


def inferred(calls: DataFrame, *keys: str) -> DataFrame:
    """CLS-05/07: calls with the family and role that builders around them show, where they have none.

    Builders of the chain since its last event, mocked call or response, and builders in
    a call's arguments, are its evidence; where all are of one framework, its table says
    what the method is.  What is inferred is evidence for the calls after it.  calls:
    as nest() and mocked() leave them, with the ancestors of builders.  The fold runs
    over one chain, the calls of one expression.
    """
    spark = calls.sparkSession
    role = F.when(F.col("mocking").isNull(), F.col("request_role"))
    inside = calls.filter(role == K.BUILDER).select(*keys, F.col("start").alias("_s"), F.col("stop").alias("_e"), "framework", text("receiver_type").alias("_t"), F.explode("ancestors").alias("a")).filter("a.in_arguments")
    order = F.struct(~F.col("a.near"), F.col("_s"), -F.col("_e"))
    shown = inside.groupBy(*keys, F.col("a.call_id").alias("call_id")).agg(
        F.when(F.count_distinct("framework") == 1, F.min("framework")).otherwise("*").alias("_arg"), F.max_by(F.when(F.col("_t") != "", F.col("_t")), F.when(F.col("_t") != "", order)).alias("_arg_type")
    )
    table: dict[str, dict[str, tuple]] = {}
    for framework, family, asks, names in K.RECEIVERLESS:
        for name in names.split():
            table.setdefault(name.lower(), {}).setdefault(framework, (framework, family, asks, K.verb_of(family, name.lower())))
    options = spark.createDataFrame([(k, list(v.values())) for k, v in table.items()], "_m string, options array<struct<framework:string,family:string,role:string,verb:string>>")
    d = calls.withColumn("_m", method()).join(F.broadcast(options), "_m", "left").join(shown, [*keys, "call_id"], "left")  # a fixed table
    member = F.struct("stop", "call_id", F.col("framework").isNotNull().alias("known"), F.col("framework").alias("fw"), role.alias("role"), F.col("response_role").alias("response"), F.col("mocking").isNotNull().alias("mock"), text("receiver_type").alias("type"), "options", F.col("_arg").alias("arg"), F.col("_arg_type").alias("arg_type"))
    found = "struct<call_id:{0},framework:string,family:string,role:string,verb:string,receiver:string>".format(calls.schema["call_id"].dataType.simpleString())
    state = f"struct<fw:string,type:string,out:array<{found}>>"

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise("*")

    def step(s: Column, x: Column) -> Column:
        one = both(s["fw"], x["arg"])
        hit = F.when(~x["known"] & one.isNotNull() & (one != "*"), F.get(F.filter(x["options"], lambda o: o["framework"] == one), 0))
        receiver = F.coalesce(x["arg_type"], s["type"])
        new = F.when(hit.isNotNull(), F.struct(x["call_id"].alias("call_id"), one.alias("framework"), hit["family"].alias("family"), F.when(~x["mock"], hit["role"]).alias("role"), hit["verb"].alias("verb"), F.coalesce(receiver, F.lit("")).alias("receiver")))
        now = F.when(x["known"], x["role"]).otherwise(F.when(~x["mock"], hit["role"]))
        clear = (x["known"] & (x["mock"] | x["response"].isNotNull())) | F.coalesce(now == K.EVENT, F.lit(False))
        builder = F.coalesce(now == K.BUILDER, F.lit(False))
        fw = F.when(clear, F.lit(None)).when(builder, both(s["fw"], F.when(x["known"], x["fw"]).otherwise(one))).otherwise(s["fw"])
        last = F.when(x["known"], F.nullif(x["type"], F.lit(""))).otherwise(receiver)
        kind = F.when(clear, F.lit(None)).when(builder, F.coalesce(last, s["type"])).otherwise(s["type"])
        return F.struct(fw.alias("fw"), kind.alias("type"), F.when(new.isNotNull(), F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out")).cast(state)

    start = F.struct(F.lit(None).cast("string").alias("fw"), F.lit(None).cast("string").alias("type"), F.array().cast(f"array<{found}>").alias("out")).cast(state)
    chains = d.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("stop", "call_id", member.alias("x")))).alias("chain"), F.bool_or(F.col("framework").isNull() & F.col("options").isNotNull()).alias("open"))
    runs = chains.filter("open").select(*keys, F.explode(F.aggregate(F.transform("chain", lambda c: c["x"]), start, step, lambda s: s["out"])).alias("f"))
    new = runs.select(*keys, F.col("f.call_id").alias("call_id"), *[F.col(f"f.{c}").alias(f"_{c}") for c in ("framework", "family", "role", "verb", "receiver")])
    out = calls.join(new, [*keys, "call_id"], "left").withColumn("by_rule", F.col("framework").isNotNull())
    got = F.col("_framework").isNotNull()
    take = {"framework": "_framework", "family": "_family", "request_role": "_role", "verb": "_verb", "receiver_type": "_receiver"}
    return out.withColumns({c: F.when(got, F.col(n)).otherwise(F.col(c)) for c, n in take.items()}).drop(*take.values())


def container_names(calls: DataFrame, *keys: str) -> DataFrame:
    """Pass 5: names that a variable got by earlier calls on it, where the variable is what headers(), queryParams(), params() or a form body is given."""
    m, args = method(), F.col("args")
    alone = F.when(F.size(args) == 1, F.nullif(F.regexp_extract(F.get(args, F.lit(0)), rf"^\s*({NAME})\s*$", 1), F.lit("")))
    forms = F.flatten(F.transform(args, lambda x: F.regexp_extract_all(x, F.lit(rf"\bfrom(?:FormData|MultipartData)\s*\(\s*({NAME})\s*\)"), 1)))
    asks = F.col("request_role").isNotNull()
    target = F.when(asks & (m == "headers"), "header_names").when(asks & (m == "queryparams"), "query_names").when((F.col("framework") == "rest-assured") & (m == "params"), "either_names").when(F.col("framework").isin("webtestclient", "webclient") & (m == "body"), "form_names")
    variables = F.when(target == "form_names", forms).when(target.isNotNull() & alone.isNotNull(), F.array(alone))
    users = calls.filter(target.isNotNull()).select(*keys, "call_id", F.col("stop").alias("_until"), target.alias("_to"), F.posexplode(F.array_distinct(variables)).alias("_v", "_variable"))
    header = F.when(m.isin(*PUTS), header_name(F.trim(F.get(args, F.lit(0))))).otherwise(_lookup(SETTER_OF, m))
    sets = calls.filter(m.isin(*PUTS, *SETTER_OF) & text("receiver_expr").rlike(rf"^{NAME}$")).select(*keys, F.col("receiver_expr").alias("_variable"), F.col("start").alias("_s"), F.col("stop").alias("_e"), header.alias("_header"), F.when(m.isin(*PUTS), literal_at(args)).alias("_key"))
    met = users.join(sets, [*keys, "_variable"]).filter(F.col("_s") < F.col("_until")).withColumn("_name", F.when(F.col("_to") == "header_names", F.col("_header")).otherwise(F.col("_key"))).filter("_name <> ''")
    got = met.groupBy(*keys, "call_id", "_to").agg(F.transform(F.sort_array(F.collect_list(F.struct("_v", "_s", "_e", "_name"))), lambda x: x["_name"]).alias("_more"))
    out = calls.join(got, [*keys, "call_id"], "left")
    for c in ("header_names", "query_names", "either_names", "form_names"):
        out = out.withColumn(c, F.when(F.col("_to") == c, F.array_union(c, "_more")).otherwise(F.col(c)))
    return out.drop("_to", "_more")


def classify(calls: DataFrame, *keys: str) -> DataFrame:
    """CLS-07/35: passes 1 to 5; calls without a family keep null in what the passes find."""
    arrays = {c: F.coalesce(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), no_names()) for c in ("args", "arg_types")}
    d = calls.dropDuplicates([*keys, "call_id"]).withColumns(arrays).withColumn("values", F.coalesce("values", no_names()))
    d = K.resolve(d)
    builds = {n.lower() for *_, asks, names in K.RECEIVERLESS if asks == K.BUILDER for n in names.split()}
    may_build = (F.col("request_role") == K.BUILDER) | (F.col("framework").isNull() & method().isin(*sorted(builds)))
    d = nest(d.withColumn("_b", F.coalesce(may_build, F.lit(False))), *keys, wanted="_b").drop("_b")
    d = mocked(d, *keys)
    gone = F.col("mocking").isNotNull()
    d = cut(d.withColumns({c: F.when(~gone, F.col(c)) for c in ("request_role", "response_role")}))
    d = inferred(d, *keys)
    d = d.withColumn("mocking", F.when(F.col("framework").isNotNull(), F.col("mocking")))
    known = container_names(cut(describe(d)), *keys)
    blank = F.col("framework").isNull()
    return known.withColumns({c: F.when(~blank, F.col(c)) for c in ("http_method", "path", "truncated", "headers", "header_names", "query_names", "path_names", "form_names", "either_names", "has_body", "auth_hints")})


def once_a_body(calls: DataFrame, of: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """of(calls), found once for all methods whose calls are the same, and given to each of them.

    of: steps whose rows have keys and follow from the calls of their method alone, such as
    classify() and correlate().  Methods with the same calls (all columns, in any order) have
    one body; the method with the least key stands for it.  Bodies are told by the number of
    calls and sums of two hashes of each, so only those, not the calls, are shuffled to find
    them.  Calls whose key is null stand for themselves.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    row = F.to_json(F.struct(*sorted(c for c in calls.columns if c not in keys)))
    hashes = calls.filter(whole).select(*keys, F.xxhash64(row).alias("_x"), F.xxhash64(F.lit(1), row).alias("_y"))
    # Halves, so that a sum of 2**31 rows still fits.
    halves = [part.alias(f"_s{i}") for i, part in enumerate(F.sum(h) for c in ("_x", "_y") for h in (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32)))]
    body = ["_n", "_s0", "_s1", "_s2", "_s3"]
    methods = cut(hashes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *halves))
    first = written(methods.groupBy(*body).agg(F.min(F.struct(*keys)).alias("_first")))
    stand = first.select(*[F.col(f"_first.{k}").alias(k) for k in keys])
    found = written(of(calls.join(stand, list(keys), "left_semi").unionByName(calls.filter(~whole))))
    members = methods.join(first, body).select(*keys, *[F.col(f"_first.{k}").alias(f"_b{i}") for i, k in enumerate(keys)])
    given = found.filter(whole).select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[c for c in found.columns if c not in keys])
    out = members.join(given, [f"_b{i}" for i in range(len(keys))]).select(*found.columns)
    return out.unionByName(found.filter(~whole))
