"""CLS-02/04/06: owner families of HTTP frameworks as a rule table, and the one family that answers for a call.

A rule holds receiver types (prefixes, which end at a package or class boundary, or exact
types), and what its methods are: a request role, a response role and a verb.  Of the
rules that know a call's method, the longest receiver wins, then a constructor that names
a verb, then a named method before a rule's default, then the earlier rule.  The table is
small and fixed; calls meet it by equi joins on the prefixes of their distinct receivers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitestat.operators.rules import prefixes

BUILDER, EVENT = "builder", "event"
INSPECTOR, MATCHER, EXTRACTOR = "inspector", "matcher", "extractor"
STATUS, BODY, HEADER = "status-assertion", "body-assertion", "header-assertion"
UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class Family:
    """One rule.  Texts list names with blanks between them; request and response give (role, methods) pairs."""

    framework: str
    family: str
    receivers: str
    request: tuple[tuple[str, str], ...] = ()
    response: tuple[tuple[str, str], ...] = ()
    default: str = ""  # response role of methods that aren't listed
    exact: bool = False
    constructs: bool = False  # constructors name a verb
    holds_path: bool = False  # values of these types carry a request's path
    static: str = ""  # types whose methods may be imported statically


def under(roots: str, names: str) -> str:
    """Each name under each root: "a. b." and "X Y" give a.X a.Y b.X b.Y."""
    return " ".join(r + n for r in roots.split() for n in names.split())


def nested(owner: str, names: str) -> str:
    """Nested types of an owner, written with $ and with a dot."""
    return " ".join(f"{owner}{mark}{n}" for n in names.split() for mark in "$.")


# Receiver types and methods of the frameworks' public interfaces.

_RA = "io.restassured. com.jayway.restassured."
_RA_MOCK = under(_RA, "module.mockmvc.")
_RA_WEB = "io.restassured.module.webtestclient."
_RA_FACTORY = f"{under(_RA, 'RestAssured')} {under(_RA_MOCK, 'RestAssuredMockMvc')} {_RA_WEB}RestAssuredWebTestClient"
_RA_SPEC = under(_RA, "specification.RequestSpecification specification.FilterableRequestSpecification specification.RequestSender specification.RequestSenderOptions internal.RequestSpecificationImpl")
_RA_MODULE_SPEC = " ".join(
    (
        under(_RA_MOCK, "specification.MockMvcRequestSpecification specification.MockMvcRequestSender specification.MockMvcRequestSenderOptions internal.MockMvcRequestSpecificationImpl"),
        under(_RA_WEB, "specification.WebTestClientRequestSpecification specification.WebTestClientRequestSender specification.WebTestClientRequestSenderOptions internal.WebTestClientRequestSpecificationImpl"),
    )
)
_RA_RESPONSE = f"{under(_RA, 'response.Response internal.RestAssuredResponseImpl')} {under(_RA_MOCK, 'response.MockMvcResponse internal.MockMvcRestAssuredResponseImpl')} {under(_RA_WEB, 'response.WebTestClientResponse internal.WebTestClientRestAssuredResponseImpl')}"
_RA_RESPONSE_SPEC = under(_RA, "specification.ResponseSpecification specification.FilterableResponseSpecification internal.ResponseSpecificationImpl")
_RA_VALID = " ".join(
    (
        under(_RA, "response.ValidatableResponse response.ValidatableResponseOptions internal.ValidatableResponseImpl internal.ValidatableResponseOptionsImpl"),
        under(_RA_MOCK, "response.ValidatableMockMvcResponse internal.ValidatableMockMvcResponseImpl"),
        under(_RA_WEB, "response.ValidatableWebTestClientResponse internal.ValidatableWebTestClientResponseImpl"),
    )
)
_RA_EXTRACT = under(_RA, "response.ExtractableResponse response.ExtractableResponseOptions response.ResponseOptions response.ResponseBodyExtractionOptions internal.RestAssuredResponseOptionsImpl path.json.JsonPath path.xml.XmlPath")
_RA_BUILDERS = "given when header headers queryParam queryParams pathParam pathParams param params auth oauth2 body contentType accept cookie cookies baseUri basePath port formParam formParams multiPart spec filter urlEncodingEnabled relaxedHTTPSValidation"
_RA_EXTRACTORS = "extract path as response body headers header cookies detailedCookies cookie detailedCookie contentType statusCode statusLine sessionId time timeIn asString asPrettyString asByteArray asInputStream jsonPath xmlPath htmlPath"

_VERBS = "get post put delete patch head options"
_TEMPLATE = "getForEntity getForObject headForHeaders postForLocation postForEntity postForObject put delete patchForObject optionsForAllow exchange execute"
_WEB = "org.springframework.test.web.reactive.server."
_SERVLET = "org.springframework.test.web.servlet."
_WEB_SPEC = f"{nested(_WEB + 'WebTestClient', 'RequestHeadersUriSpec RequestBodyUriSpec RequestHeadersSpec RequestBodySpec')} {nested(_WEB + 'DefaultWebTestClient', 'DefaultRequestBodyUriSpec')}"
_WEB_RESPONSE = f"{nested(_WEB + 'WebTestClient', 'ResponseSpec')} {nested(_WEB + 'DefaultWebTestClient', 'DefaultResponseSpec')}"
_WEB_BODY = f"{nested(_WEB + 'WebTestClient', 'BodySpec BodyContentSpec ListBodySpec JsonPathAssertions')} {nested(_WEB + 'DefaultWebTestClient', 'DefaultBodySpec DefaultBodyContentSpec DefaultListBodySpec')} {under(_WEB, 'BodySpec BodyContentSpec ListBodySpec JsonPathAssertions XpathAssertions')}"
_SPEC_BUILDERS = "uri header headers cookie cookies accept acceptCharset contentType contentLength body ifModifiedSince ifNoneMatch"
_WEB_BUILDERS = f"{_VERBS} method {_SPEC_BUILDERS} bodyValue syncBody attribute attributes apiVersion"
_WEB_EVENTS = "exchange exchangeSuccessfully exchangeToMono exchangeToFlux"
_BINDERS = "bindToServer bindToApplicationContext bindToController bindToRouterFunction bindToWebHandler"
_WEBCLIENT = "org.springframework.web.reactive.function.client."
_RESTCLIENT = "org.springframework.web.client."
_URI_SPECS = "UriSpec RequestHeadersUriSpec RequestBodyUriSpec RequestHeadersSpec RequestBodySpec"
_MOCK_FACTORY = f"{_VERBS} request multipart"
_MOCK_BUILDERS = "request header headers param params file content contentType accept characterEncoding queryParam queryParams cookie cookies flashAttr sessionAttr requestAttr contextPath servletPath secure locale with principal"
_MOCK_MATCHERS = "status content jsonPath model view flash request xpath forwardedUrl redirectedUrl handler"
_MN_EVENTS = "exchange retrieve dataStream exchangeStream jsonStream"
_MN_FACTORY = "GET POST PUT PATCH DELETE HEAD OPTIONS create"
_MN_BUILDERS = "uri header headers body contentType contentLength contentEncoding accept cookie cookies basicAuth bearerAuth"
_OK_BUILDERS = "url addHeader header headers method get head post put patch delete"
_A4 = "org.apache.http."
_A5 = "org.apache.hc.client5.http."
_C5 = "org.apache.hc.core5.http."
_APACHE_EVENTS = " ".join(
    (
        under(_A4 + "client.", "fluent.Executor fluent.Request HttpClient"),
        under(_A4 + "nio.client.", "HttpAsyncClient HttpPipeliningClient"),
        under(_A4 + "impl.client.", "AbstractHttpClient CloseableHttpClient ContentEncodingHttpClient DecompressingHttpClient DefaultHttpClient FutureRequestExecutionService MinimalHttpClient SystemDefaultHttpClient"),
        under(_A4 + "impl.nio.client.", "AbstractHttpAsyncClient CloseableHttpAsyncClient CloseableHttpPipeliningClient DefaultHttpAsyncClient"),
        under(_A5, "fluent.Async fluent.Executor fluent.Request async.HttpAsyncClient classic.HttpClient"),
        under(_A5 + "impl.async.", "CloseableHttpAsyncClient InternalH2AsyncClient InternalHttpAsyncClient MinimalH2AsyncClient MinimalHttpAsyncClient"),
        under(_A5 + "impl.classic.", "CloseableHttpClient FutureRequestExecutionService InternalHttpClient MinimalHttpClient"),
    )
)
_APACHE_REQUESTS = " ".join(
    (
        under(_A4, "client.fluent.Request HttpEntityEnclosingRequest HttpRequest message.BasicHttpEntityEnclosingRequest message.BasicHttpRequest"),
        under(_A4 + "client.methods.", "HttpDelete HttpEntityEnclosingRequestBase HttpGet HttpHead HttpOptions HttpPatch HttpPost HttpPut HttpRequestBase HttpRequestWrapper HttpTrace HttpUriRequest RequestBuilder"),
        under(_A5 + "async.methods.", "BasicHttpRequests BasicRequestBuilder SimpleHttpRequest SimpleHttpRequests SimpleRequestBuilder"),
        under(_A5, "classic.methods. fluent.Request"),
        under(_C5, "ClassicHttpRequest HttpRequest io.support.ClassicRequestBuilder message.BasicClassicHttpRequest message.BasicHttpRequest message.HttpRequestWrapper support.AbstractRequestBuilder"),
    )
)
_APACHE_BUILDERS = f"{_VERBS} trace create copy body bodyByteArray bodyFile bodyForm bodyStream bodyString setURI setUri setHeader addHeader setEntity setMethod setBody setPath"
_JAXRS = "javax.ws.rs.client. jakarta.ws.rs.client."
_JAXRS_TARGET = "target path queryParam matrixParam resolveTemplate resolveTemplateFromEncoded resolveTemplates resolveTemplatesFromEncoded request property"
_JAXRS_EVENTS = "get post put delete head options trace method"
_CITRUS = "org.citrusframework.http.actions."
_CITRUS_REQUESTS = under(_CITRUS, "HttpClientRequestActionBuilder HttpServerRequestActionBuilder")

FAMILIES: tuple[Family, ...] = (
    Family("rest-assured", "rest-assured.request_factory", _RA_FACTORY, ((BUILDER, "given when"), (EVENT, f"{_VERBS} request")), static=_RA_FACTORY),
    Family("rest-assured", "rest-assured.request_builder", f"{_RA_SPEC} {_RA_MODULE_SPEC}", ((BUILDER, _RA_BUILDERS),), holds_path=True),
    Family("rest-assured", "rest-assured.request_event", f"{_RA_SPEC} {_RA_MODULE_SPEC}", ((EVENT, f"{_VERBS} request"),)),
    Family("rest-assured", "rest-assured.response_inspector", _RA_RESPONSE, response=((INSPECTOR, "then"),)),
    Family("rest-assured", "rest-assured.status_assertion", f"{_RA_RESPONSE_SPEC} {_RA_VALID}", response=((STATUS, "statusCode statusLine"),)),
    Family("rest-assured", "rest-assured.body_assertion", f"{_RA_RESPONSE_SPEC} {_RA_VALID}", response=((BODY, "body"), (HEADER, "header headers contentType contentTypeCompatibleWith cookie cookies"))),
    Family("rest-assured", "rest-assured.response_extractor", f"{_RA_RESPONSE} {_RA_VALID} {_RA_EXTRACT}", response=((EXTRACTOR, _RA_EXTRACTORS),)),
    Family("test-rest-template", "test-rest-template.request", "org.springframework.boot.test.web.client.TestRestTemplate org.springframework.boot.resttestclient.TestRestTemplate", ((EVENT, _TEMPLATE),)),
    Family("rest-template", "rest-template.request", under(_RESTCLIENT, "RestOperations RestTemplate"), ((EVENT, _TEMPLATE),)),
    Family("rest-template", "rest-template.request", f"org.springframework.http.RequestEntity {nested('org.springframework.http.RequestEntity', 'BodyBuilder HeadersBuilder')}", ((BUILDER, f"{_VERBS} method header headers contentType accept acceptCharset body build"),), holds_path=True, static="org.springframework.http.RequestEntity"),
    Family("mockmvc", "mockmvc.request_factory", f"{_SERVLET}request.MockMvcRequestBuilders", ((BUILDER, f"{_MOCK_FACTORY} asyncDispatch"),), static=f"{_SERVLET}request.MockMvcRequestBuilders"),
    Family("mockmvc", "mockmvc.request_factory", "org.springframework.restdocs.mockmvc.RestDocumentationRequestBuilders", ((BUILDER, _MOCK_FACTORY),), static="org.springframework.restdocs.mockmvc.RestDocumentationRequestBuilders"),
    Family("mockmvc", "mockmvc.request_builder", under(f"{_SERVLET}request.", "MockHttpServletRequestBuilder MockMultipartHttpServletRequestBuilder AbstractMockHttpServletRequestBuilder AbstractMockMultipartHttpServletRequestBuilder"), ((BUILDER, _MOCK_BUILDERS),), holds_path=True),
    Family("mockmvc", "mockmvc.request_executor", f"{_SERVLET}MockMvc", ((EVENT, "perform"),)),
    Family("mockmvc", "mockmvc.response_inspector", f"{_SERVLET}ResultActions", response=((INSPECTOR, "andExpect andExpectAll andDo"), (EXTRACTOR, "andReturn"))),
    Family("mockmvc", "mockmvc.matcher_root", f"{_SERVLET}result.MockMvcResultMatchers", response=((HEADER, "header cookie"), (MATCHER, _MOCK_MATCHERS)), static=f"{_SERVLET}result.MockMvcResultMatchers"),
    Family("mockmvc", "mockmvc.status_assertion", f"{_SERVLET}result.StatusResultMatchers", default=STATUS),
    Family("mockmvc", "mockmvc.header_assertion", under(f"{_SERVLET}result.", "HeaderResultMatchers CookieResultMatchers"), default=HEADER),
    Family("mockmvc", "mockmvc.body_assertion", under(f"{_SERVLET}result.", "ContentResultMatchers JsonPathResultMatchers ModelResultMatchers ViewResultMatchers RequestResultMatchers XpathResultMatchers FlashAttributeResultMatchers HandlerResultMatchers"), default=BODY),
    Family("webtestclient", "webtestclient.request_factory", _WEB + "WebTestClient", ((BUILDER, _BINDERS),), static=_WEB + "WebTestClient"),
    Family("webtestclient", "webtestclient.request_builder", _WEB + "WebTestClient", ((BUILDER, _WEB_BUILDERS),)),
    Family("webtestclient", "webtestclient.request_builder", _WEB_SPEC, ((BUILDER, _WEB_BUILDERS),), holds_path=True),
    Family("webtestclient", "webtestclient.request_executor", f"{_WEB}WebTestClient {_WEB_SPEC}", ((EVENT, _WEB_EVENTS),)),
    Family("webtestclient", "webtestclient.response_inspector", _WEB_RESPONSE, response=((INSPECTOR, "expectAll"),)),
    Family("webtestclient", "webtestclient.matcher_root", _WEB_RESPONSE, response=((MATCHER, "expectStatus expectHeader expectCookie expectBody expectBodyList"),)),
    Family("webtestclient", "webtestclient.response_extractor", f"{_WEB_RESPONSE} {_WEB_BODY} {under(_WEB, 'ExchangeResult EntityExchangeResult FluxExchangeResult')}", response=((EXTRACTOR, "returnResult consumeWith getResponseBody getResponseBodyContent getStatus getResponseHeaders getResponseCookies"),)),
    Family("webtestclient", "webtestclient.status_assertion", _WEB + "StatusAssertions", default=STATUS),
    Family("webtestclient", "webtestclient.header_assertion", under(_WEB, "HeaderAssertions CookieAssertions"), default=HEADER),
    Family("webtestclient", "webtestclient.body_assertion", _WEB_BODY, response=((MATCHER, "jsonPath xpath"), (EXTRACTOR, "returnResult consumeWith")), default=BODY),
    Family("webclient", "webclient.request", _WEBCLIENT + "WebClient", ((BUILDER, f"{_VERBS} method"),)),
    Family("webclient", "webclient.request", f"{nested(_WEBCLIENT + 'WebClient', _URI_SPECS)} {nested(_WEBCLIENT + 'DefaultWebClient', 'DefaultRequestHeadersUriSpec DefaultRequestBodyUriSpec DefaultRequestHeadersSpec DefaultRequestBodySpec')}", ((EVENT, "retrieve exchangeToMono exchangeToFlux exchange"), (BUILDER, f"{_SPEC_BUILDERS} bodyValue syncBody")), holds_path=True),
    Family("webclient", "webclient.request", _WEBCLIENT + "ExchangeFunction", ((EVENT, "exchange"),)),
    Family("rest-client", "rest-client.request", _RESTCLIENT + "RestClient", ((BUILDER, f"{_VERBS} method"),)),
    Family("rest-client", "rest-client.request", f"{nested(_RESTCLIENT + 'RestClient', _URI_SPECS)} {nested(_RESTCLIENT + 'DefaultRestClient', 'DefaultRequestBodyUriSpec')}", ((EVENT, "retrieve exchange exchangeForRequiredValue"), (BUILDER, f"{_SPEC_BUILDERS} attribute attributes apiVersion httpRequest")), holds_path=True),
    Family("java-httpclient", "java-httpclient.request", "java.net.http.HttpClient", ((EVENT, "send sendAsync"),)),
    Family("java-httpclient", "java-httpclient.request", "java.net.http.HttpRequest", ((BUILDER, "newBuilder"),), static="java.net.http.HttpRequest"),
    Family("java-httpclient", "java-httpclient.request", nested("java.net.http.HttpRequest", "Builder"), ((BUILDER, "uri header headers setHeader method get post put delete head"),), holds_path=True),
    Family("micronaut-client", "micronaut-client.request", under("io.micronaut.http.client.", "HttpClient BlockingHttpClient StreamingHttpClient"), ((EVENT, _MN_EVENTS), (BUILDER, "toBlocking"))),
    Family("micronaut-client", "micronaut-client.request", under("io.micronaut.http.", "HttpRequest MutableHttpRequest"), ((BUILDER, f"{_MN_FACTORY} {_MN_BUILDERS}"),), holds_path=True, static="io.micronaut.http.HttpRequest"),
    Family("okhttp", "okhttp.request", "okhttp3.Call", ((EVENT, "execute enqueue"),)),
    Family("okhttp", "okhttp.request", f"okhttp3.OkHttpClient {nested('okhttp3.Call', 'Factory')}", ((BUILDER, "newCall"),)),
    Family("okhttp", "okhttp.request", nested("okhttp3.Request", "Builder"), ((BUILDER, _OK_BUILDERS),), holds_path=True),
    Family("okhttp", "okhttp.request", "okhttp3.Request", ((BUILDER, "newBuilder"),), holds_path=True),
    Family("karate", "karate.request", "com.intuit.karate.Http io.karatelabs.http.Http", ((EVENT, "get post put patch delete method methodJson postJson putJson patchJson"), (BUILDER, "to url param path header contentType")), exact=True, holds_path=True),
    Family("pact", "pact.request", under("au.com.dius.pact.consumer.dsl.", "PactDslRequestWithoutPath PactDslRequestWithPath"), ((BUILDER, "method path query encodedQuery headers body bodyWithSingleQuotes withBinaryData"),)),
    Family("citrus", "citrus.request", under(_CITRUS, "HttpClientActionBuilder HttpServerActionBuilder"), ((EVENT, "request"), (BUILDER, "send"))),
    Family("citrus", "citrus.request", f"{nested(_CITRUS + 'HttpClientActionBuilder', 'HttpClientSendActionBuilder')} {nested(_CITRUS + 'HttpServerActionBuilder', 'HttpServerReceiveActionBuilder')} {_CITRUS_REQUESTS}", ((EVENT, f"request {_VERBS} trace"),)),
    Family("citrus", "citrus.request", _CITRUS_REQUESTS, ((BUILDER, "send method path uri queryParam header headers body contentType accept cookie"),), holds_path=True),
    Family("feign", "feign.request", "feign.Client feign.AsyncClient", ((EVENT, "execute"),)),
    Family("feign", "feign.request", "feign.RequestTemplate", ((BUILDER, "method uri query queries header headers body target append insert request"),), holds_path=True),
    Family("apache-httpclient", "apache-httpclient.request", _APACHE_EVENTS, ((EVENT, "execute executeHttp2 executeOpen"),), constructs=True),
    Family("apache-httpclient", "apache-httpclient.request", _APACHE_REQUESTS, ((BUILDER, _APACHE_BUILDERS),), constructs=True, holds_path=True),
    Family("jax-rs", "jaxrs-client.request", under(_JAXRS, "Client"), ((BUILDER, _JAXRS_TARGET),)),
    Family("jax-rs", "jaxrs-client.request", under(_JAXRS, "WebTarget"), ((BUILDER, _JAXRS_TARGET),), holds_path=True),
    Family("jax-rs", "jaxrs-client.request", under(_JAXRS, "Invocation"), ((EVENT, _JAXRS_EVENTS), (BUILDER, "header headers accept acceptEncoding acceptLanguage cookie cacheControl property")), holds_path=True),
    Family("jax-rs", "jaxrs-client.request", under(_JAXRS, "Invocation SyncInvoker AsyncInvoker RxInvoker CompletionStageRxInvoker"), ((EVENT, _JAXRS_EVENTS),)),
)

# Calls whose receiver's type isn't known, by the framework that the builders before them show.
RECEIVERLESS: tuple[tuple[str, str, str, str], ...] = (
    ("webtestclient", "webtestclient.request_executor", EVENT, _WEB_EVENTS),
    ("webtestclient", "webtestclient.request_builder", BUILDER, _WEB_BUILDERS),
    ("webclient", "webclient.request", EVENT, "retrieve exchange exchangeToMono exchangeToFlux"),
    ("webclient", "webclient.request", BUILDER, f"{_VERBS} method {_SPEC_BUILDERS} bodyValue syncBody"),
    ("rest-client", "rest-client.request", EVENT, "retrieve exchange exchangeForRequiredValue"),
    ("rest-client", "rest-client.request", BUILDER, f"{_VERBS} method {_SPEC_BUILDERS} attribute attributes apiVersion httpRequest"),
    ("java-httpclient", "java-httpclient.request", EVENT, "send sendAsync"),
    ("java-httpclient", "java-httpclient.request", BUILDER, "newBuilder uri header headers setHeader method get post put delete head"),
    ("micronaut-client", "micronaut-client.request", EVENT, _MN_EVENTS),
    ("micronaut-client", "micronaut-client.request", BUILDER, f"{_MN_FACTORY} {_MN_BUILDERS} toBlocking"),
    ("okhttp", "okhttp.request", EVENT, "execute enqueue"),
    ("okhttp", "okhttp.request", BUILDER, "newCall url addHeader header method get head post put patch delete"),
    ("rest-assured", "rest-assured.request_event", EVENT, f"{_VERBS} request"),
    ("rest-assured", "rest-assured.request_builder", BUILDER, _RA_BUILDERS),
    ("mockmvc", "mockmvc.request_executor", EVENT, "perform"),
    ("mockmvc", "mockmvc.request_builder", BUILDER, _MOCK_BUILDERS),
)

#: A method named after a verb, alone or with what it is for, sends that verb; so does a multipart request of the servlet tests.
_NAMED = re.compile(r"(get|post|put|delete|patch|head|options|trace)(?:for\w+|json)?")
#: Constructors of request classes that name a verb, and those that take it as an argument.
CONSTRUCTED = r"^Http(Get|Post|Put|Delete|Patch|Head|Options|Trace)$"
DYNAMIC = "SimpleHttpRequest"


def verb_of(family: str, method: str) -> str:
    """The verb that a method's name fixes in a family, else UNKNOWN."""
    if method == "multipart" and family == "mockmvc.request_factory":
        return "POST"
    m = _NAMED.fullmatch(method)
    return m[1].upper() if m else UNKNOWN


def receiver_rows(families: tuple[Family, ...] = FAMILIES) -> Iterator[tuple[int, str, str, int]]:
    """(rule, key, match, length): match is prefix, inside (a package, itself not included) or exact; keys are in lower case."""
    for i, f in enumerate(families):
        for name in dict.fromkeys(f.receivers.lower().split()):
            yield i, name.rstrip("."), "exact" if f.exact else "inside" if name.endswith(".") else "prefix", len(name)


def method_rows(families: tuple[Family, ...] = FAMILIES) -> Iterator[tuple[int, str, str | None, str | None, str]]:
    """(rule, method in lower case or *, request_role, response_role, verb)."""
    for i, f in enumerate(families):
        roles = {m.lower(): (role, None) for role, names in f.request for m in names.split()}
        roles |= {m.lower(): (None, role) for role, names in f.response for m in names.split()}
        for m, (asks, answers) in roles.items():
            yield i, m, asks, answers, verb_of(f.family, m) if asks else UNKNOWN
        if f.default:
            yield i, "*", None, f.default, UNKNOWN


def conflicts(families: tuple[Family, ...] = FAMILIES) -> list[tuple[str, str, list[str]]]:
    """(receiver, method, families in order) of what two rules answer differently, the first of which wins: what their order decides."""
    methods: dict[int, list[tuple]] = {}
    for rule, method, *roles in method_rows(families):
        methods.setdefault(rule, []).append((method, *roles))
    seen: dict[tuple, list[tuple]] = {}
    for rule, key, match, _ in receiver_rows(families):
        for method, *roles in methods.get(rule, []):
            seen.setdefault((key, match, method), []).append((families[rule].family, *roles))
    return sorted((key, method, [f for f, *_ in found]) for (key, _, method), found in seen.items() if len({tuple(x) for x in found}) > 1)


def rule_tables(spark: SparkSession, families: tuple[Family, ...] = FAMILIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, receivers, methods) as DataFrames: a few thousand fixed rows."""
    rules = spark.createDataFrame([(i, f.framework, f.family, f.constructs, f.holds_path) for i, f in enumerate(families)], "rule int, framework string, family string, constructs boolean, holds_path boolean")
    receivers = spark.createDataFrame(list(receiver_rows(families)), "rule int, key string, match string, length int")
    methods = spark.createDataFrame(list(method_rows(families)), "rule int, method string, request_role string, response_role string, verb string")
    return rules, receivers, methods


def simple_name(type_name: Column) -> Column:
    return F.regexp_extract(type_name, r"([^.$]*)$", 1)


def _met(names: DataFrame, receivers: DataFrame) -> DataFrame:
    """names (receiver_type) with each rule whose receivers match: rule, length."""
    low = F.lower("receiver_type")
    keyed = names.withColumn("_low", low).withColumn("key", F.explode(prefixes(F.col("_low"))))
    hit = keyed.join(F.broadcast(receivers), "key")  # the fixed table
    whole = F.col("key") == F.col("_low")
    return hit.filter((F.col("match") == "prefix") | ((F.col("match") == "inside") & ~whole) | ((F.col("match") == "exact") & whole)).drop("_low", "key", "match")


def resolve(calls: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """CLS-02/03/04: calls with framework, family, request_role, response_role and verb of the one rule that answers; null where none does.

    calls: receiver_type, method_name, is_constructor, and any other columns.  Distinct
    (receiver, method) pairs meet the table, and calls get the answers back by a join.
    Null and empty receivers have no rule; a null is_constructor is false; names compare in lower case.
    """
    rules, receivers, methods = rule_tables(calls.sparkSession, families)
    ctor = F.coalesce(F.col("is_constructor"), F.lit(False))
    pairs = calls.select("receiver_type", "method_name", ctor.alias("_c")).filter("receiver_type <> ''").distinct()
    met = _met(pairs, receivers).join(F.broadcast(rules), "rule").withColumn("_m", F.lower(F.coalesce("method_name", F.lit(""))))
    name = simple_name(F.col("receiver_type"))
    built = F.col("_c") & F.col("constructs") & (name.rlike(CONSTRUCTED) | (name == DYNAMIC))
    made = met.filter(built).select("receiver_type", "method_name", "_c", "rule", "length", "framework", "family", F.lit(BUILDER).alias("request_role"), F.lit(None).cast("string").alias("response_role"), F.coalesce(F.nullif(F.upper(F.regexp_extract(name, CONSTRUCTED, 1)), F.lit("")), F.lit(UNKNOWN)).alias("verb"), F.lit(3).alias("_s"))
    known = met.filter(~built).join(F.broadcast(methods), "rule").filter((F.col("method") == F.col("_m")) | (F.col("method") == "*"))
    said = known.select("receiver_type", "method_name", "_c", "rule", "length", "framework", "family", "request_role", "response_role", "verb", F.when(F.col("method") == "*", 1).otherwise(2).alias("_s"))
    rank = F.struct(-F.col("length"), -F.col("_s"), F.col("rule"))
    best = made.unionByName(said).groupBy("receiver_type", "method_name", "_c").agg(F.min_by(F.struct("framework", "family", "request_role", "response_role", "verb"), rank).alias("_r"))
    best = best.select(F.col("receiver_type").alias("_t"), F.col("method_name").alias("_n"), F.col("_c").alias("_k"), "_r.*")
    same = (F.col("receiver_type") == F.col("_t")) & F.col("method_name").eqNullSafe(F.col("_n")) & (ctor == F.col("_k"))
    return calls.join(best, same, "left").drop("_t", "_n", "_k")


def holds_path(names: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """CLS-06: receiver_type and holds_path of each distinct receiver that a rule names: the longest match decides, any of its rules may say yes."""
    rules, receivers, _ = rule_tables(names.sparkSession, families)
    met = _met(names.select("receiver_type").filter("receiver_type <> ''").distinct(), receivers).join(F.broadcast(rules), "rule")
    each = met.groupBy("receiver_type", "length").agg(F.bool_or("holds_path").alias("holds_path"))
    return each.groupBy("receiver_type").agg(F.max_by("holds_path", "length").alias("holds_path"))
