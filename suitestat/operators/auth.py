"""SEQ-23: how a test handles authentication, from its annotations, routes, headers and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitestat.operators.labels import AUTH_ORDER

# Annotations, packages and methods of security libraries.
MOCKED_ANNOTATIONS = ("WithMockUser", "WithUserDetails")
BYPASS_ANNOTATIONS = ("WithAnonymousUser", "PermitAll")
SECURITY_WORDS = "user securitycontext mock oidc oauth jwt principal authentication login role anonymous credential identity"
ROUTE_WORDS = "oauth login token auth"
CREDENTIAL_WORDS = "authorization bearer basic x-api-key"
SECURITY_TEST = "org.springframework.security.test."
POST_PROCESSORS = SECURITY_TEST + "web.servlet.request.SecurityMockMvcRequestPostProcessors"
AUTH_ONLY = "org.springframework.security.authentication. org.springframework.security.oauth2. org.keycloak. com.okta. com.auth0."
#: (label, receivers, methods): receivers that end with a dot are packages.
CALLS: tuple[tuple[str, str, str], ...] = (
    ("mocked", SECURITY_TEST, "withMockUser oauth2Login jwt oidcLogin oauth2Client mockUser mockJwt mockOAuth2Login mockOidcLogin mockOAuth2Client"),
    ("mocked", POST_PROCESSORS, "authentication jwt opaqueToken oauth2Client oauth2Login oidcLogin securityContext testSecurityContext user x509"),
    ("bypassed", POST_PROCESSORS, "anonymous"),
    ("test-token", "io.restassured. com.jayway.restassured.", "bearerToken oauth2 oauth basic digest ntlm form certificate"),
    ("test-token", "org.springframework.boot.test.web.client.", "withBasicAuth"),
    ("test-token", "org.springframework.http.", "setBearerAuth setBasicAuth"),
    ("test-token", POST_PROCESSORS, "digest httpBasic"),
    ("real-flow", AUTH_ONLY, "authenticate login authorize"),
)
#: Methods that only a mocked login has, whatever they are called on.
MOCKED_ANYWHERE = "withMockUser oauth2Login oidcLogin oauth2Client mockOAuth2Login mockOidcLogin mockOAuth2Client"


def _on(receiver: Column, names: str) -> Column:
    out = F.lit(False)
    for n in names.split():
        out = out | (receiver.startswith(n) if n.endswith(".") else (receiver == n) | receiver.startswith(n + ".") | receiver.startswith(n + "$"))
    return out


def _any_word(text: Column, words: str) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words.split()]), lambda w: text.contains(w))


def call_signals(receiver: Column, name: Column) -> Column:
    """array<struct<label, signal>> of one call: what it is recognised as, or unknown for another method of an auth-only package."""
    said = F.concat(F.lit("call-site:receiver:"), receiver, F.lit("."), name)
    of = lambda label: [_on(receiver, r) & name.isin(*m.split()) for kind, r, m in CALLS if kind == label]
    row = lambda label, signal: F.struct(F.lit(label).alias("label"), signal.alias("signal"))
    found = []
    for label in ("mocked", "bypassed", "test-token", "real-flow"):
        hit = F.lit(False)
        for rule in of(label):
            hit = hit | rule
        signal = F.when(hit, said)
        if label == "mocked":
            signal = signal.when(name.isin(*MOCKED_ANYWHERE.split()), F.concat(F.lit("method:"), name))
        found.append(row(label, signal))
    return F.filter(F.array(*found), lambda x: x["signal"].isNotNull())


def auth_signals(events: DataFrame) -> DataFrame:
    """(test_id, label, signal) of classified calls: test_id, request_role, path, headers, auth_hints, receiver_type, method_name.

    An event's route that holds a word for login is a real flow; a request's credentials are
    a test token; calls on security libraries say what their tables say.  A call of an
    auth-only package that nothing else explains is weak evidence of unknown handling.  Nulls say nothing.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    receiver, name, path = blank("receiver_type"), blank("method_name"), blank("path")
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(F.lower(path), F.lit("[a-z]+"), 0)
    route = (F.col("request_role") == "event") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in ROUTE_WORDS.split()]))
    given = F.lower(F.array_join(F.coalesce("headers", none), " "))
    credentials = F.col("request_role").isNotNull() & ((F.size(F.coalesce("auth_hints", none)) > 0) | _any_word(given, CREDENTIAL_WORDS))
    of_request = F.filter(
        F.array(F.struct(F.lit("real-flow").alias("label"), F.when(route, F.concat(F.lit("route:"), path)).alias("signal")), F.struct(F.lit("test-token").alias("label"), F.when(credentials, "header:authorization").alias("signal"))),
        lambda x: x["signal"].isNotNull(),
    )
    strong = F.concat(of_request, call_signals(receiver, name))
    weak = F.array(F.struct(F.lit("unknown").alias("label"), F.concat(F.lit("weak:auth-receiver:"), receiver, F.lit("."), name).alias("signal")))
    signals = F.when((F.size(strong) == 0) & _on(receiver, AUTH_ONLY), weak).otherwise(strong)
    return events.select("test_id", F.explode(signals).alias("s")).select("test_id", "s.label", "s.signal")


def annotation_signals(annotations: DataFrame) -> DataFrame:
    """(test_id, label, signal) of annotations that imports confirm: test_id, annotation (text).

    Another @With... annotation that names a security context is weak evidence of unknown handling.
    """
    simple = F.regexp_extract(F.regexp_replace("annotation", r"^@+", ""), r"([^.(]*)\s*(?:\(.*)?$", 1)
    low = F.lower(F.trim(simple))
    strong = [n.lower() for n in (*MOCKED_ANNOTATIONS, *BYPASS_ANNOTATIONS)]
    weak = low.startswith("with") & (F.length(low) > 4) & ~low.isin(*strong) & _any_word(low, SECURITY_WORDS)
    label = F.when(low.isin(*[n.lower() for n in MOCKED_ANNOTATIONS]), "mocked").when(low.isin(*[n.lower() for n in BYPASS_ANNOTATIONS]), "bypassed").when(weak, "unknown")
    signal = F.concat(F.when(label == "unknown", "weak:annotation:").otherwise("annotation:"), F.col("annotation"))
    return annotations.select("test_id", label.alias("label"), signal.alias("signal")).filter("label is not null")


def auth_handling(tests: DataFrame, events: DataFrame, annotations: DataFrame) -> DataFrame:
    """(test_id, label, signals): the strongest label that a test has evidence for, none without any, and all its signals.

    signals: array<struct<label, signal, n>>, by strength and signal; signals combine before tests meet them.
    """
    found = auth_signals(events).unionByName(annotation_signals(annotations)).groupBy("test_id", "label", "signal").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in AUTH_ORDER]), F.col("label"))
    per = found.groupBy("test_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "signal", "label", "n"))).alias("_s"))
    kind = "array<struct<label:string,signal:string,n:bigint>>"
    signals = F.transform("_s", lambda x: F.struct(x["label"].alias("label"), x["signal"].alias("signal"), x["n"].alias("n")))
    return tests.join(per, "test_id", "left").select("test_id", F.coalesce(F.get("_s", F.lit(0))["label"], F.lit("none")).alias("label"), F.coalesce(signals, F.array().cast(kind)).alias("signals"))
