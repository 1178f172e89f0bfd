"""URL and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
RFC3986 = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ID = "{id}"

#: Segments that stand for one instance of a resource.
ID_SEGMENT = (
    r"^(?:[0-9]+"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9a-fA-F]{24}|[0-9a-fA-F]{32}"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
)
#: Texts that stand for a segment nobody could resolve.
UNRESOLVED = ("<dynamic>", "<unknown>", "<unresolved>")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a long expression stands in the plan one time, not at each use."""
    return F.get(F.transform(F.array(value), body), 0)


def url_part(url: str | Column, part: str) -> Column:
    """URL-01: scheme, authority, path, query or fragment; null where the authority's brackets don't pair. Templates such as {id} stay whole."""
    return let(_c(url), lambda u: _part(u, part))


def _part(u: Column, part: str) -> Column:
    g = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[part]
    authority = F.regexp_extract(u, RFC3986, 2)
    paired = authority.contains("[") == authority.contains("]")
    value = F.regexp_extract(u, RFC3986, g)
    if part == "scheme":
        value = F.lower(value)
    if part == "path":
        # ;parameters of the last segment are no part of the path
        value = F.regexp_replace(value, r";[^/]*$", "")
    return F.when(paired, value)


def hostname(url: str | Column) -> Column:
    """Host of the authority in lower case, without user, brackets and port; null if empty."""
    return _host(url_part(url, "authority"))


def _host(authority: Column) -> Column:
    def of(a: Column) -> Column:
        host = F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(a, r":[^:]*$", ""))
        return F.nullif(F.lower(host), F.lit(""))

    return let(F.regexp_replace(authority, r"^.*@", ""), of)


def is_local_host(host: str | Column) -> Column:
    """URL-02: localhost, *.localhost, and loopback, unspecified, private and link-local addresses."""

    def of(h: Column) -> Column:
        ip6 = h.rlike(r"^(?:::|::1|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)$")
        ip4 = h.rlike(r"^(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}$")
        parts = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
        return F.coalesce((h == "localhost") | h.endswith(".localhost") | ip6 | F.when(ip4, let(parts, _private)), F.lit(False))

    return let(F.lower(F.trim(_c(host))), of)


def _private(octets: Column) -> Column:
    """IPv4 ranges that are not global."""
    a, b, c, d = (F.get(octets, i) for i in range(4))
    out = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 198) & b.between(18, 19)) | (a >= 240)
    out = out | ((a == 192) & (b == 0) & ((c == 2) | ((c == 0) & ~d.isin(9, 10)))) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return (F.array_max(octets) <= 255) & out


def _split(url: Column) -> Column:
    """Struct of scheme, authority and path; null scheme where unparsable."""
    return F.struct(url_part(url, "scheme").alias("scheme"), url_part(url, "authority").alias("authority"), url_part(url, "path").alias("path"), url.alias("url"))


def is_external_url(url: str | Column) -> Column:
    """URL-03: an http(s) URL whose host is not local."""
    external = lambda x: x["scheme"].isin("http", "https") & let(_host(x["authority"]), lambda h: h.isNotNull() & ~is_local_host(h))
    return F.coalesce(let(_split(F.trim(_c(url))), external), F.lit(False))


def request_target(path: str | Column, bare_token_is_local: bool = False) -> Column:
    """URL-04: local, external or unknown."""

    def of(x: Column) -> Column:
        p, scheme = x["url"], x["scheme"]
        by_host = let(_host(x["authority"]), lambda h: F.when(h.isNull(), "unknown").when(is_local_host(h), "local").otherwise("external"))
        return (
            F.when(p.isNull() | (p == "") | scheme.isNull(), "unknown")
            .when(p.startswith("/"), "local")
            .when(scheme.isin("http", "https"), by_host)
            .when((x["authority"] != "") | (scheme != ""), "unknown")
            .when(F.lit(bare_token_is_local) | p.contains("/"), "local")
            .otherwise("unknown")
        )

    return let(_split(F.trim(_c(path))), of)


def query_names(path: str | Column) -> Column:
    """URL-05: distinct names of the query, blank values kept."""
    q = F.coalesce(url_part(path, "query"), F.lit(""))
    names = F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x: F.try_url_decode(F.regexp_extract(x, r"^([^=]*)", 1)))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def normalize_path(path: str | Column) -> Column:
    """URL-06: no query groups, scheme, host or query; one leading slash, no double or trailing slashes."""

    def of(x: Column) -> Column:
        inner, opaque = x["path"], F.regexp_replace(x["url"], r"[?#].*$", "")
        web = x["scheme"].isin("http", "https")
        out = F.when(x["scheme"].isNull(), opaque).when(inner != "", inner).when(web, "/").otherwise(opaque)
        out = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), out), r"/{2,}", "/"), r"(?<=.)/+$", "")
        return F.when(out == "", "/").otherwise(out)

    folded = lambda p: F.when(p.startswith("//"), F.regexp_replace(p, r"^/+", "/")).otherwise(p)
    return let(let(F.regexp_replace(F.trim(_c(path)), r"\{[?&#][^{}]*\}", ""), folded), lambda p: let(_split(p), of))


def join_paths(left: str | Column, right: str | Column) -> Column:
    """URL-07: class path and method path as one route."""
    a, b = normalize_path(left), normalize_path(right)
    return F.when(a == "/", b).when(b == "/", a).otherwise(normalize_path(F.concat(a, b)))


def _authority(url: Column) -> Column:
    scheme, host = url_part(url, "scheme"), url_part(url, "authority")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host))


def join_request_paths(base: str | Column, method: str | Column) -> Column:
    """URL-08: a client's target; an absolute method path wins, else the base keeps its authority."""
    b, m = F.trim(F.coalesce(_c(base), F.lit(""))), F.trim(F.coalesce(_c(method), F.lit("")))
    put = lambda a, p: F.when(normalize_path(p) == "/", a).otherwise(F.concat(a, normalize_path(p)))
    return (
        F.when((b == "") & (m == ""), "")
        .when(url_part(m, "scheme").isNull(), m)
        .when(_authority(m).isNotNull(), put(_authority(m), url_part(m, "path")))
        .when(url_part(b, "scheme").isNull(), F.concat(b, m))
        .when(_authority(b).isNotNull(), put(_authority(b), join_paths(url_part(b, "path"), m)))
        .otherwise(join_paths(b, m))
    )


def join_parts(left: str | Column, right: str | Column) -> Column:
    """URL-09: two parts with one slash between them."""
    a, b = F.coalesce(_c(left), F.lit("")), F.coalesce(_c(right), F.lit(""))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(F.rtrim(a, F.lit("/")), F.lit("/"), F.ltrim(b, F.lit("/"))))


def observed_path(path: str | Column) -> Column:
    """URL-10: struct of the normalised path (null if blank) and the target class."""
    p = _c(path)
    return F.struct(F.when(F.trim(p) != "", normalize_path(p)).alias("path"), request_target(p, True).alias("target"))


def segments(path: str | Column) -> Column:
    """URL-11: segments between slashes that stand outside braces (one level of nested braces)."""
    masked = F.regexp_replace(F.trim(_c(path), F.lit("/")), r"/(?=[^{}]*(?:\{[^{}]*\}[^{}]*)*\})", "\u0001")
    return F.transform(F.filter(F.split(masked, "/"), lambda x: x != ""), lambda x: F.translate(x, "\u0001", "/"))


def is_id_segment(segment: str | Column) -> Column:
    """URL-12: digits, a UUID, 24 or 32 hex digits, or an ISO date."""
    return F.trim(_c(segment)).rlike(ID_SEGMENT)


def normalize_segment(segment: Column) -> Column:
    """URL-13: {id} for templates, format specifiers and ids; null for wildcards and unresolved text; else itself."""
    s = F.trim(segment)
    return (
        F.when((s == "") | F.lower(s).isin(*UNRESOLVED), F.lit(None))
        .when(s.rlike(r"^\{\*[^{}]*\}$"), F.lit(None))
        .when(s.rlike(r"^\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}$"), ID)
        .when(s.rlike(r"^%(?:\d+\$)?\d*[sdxX]$"), ID)
        .when(s.contains("*") | s.contains("%"), F.lit(None))
        .when(s.startswith(":") & (F.length(s) > 1), ID)
        .when(s.startswith("${"), F.lit(None))
        .when(is_id_segment(s), ID)
        .otherwise(s)
    )


def normalize_request_path(path: str | Column) -> Column:
    """URL-14: the whole path with {id} segments; null for external, unparsable or unusable paths."""

    def of(x: Column) -> Column:
        web = x["scheme"].isin("http", "https") & (x["authority"] != "")
        inner = F.when(x["path"] != "", x["path"]).when(web, "/").otherwise(x["url"])
        inner = F.when(~web | is_local_host(_host(x["authority"])), inner)
        parts = F.transform(F.filter(F.split(F.trim(inner), "/"), lambda s: s != ""), normalize_segment)
        whole = let(parts, lambda ps: F.when(~F.exists(ps, lambda s: s.isNull()), F.concat(F.lit("/"), F.array_join(ps, "/"))))
        return F.when(x["scheme"].isNotNull() & (x["url"] != ""), whole)

    folded = lambda p: F.when(p.startswith("//"), F.regexp_replace(p, r"^/+", "/")).otherwise(p)
    return let(let(F.trim(_c(path)), folded), lambda p: let(_split(p), of))


def resource_key(normalized: str | Column) -> Column:
    """URL-15: the collection of a path: without one trailing /{id}."""
    n = _c(normalized)
    return F.when(n.endswith("/{id}"), F.substring(n, F.lit(1), F.length(n) - 5)).otherwise(n)


def strip_prefix(parts: Column, prefix: Column) -> Column:
    """URL-17: what follows a whole-segment prefix (arrays of segments); null if it doesn't lead."""
    n = F.size(prefix)
    rest = F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))
    return F.when((n > 0) & (F.size(parts) >= n) & (F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))) == prefix), F.concat(F.lit("/"), F.array_join(rest, "/")))


def strip_key_prefix(normalized: str | Column, prefix: str | Column) -> Column:
    """URL-16: the same on normalised paths; a prefix that is / or has an id is none."""
    p = normalize_request_path(prefix)
    return F.when(p.isNotNull() & (p != "/") & ~p.contains(ID), strip_prefix(segments(normalized), segments(p)))


def route_depth(template: str | Column) -> Column:
    """URL-18: number of segments."""
    return F.size(segments(template)).cast("long")


def template_variables(template: str | Column) -> Column:
    """URL-19/20: names in braces, in order and distinct, without constraints and catch-all stars; query groups have none."""
    found = F.regexp_extract_all(_c(template), F.lit(r"\{([^{}?&#][^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"), 1)
    names = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^([^:]*)", 1), r"^\*", "")))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def query_template_names(template: str | Column) -> Column:
    """URL-21: names in {?a,b} and {&c}; aggregates (a*) are no names, :prefix lengths go."""
    groups = F.regexp_extract_all(_c(template), F.lit(r"\{[?&]([^{}]*)\}"), 1)
    names = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x))
    names = F.transform(F.filter(names, lambda x: (x != "") & ~x.endswith("*")), lambda x: F.trim(F.regexp_extract(x, r"^([^:]*)", 1)))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def optional_segments(template: str | Column) -> Column:
    """URL-22: a template with {/var} as the two it stands for; explode the array."""
    t = _c(template)
    with_ = F.regexp_replace(t, r"\{/([^{}]*)\}", "/{$1}")
    without = F.regexp_replace(t, r"\{/[^{}]*\}", "")
    return F.array_distinct(F.array(without, with_))


def remote_identity(url: str | Column) -> Column:
    """URL-23: struct of host and repository of a git remote, credentials dropped."""
    u = F.regexp_replace(F.trim(_c(url)), r"(?:\.git)?/*$", "")
    scp = r"^(?:[^@/]+@)?([^:/]+):(?!//)(.+)$"
    web = r"^[a-z+]+://(?:[^@/]*@)?([^:/]+)(?::\d+)?/(.+)$"
    pick = lambda i: F.when(u.rlike(web), F.regexp_extract(u, web, i)).when(u.rlike(scp), F.regexp_extract(u, scp, i))
    return F.struct(F.lower(pick(1)).alias("host"), pick(2).alias("repository"))


def in_test_directory(file: str | Column, directories: list[str]) -> Column:
    """URL-24: the file lies under one of the directories."""
    f = F.concat(F.lit("/"), F.regexp_replace(_c(file), r"\\", "/"))
    out = F.lit(False)
    for d in directories:
        out = out | f.contains("/" + d.strip("/") + "/")
    return out


def test_scope_rule(file: str | Column) -> Column:
    """URL-25: which rule makes a file test code: its source set, a test directory, or its name; null if none."""
    f = _c(file)
    return (
        F.when(f.rlike(r"(?:^|/)src/[A-Za-z]*[tT]est[A-Za-z]*/"), "source-set")
        .when(f.rlike(r"(?:^|/)(?:test|tests|it|integration-test|integrationTest)/"), "test-directory")
        .when(f.rlike(r"(?:^|/)(?:Test[A-Z0-9_][^/]*|[^/]*(?:Test|Tests|TestCase|IT))\.java$"), "file-name")
    )


def is_relative_path(text: str | Column, need_separator: bool = True) -> Column:
    """URL-26: text that may stand for a path: no blanks, no scheme, no markup, and a separator unless told otherwise."""
    t = F.trim(_c(text))
    plain = (t != "") & ~t.rlike(r"[\s<>\"]") & (url_part(t, "scheme") == "") & ~t.startswith("#")
    return F.coalesce(plain & (t.contains("/") if need_separator else F.lit(True)), F.lit(False))
