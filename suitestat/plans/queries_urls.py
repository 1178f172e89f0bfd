"""URLs, templates and files of every kind: each page or part holds one case, with what a reader makes of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitestat.functions import urls as U
from suitestat.plans.registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(value):
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


def _values(rows):
    return ", ".join("(" + ", ".join([str(i), *map(_sql, r)]) + ")" for i, r in enumerate(rows))


def _cases(spark, sf_dir, table, key, rows):
    """Each row of a table with one of the cases; ~ stands for a number of the row."""
    at = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "piece long, x string")
    return _t(spark, sf_dir, table).select(key, (F.col(key) % len(rows)).alias("piece")).join(F.broadcast(at), "piece").select(key, F.replace("x", F.lit("~"), (F.col(key) % 89).cast("string")).alias("x"))  # a fixed list


def _told(table, key, rows, *columns):
    named = ", ".join(f"replace({c}, '~', CAST({key} % 89 AS VARCHAR)) AS {c}" if any(isinstance(r[i + 1], str) for r in rows) else c for i, c in enumerate(columns))
    return f"WITH v(piece, x, {', '.join(columns)}) AS (VALUES {_values(rows)}) SELECT {key}, {named} FROM {table} JOIN v ON v.piece = {key} % {len(rows)}"


#: (url, target, target of a bare token, external, local host, request path, after the base /api).
_TARGETS = (
    ("/items/~", "local", "local", False, False, "/items/{id}", "/api/items/~"),
    ("http://localhost:8080/items/~?q=1", "local", "local", False, True, "/items/{id}", "http://localhost:8080/items/~"),
    ("http://127.0.0.1/items", "local", "local", False, True, "/items", "http://127.0.0.1/items"),
    ("https://10.1.2.3/a//b/", "local", "local", False, True, "/a/b", "https://10.1.2.3/a/b"),
    ("https://api.example.com/items/~", "external", "external", True, False, None, "https://api.example.com/items/~"),
    ("ftp://files.example.com/a", "unknown", "unknown", False, False, "/a", None),
    ("items/~", "local", "local", False, False, "/items/{id}", "/api/items/~"),
    ("token", "unknown", "local", False, False, "/token", "/api/token"),
    ("", "unknown", "unknown", False, False, None, "/api"),
    ("http://[::1", "unknown", "unknown", False, False, None, "http://[::1"),
    ("/a/{name}/%s/:id/x", "local", "local", False, False, "/a/{id}/{id}/{id}/x", "/api/a/{name}/%s/:id/x"),
)


@query(_told("pages", "page_id", _TARGETS, "target", "bare", "external", "local_host", "request_path"))
def url_targets(spark, sf_dir):
    d = _cases(spark, sf_dir, "pages", "page_id", _TARGETS)
    return d.select("page_id", U.request_target("x").alias("target"), U.request_target("x", True).alias("bare"), F.coalesce(U.is_external_url("x"), F.lit(False)).alias("external"), F.coalesce(U.is_local_host(U.hostname("x")), F.lit(False)).alias("local_host"), U.normalize_request_path("x").alias("request_path"))


_JOINED = tuple((r[0], r[6]) for r in _TARGETS if r[6] is not None)


@query(_told("pages", "page_id", _JOINED, "joined"))
def url_client_targets(spark, sf_dir):
    d = _cases(spark, sf_dir, "pages", "page_id", _JOINED)
    return d.select("page_id", U.join_request_paths(F.lit("/api"), "x").alias("joined"))


#: (template, variables, query names, with and without its optional segment, key after the prefix /api/v1).
_TEMPLATES = (
    ("/api/v1/a/{id}", "id", "", "/api/v1/a/{id}", "/a/{id}"),
    ("/api/v1/{name:[a-z]{2}}/x/{*rest}", "name,rest", "", "/api/v1/{name:[a-z]{2}}/x/{*rest}", None),
    ("/b~{?page,size:3,all*}", "", "page,size", "/b~{?page,size:3,all*}", None),
    ("/c{/key}/d{&more}", "/key", "more", "/c/d{&more} /c/{key}/d{&more}", None),
    ("/{id}/{id}", "id", "", "/{id}/{id}", None),
)


@query(_told("part", "p_partkey", _TEMPLATES, "variables", "queries", "forms", "after"))
def url_templates(spark, sf_dir):
    d = _cases(spark, sf_dir, "part", "p_partkey", _TEMPLATES)
    d = d.withColumn("n", U.normalize_request_path("x"))
    key = U.strip_key_prefix("n", F.lit("/api/v1"))
    return d.select("p_partkey", F.array_join(U.template_variables("x"), ",").alias("variables"), F.array_join(U.query_template_names("x"), ",").alias("queries"), F.array_join(U.optional_segments("x"), " ").alias("forms"), key.alias("after"))


#: (file, rule, in one of the directories qa and src/it).
_FILES = (
    ("src/test/java/A~.java", "source-set", False), ("src/integrationTest/java/A.java", "source-set", False), ("a/tests/B~.java", "test-directory", False), ("src/it/C.java", "test-directory", True),
    ("main/FooTest.java", "file-name", False), ("main/TestFoo.java", "file-name", False), ("main/Testing.java", None, False), ("qa\\x\\D~.java", None, True), ("src/main/java/E.java", None, False), ("main/FooIT.java", "file-name", False),
)


@query(_told("part", "p_partkey", _FILES, "rule", "listed"))
def url_files(spark, sf_dir):
    d = _cases(spark, sf_dir, "part", "p_partkey", _FILES)
    return d.select("p_partkey", U.test_scope_rule("x").alias("rule"), U.in_test_directory("x", ["qa", "/src/it/"]).alias("listed"))


#: (remote, host, repository).
_REMOTES = (
    ("https://Git.example.com/team/r~.git", "git.example.com", "team/r~"), ("git@git.example.com:team/r~.git", "git.example.com", "team/r~"), ("ssh://me@git.example.com:2222/team/r/", "git.example.com", "team/r"), ("https://user:secret@h.example/a/b", "h.example", "a/b"), ("not a remote", None, None),
)


@query(_told("part", "p_partkey", _REMOTES, "host", "repository"))
def url_remotes(spark, sf_dir):
    d = _cases(spark, sf_dir, "part", "p_partkey", _REMOTES)
    return d.select("p_partkey", U.remote_identity("x").alias("r")).select("p_partkey", "r.host", "r.repository")


#: (annotations of a method, framework, verb, template): the class has the path /c.
_MAPPED = (
    ('@GET|@Path("/{id}")', "jax-rs", "GET", "/c/{id}"), ("@POST", "jax-rs", "POST", "/c"), ('@Get("/n~")', "micronaut", "GET", "/c/n~"), ('@Delete("/{id}")', "micronaut", "DELETE", "/c/{id}"),
    ('@PatchMapping(path = "/p~", produces = "x/y")', "spring", "PATCH", "/c/p~"), ("@RequestMapping(method = RequestMethod.HEAD)", "spring", "HEAD", "/c"), ('@HEAD|@Path("h")', "jax-rs", "HEAD", "/c/h"),
)


@query(_told("part", "p_partkey", _MAPPED, "framework", "http_method", "path_template"))
def ext_frameworks(spark, sf_dir):
    from suitestat.operators.extract import endpoints

    d = _cases(spark, sf_dir, "part", "p_partkey", _MAPPED)
    m = d.select("p_partkey", F.concat(F.lit("C"), (F.col("p_partkey") % 7).cast("string")).alias("class_name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_signature"), F.explode(F.split("x", r"\|")).alias("annotation"))
    kind = F.when(F.col("class_name").isin("C0", "C1", "C6"), '@Path("/c")').when(F.col("class_name").isin("C2", "C3"), '@Controller("/c")').otherwise('@RequestMapping("/c")')
    c = m.select("class_name").distinct().withColumn("annotation", kind)
    found = endpoints(m.drop("p_partkey"), c)
    return found.join(d.select("p_partkey", F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_signature")), "method_signature").select("p_partkey", "framework", "http_method", "path_template")
