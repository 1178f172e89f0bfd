"""Endpoint extraction from annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitestat.functions.lineage import cut
from suitestat.functions.urls import join_paths, normalize_path, template_variables
from suitestat.operators.graph import inherited

#: Mapping annotations and their verbs (an empty verb: the annotation says).
MAPPINGS = {
    "GetMapping": ("spring", "GET"), "PostMapping": ("spring", "POST"), "PutMapping": ("spring", "PUT"), "DeleteMapping": ("spring", "DELETE"), "PatchMapping": ("spring", "PATCH"), "RequestMapping": ("spring", ""),
    "GET": ("jax-rs", "GET"), "POST": ("jax-rs", "POST"), "PUT": ("jax-rs", "PUT"), "DELETE": ("jax-rs", "DELETE"), "PATCH": ("jax-rs", "PATCH"), "HEAD": ("jax-rs", "HEAD"), "OPTIONS": ("jax-rs", "OPTIONS"),
    "Get": ("micronaut", "GET"), "Post": ("micronaut", "POST"), "Put": ("micronaut", "PUT"), "Delete": ("micronaut", "DELETE"), "Patch": ("micronaut", "PATCH"),
}
#: Parameter annotations and the source they bind.
SOURCES = {"PathVariable": "path", "PathParam": "path", "RequestParam": "query", "QueryParam": "query", "QueryValue": "query", "RequestHeader": "header", "HeaderParam": "header", "Header": "header", "RequestBody": "body", "Body": "body", "FormParam": "form", "RequestPart": "form"}


def annotation_name(text: str | Column) -> Column:
    """SYM-04: short name of an annotation's text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(t, r"^@?(?:[\w$]+[.$])*([\w]+)", 1)


def annotation_body(text: str | Column) -> Column:
    """SYM-04: what stands in its parentheses."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(t, r"(?s)^[^(]*\((.*)\)\s*$", 1)


def paths(body: Column) -> Column:
    """EXT-02: quoted paths of an annotation body, of value and path members where members are named; one empty path if none is given."""
    member = F.regexp_extract(body, r'(?:^|[\s,])(?:value|path)\s*=\s*(\{[^}]*\}|"[^"]*")', 1)
    source = F.when(member != "", member).when(~body.rlike(r"^\s*\w+\s*="), body).otherwise("")
    found = F.regexp_extract_all(source, F.lit(r'"([^"]*)"'), 1)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def verbs(name: Column, body: Column) -> Column:
    """EXT-03: verbs of a mapping: its own, those it names, or UNKNOWN for any verb."""
    own = F.element_at(F.create_map(*[F.lit(x) for k, (_, v) in MAPPINGS.items() for x in (k, v)]), name)
    named = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b(GET|HEAD|POST|PUT|PATCH|DELETE|OPTIONS|TRACE)\b"), 1))
    return F.when(own != "", F.array(own)).when(F.size(named) > 0, named).otherwise(F.array(F.lit("UNKNOWN")))


def endpoints(methods: DataFrame, class_annotations: DataFrame) -> DataFrame:
    """EXT-01/05..07/18: verbs x class paths x method paths of every mapped method.

    The method paths of JAX-RS stand in @Path annotations of their own.  methods: class_name, method_signature, annotation (text); class_annotations:
    class_name, annotation (text) of classes that serve.
    """
    m = methods.withColumn("_n", annotation_name("annotation")).withColumn("_b", annotation_body("annotation"))
    kinds = methods.sparkSession.createDataFrame([(k, f) for k, (f, _) in MAPPINGS.items()], "_n string, framework string")
    m = m.join(F.broadcast(kinds), "_n")  # a fixed list of annotations
    base = class_annotations.filter(annotation_name("annotation").isin("RequestMapping", "Path", "Controller")).select("class_name", F.explode(paths(annotation_body("annotation"))).alias("class_path"))
    rows = m.join(base, "class_name", "left").withColumn("class_path", F.coalesce("class_path", F.lit("")))
    rows = rows.withColumn("http_method", F.explode(verbs(F.col("_n"), F.col("_b"))))
    own = methods.filter(annotation_name("annotation") == "Path").select("class_name", "method_signature", F.explode(paths(annotation_body("annotation"))).alias("_path"))
    own = own.groupBy("class_name", "method_signature").agg(F.collect_set("_path").alias("_paths"))
    rows = rows.join(own, ["class_name", "method_signature"], "left")
    rows = rows.withColumn("_p", F.explode(F.when(F.col("framework") == "jax-rs", F.coalesce("_paths", F.array(F.lit("")))).otherwise(paths(F.col("_b")))))
    wild = (F.col("http_method") == "UNKNOWN") & (F.col("_n") == "RequestMapping")
    return rows.select("class_name", "method_signature", "framework", "http_method", wild.alias("is_method_wildcard"), join_paths("class_path", "_p").alias("path_template")).distinct()


def is_server(class_annotations: DataFrame) -> DataFrame:
    """EXT-04: classes with a controller annotation and no client annotation."""
    n = class_annotations.withColumn("_n", annotation_name("annotation"))
    serve = n.filter(F.col("_n").isin("RestController", "Controller", "Path")).select("class_name").distinct()
    return serve.join(n.filter(F.col("_n").isin("FeignClient", "HttpExchange", "RegisterRestClient", "Client")), "class_name", "left_anti")


def mounts(locators: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """EXT-08/23: (class_name, mount): class paths carried along sub-resource edges.

    roots: class_name, mount; locators: class_name, path, target.  Each round follows one
    edge more, until nothing is new; a class reached by several ways has several mounts.
    A way that comes to a class again ends there.  Raises if max_depth rounds don't do.
    Locators grow with the classes, so they aren't broadcast.
    """
    front = roots.select("class_name", normalize_path("mount").alias("mount")).distinct().withColumn("_seen", F.array("class_name"))
    out = front
    for _ in range(max_depth):
        nxt = front.join(locators.hint("merge"), "class_name").filter(~F.array_contains("_seen", F.col("target")))
        front = cut(nxt.select(F.col("target").alias("class_name"), join_paths("mount", "path").alias("mount"), F.concat("_seen", F.array("target")).alias("_seen")).distinct())
        if front.isEmpty():
            return out.select("class_name", "mount").distinct()
        out = out.unionByName(front)
    raise RuntimeError(f"mounts did not settle in {max_depth} rounds")


def nearest_mapping(ancestors: DataFrame, mapped: DataFrame) -> DataFrame:
    """EXT-09/20/22: of each class and signature, the mapping of the nearest supertype that has one."""
    m = ancestors.join(mapped.withColumnRenamed("class_name", "ancestor"), "ancestor")
    return m.groupBy("child", "method_signature").agg(F.min_by(F.struct("ancestor", "annotation"), F.struct("depth", "ancestor")).alias("_m")).select(F.col("child").alias("class_name"), "method_signature", "_m.ancestor", "_m.annotation")


def parameters(declared: DataFrame) -> DataFrame:
    """EXT-10/11/12: source, name and whether it is required, of annotated parameters.

    declared: class_name, method_signature, java_name, java_type, annotation (text).
    """
    name, body = annotation_name("annotation"), annotation_body("annotation")
    source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), name)
    given = F.regexp_extract(body, r'(?:^\s*|(?:value|name)\s*=\s*)"([^"]*)"', 1)
    optional = body.rlike(r"required\s*=\s*false|defaultValue\s*=") | F.col("java_type").rlike(r"^(?:java\.util\.)?Optional\b")
    d = declared.withColumn("source", source).filter("source is not null").withColumn("name", F.when(given != "", given).otherwise(F.col("java_name")))
    is_map = F.col("java_type").rlike(r"Map\b")
    return d.withColumn("required", (F.col("source") == "path") | ~optional).withColumn("is_aggregate", (F.col("source") == "query") & (given == "") & is_map)


def reconcile_paths(endpoints_: DataFrame, params: DataFrame) -> DataFrame:
    """EXT-14: path parameters follow the template: missing ones are added, foreign ones dropped; others stay."""
    keys = ["class_name", "method_signature"]
    truth = endpoints_.select(*keys, F.explode(template_variables("path_template")).alias("name")).distinct()
    path = truth.select(*keys, "name", F.lit("path").alias("source"), F.lit(True).alias("required"))
    return params.filter("source <> 'path'").select(*keys, "name", "source", "required").unionByName(path)


def constraint_parameters(methods: DataFrame) -> DataFrame:
    """EXT-13: parameters that a mapping's params and headers demand: "a", "a=b"; not "!a"."""
    body = annotation_body("annotation")
    out = None
    for member, source in (("params", "query"), ("headers", "header")):
        text = F.regexp_extract(body, member + r'\s*=\s*(\{[^}]*\}|"[^"]*")', 1)
        names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r'"([^"]*)"'), 1), lambda x: F.trim(F.regexp_extract(x, r"^([^=!<>]*)", 1))), lambda x: x != "")
        rows = methods.select("class_name", "method_signature", F.explode(F.array_distinct(names)).alias("name"), F.lit(source).alias("source"), F.lit(True).alias("required"))
        out = rows if out is None else out.unionByName(rows)
    return out


def application_prefixes(class_annotations: DataFrame) -> DataFrame:
    """EXT-17: application-level mounts, the root left out."""
    a = class_annotations.filter(annotation_name("annotation") == "ApplicationPath")
    return a.select(F.explode(paths(annotation_body("annotation"))).alias("p")).select(normalize_path("p").alias("prefix")).filter("prefix <> '/'").distinct()


def client_kind(class_annotations: DataFrame) -> DataFrame:
    """EXT-19: (class_name, kind, base): which client family an interface is, and its base path or URL."""
    n, b = annotation_name("annotation"), annotation_body("annotation")
    kind = F.when(n == "FeignClient", "feign").when(n == "HttpExchange", "http-interface").when(n == "Client", "micronaut-client").when(n == "RegisterRestClient", "rest-client")
    url = F.regexp_extract(b, r'\b(?:url|baseUri)\s*=\s*"([^"]*)"', 1)
    base = F.when(url != "", url).otherwise(F.get(paths(b), 0))
    return class_annotations.withColumn("kind", kind).filter("kind is not null").select("class_name", "kind", base.alias("base"))


def inherited_parameter_annotations(ancestors: DataFrame, annotations: DataFrame) -> DataFrame:
    """EXT-21: annotations of each parameter, those of the concrete method before its supertypes', each name once.

    annotations: class_name, method_signature, pos, short_name, annotation.
    """
    a = inherited(ancestors, annotations)
    return a.groupBy(F.col("child").alias("class_name"), "method_signature", "pos", "short_name").agg(F.min_by("annotation", F.struct("depth", "ancestor")).alias("annotation"), F.min("depth").alias("depth"))


def body_parameters(parameters_: DataFrame, methods: DataFrame) -> DataFrame:
    """EXT-15: the lone parameter without a binding of a method whose verb may carry a body is the body.

    parameters_: class_name, method_signature, java_name, source (null: unbound), is_context; methods: class_name, method_signature, http_method.
    """
    keys = ["class_name", "method_signature"]
    free = parameters_.filter("source is null and not is_context")
    lone = free.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("java_name").alias("name")).filter("_n = 1")
    taken = parameters_.filter("source in ('body', 'form')").select(*keys).distinct()
    able = methods.filter(F.col("http_method").isin("POST", "PUT", "PATCH")).select(*keys).distinct()
    return lone.join(able, keys, "left_semi").join(taken, keys, "left_anti").select(*keys, "name", F.lit("body").alias("source"), F.lit(True).alias("required"))


def bean_parameters(beans: DataFrame, fields: DataFrame, max_depth: int = 1000) -> DataFrame:
    """EXT-16: fields of bean parameters as parameters, through beans within beans; a type without fields is one row that can't be scored.

    Raises if max_depth rounds don't do.  beans: class_name, method_signature, type; fields: type, name, source, bean (the field's bean type or null).
    The fields climb from each type to the types that hold it, each once a type, so work
    grows with the result and not with the paths between beans; cycles end.
    """
    f = fields.select("type", "name", "source", "bean")
    held = f.filter("bean is not null").select(F.col("type").alias("_holder"), F.col("bean").alias("type")).distinct()
    row = ["name", "source", "is_unscorable"]
    shown = [F.coalesce("name", "type").alias("name"), F.coalesce("source", F.lit("query")).alias("source"), F.col("name").isNull().alias("is_unscorable")]
    bare = beans.select("type").unionByName(held.select("type")).distinct().join(f.select("type"), "type", "left_anti")
    out = now = cut(f.filter("bean is null").select("type", *shown).unionByName(bare.select("type", F.col("type").alias("name"), F.lit("query").alias("source"), F.lit(True).alias("is_unscorable"))).distinct())
    for _ in range(max_depth):
        up = now.join(held, "type").select(F.col("_holder").alias("type"), *row).distinct()
        # Rows are never null but for a type that is null, and such a type has no holder.
        now = cut(up.join(out, ["type", *row], "left_anti"))
        if now.isEmpty():
            b = beans.select("class_name", "method_signature", F.col("type").alias("_t"))
            return b.join(out, F.col("_t").eqNullSafe(F.col("type"))).select("class_name", "method_signature", *row).distinct()
        out = out.unionByName(now)
    raise RuntimeError(f"beans did not settle in {max_depth} rounds")


#: Header constants by name.
HEADER_CONSTANTS = {"AUTHORIZATION": "Authorization", "CONTENT_TYPE": "Content-Type", "ACCEPT": "Accept", "IF_MATCH": "If-Match", "IF_NONE_MATCH": "If-None-Match", "ETAG": "ETag", "LOCATION": "Location", "USER_AGENT": "User-Agent", "ACCEPT_LANGUAGE": "Accept-Language", "CACHE_CONTROL": "Cache-Control", "COOKIE": "Cookie", "ORIGIN": "Origin", "HOST": "Host"}


def header_constants(names: DataFrame, imports: DataFrame, classes: tuple[str, ...] = ("HttpHeaders",)) -> DataFrame:
    """EXT-24: header text of constants such as HttpHeaders.ACCEPT where the class imports the holder. names: class_name, identifier; imports: class_name, path."""
    table = names.sparkSession.createDataFrame(list(HEADER_CONSTANTS.items()), "constant string, header string")
    n = names.withColumn("holder", F.regexp_extract("identifier", r"^(\w+)\.", 1)).withColumn("constant", F.regexp_extract("identifier", r"\.(\w+)$", 1)).filter(F.col("holder").isin(*classes))
    held = imports.select("class_name", F.regexp_extract("path", r"([^.]+)$", 1).alias("holder")).distinct()
    return n.join(held, ["class_name", "holder"], "left_semi").join(F.broadcast(table), "constant").select("class_name", "identifier", "header")  # a fixed list
