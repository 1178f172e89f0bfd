"""Nested project documents, their audits, run logs, and result sinks; facts.py has the tables that are read out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from suitestat.functions.lineage import cut
from suitestat.sources.schema import PROJECT_DDL

FILE_NAME = "suite.json"
CORRUPT = "_corrupt"


def project_schema() -> StructType:
    return StructType.fromDDL(PROJECT_DDL)


def discover(spark: SparkSession, root: str, name: str = FILE_NAME) -> DataFrame:
    """SRC-01: paths of the documents below a root, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select("path").orderBy("path")


def read_text(spark: SparkSession, root: str, name: str = FILE_NAME) -> DataFrame:
    """(path, json): each document as one text."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def parse(texts: DataFrame, schema: StructType | None = None, json: str = "json") -> DataFrame:
    """SRC-02/03: texts with doc (the document) and error (null for the good ones).

    doc comes out of a generator, through which Spark pushes no filter, so a text is made
    and parsed once and not again for each condition on doc.
    """
    full = StructType([*(schema or project_schema()).fields]).add(CORRUPT, "string")
    doc = F.from_json(json, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = texts.select(*[c for c in texts.columns if c != "doc"], F.explode_outer(F.array(doc)).alias("doc"))
    is_object = F.ltrim(F.col(json)).startswith("{")
    error = F.when(F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull(), "not valid JSON of the schema").when(~is_object, "not a JSON object")
    return out.withColumn("error", error)


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null")


def quarantine(parsed: DataFrame, *keys: str) -> DataFrame:
    """SRC-03: keys and errors of documents that can't be used."""
    return parsed.filter("error is not null").select(*keys, "error")


# ---- audits: a document as rows of (instance, path)


def declared(schema: StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path of the object, key) of every field of a schema; elements of arrays have the array's path, and maps no keys of their own."""
    out: list[tuple[str, str]] = []
    for f in schema.fields:
        out.append((prefix, f.name))
        t = f.dataType
        while isinstance(t, ArrayType):
            t = t.elementType
        if isinstance(t, StructType):
            out += declared(t, f"{prefix}.{f.name}".lstrip("."))
        del t
    return out


def maps(schema: StructType, prefix: str = "") -> list[str]:
    """Paths of maps, whose keys are data."""
    out: list[str] = []
    for f in schema.fields:
        t, here = f.dataType, f"{prefix}.{f.name}".lstrip(".")
        while isinstance(t, ArrayType):
            t = t.elementType
        if isinstance(t, MapType):
            out.append(here)
        elif isinstance(t, StructType):
            out += maps(t, here)
    return out


def depth(schema: StructType) -> int:
    """Levels of objects and arrays, which bounds the explode loop."""

    def of(t) -> int:
        if isinstance(t, StructType):
            return 1 + max((of(f.dataType) for f in t.fields), default=0)
        return 1 + of(t.elementType) if isinstance(t, ArrayType) else 0

    return of(schema)


def nodes(texts: DataFrame, key: str, json: str, levels: int | None = None) -> DataFrame:
    """(key, parent, within, name, instance, path, is_object, scalar): every value of the documents.

    parent is the instance (with array positions) that holds it and path its dotted
    path without positions; elements of arrays have the array's name.  One walk: a level
    is written once, with what its objects and arrays hold, and the next is read from
    it; a text is parsed once.  The walk ends below the deepest value, or after levels.
    A null or broken text has no values.
    """
    now = texts.select(F.col(key).alias("doc_key"), F.lit("$").alias("instance"), F.lit("").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    out, level = None, 0
    while True:
        now = now.lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e")).select("doc_key", F.col("instance").alias("parent"), F.col("path").alias("within"), F.col("e.key").alias("name"), F.concat_ws(".", "instance", F.coalesce("e.key", F.col("e.pos").cast("string"))).alias("instance"), F.when(F.col("e.key").isNull(), F.col("path")).when(F.col("path") == "", F.col("e.key")).otherwise(F.concat_ws(".", "path", "e.key")).alias("path"), F.col("e.value").alias("v"))
        kind = F.schema_of_variant("v")
        holds = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        wrote = cut(now.select(F.col("doc_key").alias("key"), "parent", "within", "name", "instance", "path", kind.startswith("OBJECT").alias("is_object"), F.when(~holds, F.try_variant_get("v", "$", "string")).alias("scalar"), F.when(holds, F.col("v")).alias("v")))
        row = wrote.drop("v")
        out = row if out is None else out.unionByName(row)
        level += 1
        inner = wrote.filter("v is not null")
        if (levels is not None and level > levels) or inner.isEmpty():
            return out
        now = inner.select(F.col("key").alias("doc_key"), "instance", "path", "v")


def missing_keys(texts: DataFrame, key: str, json: str, schema: StructType | None = None) -> DataFrame:
    """SRC-04: (key, path) of schema fields that an object of a document doesn't have.

    An object is compared with the schema where it stands, by its own keys. Only what may
    hold an object of the schema is followed: a level is written once, and the next one is
    read from it. A null or broken text lacks every field of a document.
    """
    schema = schema or project_schema()
    fields: dict[str, list[str]] = {}
    for within, name in declared(schema):
        fields.setdefault(within, []).append(name)
    wanted = F.create_map(*[x for within, names in fields.items() for x in (F.lit(within), F.array(*map(F.lit, names)))])
    now, out = texts.select(F.col(key).alias("doc_key"), F.lit("").alias("path"), F.try_parse_json(json).alias("v")), None
    while True:
        keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))  # null for what is no object
        keys = F.coalesce(keys, F.array().cast("array<string>")) if out is None else keys
        wrote = cut(now.select("doc_key", "path", F.array_except(F.element_at(wanted, F.col("path")), keys).alias("lacks"), "v"))
        row = wrote.filter(F.size("lacks") > 0).select(F.col("doc_key").alias("key"), F.col("path").alias("within"), "lacks")
        out = row if out is None else out.unionByName(row)
        if wrote.isEmpty():
            break
        held = wrote.filter("v is not null").select("doc_key", "path", "v").lateralJoin(texts.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e"))
        path = F.when(F.col("e.key").isNull(), F.col("path")).when(F.col("path") == "", F.col("e.key")).otherwise(F.concat_ws(".", "path", "e.key"))
        now = held.select("doc_key", path.alias("path"), F.col("e.value").alias("v")).filter(F.col("path").isin(*fields))
    gone = out.distinct().select("key", "within", F.explode("lacks").alias("name"))
    return gone.select("key", F.when(F.col("within") == "", F.col("name")).otherwise(F.concat_ws(".", "within", "name")).alias("path")).distinct()


def unknown_keys(texts: DataFrame, key: str, json: str, schema: StructType | None = None) -> DataFrame:
    """SRC-05: (key, path) of fields that the schema doesn't have; keys of maps are data."""
    schema = schema or project_schema()
    n = nodes(texts, key, json).filter("name is not null")
    spark = texts.sparkSession
    known = spark.createDataFrame(declared(schema), "within string, name string")
    out = n.join(F.broadcast(known), ["within", "name"], "left_anti")
    for m in maps(schema):
        out = out.filter((F.col("within") != m) & ~F.col("within").startswith(m + "."))
    return out.select("key", "path").distinct()


def enum_drift(texts: DataFrame, key: str, json: str, domains: dict[str, tuple[str, ...]], levels: int | None = None) -> DataFrame:
    """SRC-06: (key, path, value, n) of values outside a closed vocabulary."""
    spark = texts.sparkSession
    allowed = spark.createDataFrame([(p, v) for p, vs in domains.items() for v in vs], "path string, scalar string")
    rows = nodes(texts, key, json, levels).filter(F.col("path").isin(*domains) & F.col("scalar").isNotNull())
    return rows.join(F.broadcast(allowed), ["path", "scalar"], "left_anti").groupBy("key", "path", F.col("scalar").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def kind_mismatches(interactions: DataFrame) -> DataFrame:
    """SRC-07: rows whose payload isn't that of their kind: a request has only a request, a verification only a verification."""
    r, v = F.col("request").isNotNull(), F.col("verification").isNotNull()
    fits = F.when(F.col("kind") == "request", r & ~v).when(F.col("kind") == "verification", v & ~r).otherwise(False)
    return interactions.filter(~fits)


# ---- logs and reconciliation

LOG_LINE = r"^\[(\d+)/(\d+)\]\s+([A-Za-z_-]+):\s*(.+?)\s*$"


def run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-16: (number, total, status, project) of lines such as [3/20] ok: name."""
    g = lambda i: F.regexp_extract(column, LOG_LINE, i)
    return lines.filter(F.col(column).rlike(LOG_LINE)).select(g(1).cast("long").alias("number"), g(2).cast("long").alias("total"), F.lower(g(3)).alias("status"), g(4).alias("project"))


def reconcile(log: DataFrame, directories: DataFrame, results: DataFrame) -> DataFrame:
    """SRC-17/18: (project, finding): failed with a result, ok without a directory or without a result, directories that the log lacks. Each input has project; log has status."""
    failed, ok = log.filter("status <> 'ok'").select("project"), log.filter("status = 'ok'").select("project")
    say = lambda d, what: d.select("project", F.lit(what).alias("finding"))
    return (
        say(failed.join(results, "project", "left_semi"), "failed-with-result")
        .unionByName(say(ok.join(directories, "project", "left_anti"), "ok-without-directory"))
        .unionByName(say(ok.join(directories, "project", "left_semi").join(results, "project", "left_anti"), "ok-without-result"))
        .unionByName(say(directories.join(log, "project", "left_anti"), "directory-not-in-log"))
    )


def batch_outcome(log: DataFrame) -> DataFrame:
    """SRC-19: projects by status."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dataset_listing(tests_: DataFrame) -> DataFrame:
    """SRC-14: projects with an API test, with their number."""
    return tests_.groupBy("project_id").agg(F.count_if("is_api_test").alias("api_tests")).filter("api_tests > 0")


def relative_paths(df: DataFrame, root: str, *columns: str) -> DataFrame:
    """SRC-15: path columns relative to a root, or dropped where the root is empty."""
    if not root:
        return df.drop(*columns)
    head = "^" + "".join("\\" + ch if not ch.isalnum() and ch != "/" else ch for ch in root.rstrip("/")) + "/+"
    return df.withColumns({c: F.regexp_replace(c, head, "") for c in columns})


# ---- sinks and statistics sources


def write_statistics(statistics: dict[str, DataFrame], target: str) -> list[str]:
    """SRC-10: each statistic as JSON below its name; the names in order."""
    for name in sorted(statistics):
        statistics[name].write.mode("overwrite").json(f"{target}/{name}")
    return sorted(statistics)


def write_one(df: DataFrame, target: str) -> None:
    """SRC-11/12: a short report (a sample, an inventory) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(target)


def read_statistics(spark: SparkSession, root: str, name: str, baseline: str) -> DataFrame:
    """SRC-13: one statistic of every suite below a root, with suite, the baseline first."""
    d = spark.read.option("recursiveFileLookup", True).json(f"{root}/*/{name}")
    suite = F.regexp_extract(F.col("_metadata.file_path"), f"/([^/]+)/{name}/[^/]*$", 1)
    return d.withColumn("suite", suite).orderBy(F.col("suite") != baseline, "suite")
