"""SYM-36/37/38: the order in which a class's ancestors are asked, and lookups along it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suitestat.operators.ancestry import Answers, Group, gathered, groups

if TYPE_CHECKING:
    import pyarrow as pa


def _edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends, of one type, and a place."""
    kind = edges.select("class_name").unionAll(edges.select("parent")).schema[0].dataType
    ends = [F.col(c).cast(kind).alias(c) for c in ("class_name", "parent")]
    return edges.filter("parent is not null and class_name is not null").select(*ends, "kind", F.coalesce(F.col("place"), F.lit(0)).cast("long").alias("place"))


def resolution_order(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """SYM-38: (child, ancestor, position, relation): a class, its superclasses, the classes around it, then interfaces.

    edges: class_name, parent, kind (extends, implements, encloses: parent is the class around
    it) and place (order in the declaration).  Superclasses come level by level and in
    the order of their declarations; each enclosing class, the nearest first, is
    followed by its own superclasses; interfaces of all these follow level by level, in
    the order of their owners.  An ancestor counts where it is met first.  relation:
    class, super (superclasses and enclosing classes) or interface.  Null parents and
    edges that repeat don't count; cycles end; a class without edges has no row.  What
    stands above a group of classes comes to one task, which orders it for each of them:
    no pair of class and ancestor is shuffled.
    """
    e = _edges(edges)
    classes = e.select(F.col("class_name").alias("child")).unionByName(e.select(F.col("parent").alias("child"))).distinct()
    kind = e.schema["class_name"].dataType
    schema = StructType().add("child", kind).add("ancestor", kind).add("position", "long").add("relation", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        relations = pa.array(["class", "super", "super", "interface"])
        for rows in groups(batches):
            group = Group(rows)
            for at, (kid, ancestor, position, section) in group.orders():
                names = [group.names.take(pa.array(x)) for x in (group.node[at][kid], ancestor)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(position), relations.take(pa.array(section))], names=schema.names)

    return gathered(classes, e, rounds=rounds).mapInArrow(run, schema)


def _asking(calls: DataFrame) -> DataFrame:
    """calls with the class that each one asks (_child), whether it skips that class (_up) and whether its receiver names it (_typed)."""
    typed = F.coalesce(F.trim("receiver_type"), F.lit("")) != ""
    up = ~typed & (F.coalesce(F.trim("receiver_expr"), F.lit("")) == "super")
    return calls.withColumns({"_child": F.when(typed, F.trim("receiver_type")).otherwise(F.col("owner")), "_up": up, "_typed": typed})


def _able(methods: DataFrame, valid: DataFrame | None) -> DataFrame:
    """(ancestor, callee_signature) of methods with a body, of valid classes."""
    m = methods.filter("has_code").select(F.col("class_name").alias("ancestor"), F.col("method_signature").alias("callee_signature")).distinct()
    return m if valid is None else m.join(valid.select(F.col("class_name").alias("ancestor")).distinct(), "ancestor", "left_semi")


def _aimed(calls: DataFrame, first: DataFrame, valid: DataFrame | None) -> DataFrame:
    """calls with target, by first: child, callee_signature, _first (the first class that answers) and _above (the first one other than child)."""
    c = _asking(calls)
    # A call without a class or signature meets nothing; a number of its own keeps such calls from one task.
    c = c.withColumn("_salt", F.when(F.col("_child").isNull() | F.col("callee_signature").isNull(), F.xxhash64("call_id")).otherwise(F.lit(0).cast("long")))
    f = first.select(F.col("child").alias("_child"), "callee_signature", F.lit(0).cast("long").alias("_salt"), "_first", "_above")
    c = c.join(f, ["_child", "callee_signature", "_salt"], "left")
    target = F.when(F.col("_up"), F.col("_above")).otherwise(F.col("_first"))
    if valid is not None:
        ok = valid.select(F.col("class_name").alias("_child"), F.lit(True).alias("_ok")).distinct()
        c = c.join(ok, "_child", "left")
        target = F.when(~F.col("_typed") | F.col("_ok"), target)
    return c.select("call_id", *[x for x in calls.columns if x != "call_id"], target.alias("target"))


def callees(calls: DataFrame, order: DataFrame, methods: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """SYM-35/37: calls with target: the first class in the resolution order that has the called method with a body.

    calls: call_id, owner, receiver_type (null or empty: the owner's class), receiver_expr,
    callee_signature; order: resolution_order(); methods: class_name, method_signature,
    has_code.  super.m() skips the class itself.  valid: class_name of the classes that
    may answer; a call on a receiver that isn't valid has no target.
    """
    asked = _asking(calls).select(F.col("_child").alias("child"), "callee_signature").distinct()
    own = asked.select("child").distinct().select("child", F.col("child").alias("ancestor"), F.lit(0).cast("long").alias("position"))
    # The least position of an ancestor is kept by the minimum below, so own needs no distinct.
    o = order.select("child", "ancestor", "position").join(asked.select("child").distinct(), "child", "left_semi").unionByName(own)
    # Classes meet methods through their ancestors, never calls through a signature that many classes have.
    seen = o.join(_able(methods, valid), "ancestor").join(asked, ["child", "callee_signature"], "left_semi")
    first = seen.groupBy("child", "callee_signature").agg(F.min_by("ancestor", "position").alias("_first"), F.min_by("ancestor", F.when(F.col("position") > 0, F.col("position"))).alias("_above"))
    return _aimed(calls, first, valid)


def callees_above(calls: DataFrame, edges: DataFrame, methods: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """callees() along resolution_order(edges), without the rows of that order: classes and their methods come to the groups of the classes that calls ask."""
    e = _edges(edges)
    kind = e.schema["class_name"].dataType
    asked = _asking(calls).select(F.col("_child").cast(kind).alias("child"), F.col("callee_signature").alias("asks")).filter("asks is not null").distinct()
    has = _able(methods, valid).groupBy(F.col("ancestor").cast(kind).alias("node")).agg(F.collect_set("callee_signature").alias("has"))
    schema = StructType().add("child", kind).add("callee_signature", asked.schema["asks"].dataType).add("_first", kind).add("_above", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for rows in groups(batches):
            group = Answers(rows)
            for child, signature, first, above in group.answers():
                yield pa.RecordBatch.from_arrays([group.names.take(child), group.signatures.take(signature), group.names.take(first), group.names.take(above)], names=schema.names)

    return _aimed(calls, gathered(asked, e, has).mapInArrow(run, schema), valid)


def callee_details(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """SYM-37: calls with declaring (their receiver's class, if it is analysed), class_annotations, class_imports, method_annotations and method_parameters.

    classes: class_name, annotations, imports (arrays); methods: class_name,
    method_signature, annotations, parameters.  A call on another class gets nulls; an analysed class without the method empty arrays.
    """
    k = classes.select(F.col("class_name").alias("receiver_type"), F.col("class_name").alias("declaring"), F.col("annotations").alias("class_annotations"), F.col("imports").alias("class_imports"))
    m = methods.select(F.col("class_name").alias("receiver_type"), F.col("method_signature").alias("callee_signature"), F.col("annotations").alias("method_annotations"), F.col("parameters").alias("method_parameters"))
    d = calls.join(k, "receiver_type", "left").join(m, ["receiver_type", "callee_signature"], "left")
    for c in ("method_annotations", "method_parameters"):
        d = d.withColumn(c, F.when(F.col("declaring").isNotNull(), F.coalesce(c, F.array().cast(d.schema[c].dataType))))
    return d


def static_index(imports: DataFrame, methods: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """SYM-36, SYM-24: (class_name, method, receiver_type): where a bare method name comes from by static imports.

    imports: class_name, path, is_static, is_wildcard; methods: class_name,
    method_signature, modifiers of the project's classes; known: owner, method, tier
    (framework or utility) of library classes whose wildcard imports are understood.  An
    index of static members by owner meets the wildcard imports.  A name imported itself
    goes before one from a framework's or the project's wildcard, and that before a
    utility's; a name that a tier gives from two owners is dropped from that tier.  Names are in lower case.
    """
    static = imports.filter(F.coalesce("is_static", F.lit(False))).select("class_name", F.trim("path").alias("path"), F.coalesce("is_wildcard", F.lit(False)).alias("wild")).distinct()
    member = F.regexp_extract("path", r"\.([^.]+)$", 1)
    named = static.filter(~F.col("wild") & member.rlike(r"^\p{Ll}")).select("class_name", F.lower(member).alias("method"), F.regexp_replace("path", r"\.[^.]+$", "").alias("receiver_type"), F.lit(0).alias("tier"))
    name = F.lower(F.trim(F.substring_index("method_signature", "(", 1)))
    members = methods.filter(F.array_contains("modifiers", "static")).select(F.col("class_name").alias("path"), name.alias("method"), F.lit(1).alias("tier")).filter("method <> ''")
    if known is not None:
        members = members.unionByName(known.select(F.col("owner").alias("path"), F.lower("method").alias("method"), F.when(F.col("tier") == "framework", 1).otherwise(2).alias("tier")))
    wild = static.filter("wild").join(members.distinct(), "path").select("class_name", "method", F.col("path").alias("receiver_type"), "tier")
    one = named.unionByName(wild).groupBy("class_name", "method", "tier").agg(F.count_distinct("receiver_type").alias("n"), F.min("receiver_type").alias("receiver_type")).filter("n = 1")
    return one.groupBy("class_name", "method").agg(F.min_by("receiver_type", "tier").alias("receiver_type"))
