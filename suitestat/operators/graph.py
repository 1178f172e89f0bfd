"""Symbol-table graphs as joins: hierarchies, containment, chains, helper expansion, constants."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from suitestat.functions.lineage import cut, written
from suitestat.operators.spans import nest

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


def closure(edges: DataFrame, child: str = "class_name", parent: str = "parent", max_depth: int = 1000) -> DataFrame:
    """SYM-08/09: (child, ancestor, depth): itself at 0, nearest depth of each ancestor.

    A loop of joins, one level a round, until a round finds nothing new; cycles end
    because an ancestor is kept at its first depth only.  Raises if max_depth rounds
    don't do.  What meets in a round grows with the classes, so none of it is broadcast.
    """
    e = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).filter("parent is not null").distinct()
    every = edges.select(F.col(child).alias("child")).unionByName(e.select(F.col("parent").alias("child"))).distinct()
    out = every.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    front = out
    for d in range(1, max_depth + 1):
        up = front.select("child", F.col("ancestor").alias("_a")).join(e.hint("merge"), F.col("_a") == e["child"]).select(front["child"], F.col("parent").alias("ancestor")).distinct()
        front = cut(up.join(out.select("child", "ancestor").hint("merge"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise RuntimeError(f"closure did not settle in {max_depth} rounds")


def inherited(ancestors: DataFrame, facts: DataFrame) -> DataFrame:
    """ancestors with the facts (class_name, ...) of each ancestor.

    A class has few facts and stands above many others, so tasks hold the facts by class
    and ancestors stream past them: the large side is never sorted.
    """
    return ancestors.join(facts.withColumnRenamed("class_name", "ancestor").hint("shuffle_hash"), "ancestor")


def visible_methods(ancestors: DataFrame, methods: DataFrame) -> DataFrame:
    """SYM-10: methods that a class sees: of each signature the nearest owner's."""
    m = inherited(ancestors, methods)
    return m.groupBy("child", "method_signature").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("owner"), F.min("depth").alias("depth"))


def containment(calls: DataFrame, *keys: str) -> DataFrame:
    """SYM-14: parent_id of each call: the innermost one that strictly contains its span, null at the top (see spans.nest)."""
    return nest(calls.select(*keys, "call_id", "start", "stop"), *keys).drop("host_id")


def receiver_chains(calls: DataFrame, *keys: str) -> DataFrame:
    """SYM-15: calls that start at one place, from the inner to the outer one."""
    return calls.groupBy(*keys, "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop", "call_id"))), lambda x: x["call_id"]).alias("chain")).filter(F.size("chain") > 1)


def evaluation_order(calls: DataFrame, *keys: str) -> DataFrame:
    """SYM-16: place of each call in its method: receivers and arguments before the call that uses them."""
    w = Window.partitionBy(*keys).orderBy("stop", F.desc("start"), "call_id")
    return calls.withColumn("place", F.row_number().over(w))


def expand(calls: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """SYM-17: (root, owner, callee, depth): calls of each root method and of the helpers that it reaches, to a depth, without cycles.

    calls: owner, callee (methods); roots: root.  path holds the methods on the way.
    """
    c = calls.select("owner", "callee").distinct()
    now = roots.select("root", F.col("root").alias("owner"), F.array("root").alias("path"))
    out = None
    for d in range(max_depth + 1):
        step = now.join(c, "owner").select("root", "owner", "callee", "path", F.lit(d).alias("depth"))
        out = step if out is None else out.unionByName(step)
        now = step.filter(~F.array_contains("path", F.col("callee"))).select("root", F.col("callee").alias("owner"), F.concat("path", F.array("callee")).alias("path"))
    return out.drop("path")


#: Calls that the methods of a group make, about: a task holds a group and what it reaches.
GROUP_CALLS = 1 << 17
#: Pairs of group and method reached that stand on disk at a time, about; groups that show how many there are.
REACHED_AT_ONCE = 1 << 25
_SHOWN = 8
#: Pairs of root and method that a task expands at a time.
PAIRS_AT_ONCE = 1 << 22


def helper_counts(calls: DataFrame, roots: DataFrame | None = None, max_depth: int = 3) -> DataFrame:
    """SYM-18: distinct_helpers(expand(...)) without a row for each path.

    A method that a path reaches is also reached by a shortest one, which has no cycle, so
    a walk by levels does; a root that calls itself over others is its own helper.  roots:
    root; without them every owner is one.  A range of owners is a group, to which the
    callees of each method that it reaches go once, for all its roots; roots are walked in
    the group's task, so no row is shuffled for a pair of root and helper.  Groups go in
    slices, and the shuffle files of one go before the next; some groups spread over all
    say how many a slice gets, so that it takes as much disk where roots of a group reach
    much as where they reach the same.
    """
    kind = calls.select("owner").unionAll(calls.select("callee")).schema[0].dataType
    c = calls.filter("owner is not null").select(F.col("owner").cast(kind), F.col("callee").cast(kind))
    n = max(1, -(-c.count() // GROUP_CALLS))
    sets = c.repartitionByRange(n, "owner").groupBy("owner").agg(F.collect_set("callee").alias("callees")).withColumn("g", F.spark_partition_id())
    sets = written(sets, free=True)
    own = sets if roots is None else sets.join(roots.select(F.col("root").cast(kind).alias("owner")).distinct(), "owner", "left_semi")
    root = F.col("owner").cast(calls.schema["owner"].dataType).alias("root")
    if max_depth == 0:
        return own.select(root, F.size("callees").cast("long").alias("helpers"))
    called = sets.select(F.explode("callees").alias("owner")).distinct()
    inner = written(sets.join(called, "owner", "left_semi").select(F.col("owner").alias("node"), "callees"), free=True)  # calls of what is called

    def reached(own: DataFrame) -> DataFrame:
        near = own.select("g", F.explode("callees").alias("node")).distinct()
        for _ in range(max_depth - 1):
            near = near.join(inner, "node").select("g", F.explode(F.array_append("callees", F.col("node"))).alias("node")).distinct()
        return near.join(inner, "node").select("g", "node", "callees")

    def counted(own: DataFrame, groups: int) -> DataFrame:
        rows = own.withColumn("is_root", F.lit(True)).unionByName(reached(own).withColumnRenamed("node", "owner").withColumn("is_root", F.lit(False)))
        # A number of partitions that is given isn't lowered: a group takes far longer to walk than to read.
        return rows.repartition(groups, "g").groupBy("g").applyInArrow(_walk(max_depth, kind), StructType().add("owner", kind).add("helpers", "long")).select(root, "helpers")

    if n <= _SHOWN:
        return counted(own, n)
    shown = own.filter(F.col("g").isin([i * n // _SHOWN for i in range(_SHOWN)]))
    step = min(n, max(1, REACHED_AT_ONCE * _SHOWN // max(1, reached(shown).count())))
    if step == n:
        return counted(own, n)
    k = -(-n // step)
    slices = [own.filter(F.col("g") % k == s) for s in range(k)]  # every group is in one, whatever their number
    return reduce(DataFrame.unionAll, [written(counted(s, step), free=True) for s in slices])


def _walk(max_depth: int, kind: DataType) -> Callable[[pa.Table], pa.Table]:
    """What counts the helpers of the roots of a group: (owner, helpers) from (owner, callees, is_root) of roots and of all that they reach."""

    def run(rows: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        owners, callees = (rows.column(c).combine_chunks() for c in ("owner", "callees"))
        flags = rows.column("is_root").combine_chunks().to_numpy(zero_copy_only=False)
        codes = pa.concat_arrays([owners, callees.flatten()]).dictionary_encode()
        ids = codes.indices.to_numpy().astype(np.int64)
        size, own, flat = len(codes.dictionary), ids[: len(owners)], ids[len(owners) :]
        ends = np.cumsum(callees.value_lengths().to_numpy().astype(np.int64))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        first, many = np.zeros(size, np.int64), np.zeros(size, np.int64)  # of each method's callees in flat
        first[own[~flags]], many[own[~flags]] = begins[~flags], (ends - begins)[~flags]
        roots = np.flatnonzero(flags)
        out = np.zeros(len(roots), np.int64)

        def opened(base: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            """base + a callee, for all callees that stand from at on, sorted, each once."""
            before = np.cumsum(lengths) - lengths
            x = np.repeat(base, lengths) + flat[np.repeat(at - before, lengths) + np.arange(lengths.sum())]
            return unique(x)

        def unique(x: np.ndarray) -> np.ndarray:
            x.sort()
            return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x

        def walk(lo: int, hi: int) -> bool:
            """Counts for the roots from lo to hi; False if they open too many pairs at once."""
            mine = roots[lo:hi]
            # A pair of root and method is one number.
            seen = front = opened(np.arange(hi - lo) * size, begins[mine], (ends - begins)[mine])
            for depth in range(max_depth):
                node = front % size
                lengths = many[node]
                if lengths.sum() > PAIRS_AT_ONCE and hi - lo > 1:
                    return False
                new = opened(front - node, first[node], lengths)
                if depth + 1 < max_depth and len(new):
                    new = front = new[seen[np.minimum(np.searchsorted(seen, new), len(seen) - 1)] != new]
                if not len(new):
                    break
                seen = unique(np.concatenate([seen, new]))
            out[lo:hi] = np.bincount(seen // size, minlength=hi - lo)
            return True

        todo = [(lo, min(lo + 4096, len(roots))) for lo in range(0, len(roots), 4096)]
        while todo:
            lo, hi = todo.pop()
            if not walk(lo, hi):
                middle = (lo + hi) // 2
                todo += [(lo, middle), (middle, hi)]
        return pa.table({"owner": owners.take(pa.array(roots)), "helpers": out})

    return run


def distinct_helpers(expanded: DataFrame) -> DataFrame:
    """SYM-18: helpers that a root reaches, each once."""
    return expanded.groupBy("root").agg(F.count_distinct("callee").alias("helpers"))


def runtime_metrics(expanded: DataFrame, methods: DataFrame, *metrics: str) -> DataFrame:
    """SYM-20: metrics of a test's own body and of each call of a helper, added up."""
    own = expanded.select("root", F.col("root").alias("method")).distinct()
    rows = own.unionByName(expanded.select("root", F.col("callee").alias("method"))).join(methods, "method")
    return rows.groupBy("root").agg(*[F.sum(m).alias(m) for m in metrics])


def ncloc(code: str | Column) -> Column:
    """SYM-21: lines that are not blank once comments are gone; strings and text blocks are matched first, so comment marks inside them stay."""
    c = F.col(code) if isinstance(code, str) else code
    # Loops go over what stands between escapes, so a long string needs no deep stack.
    block, string, char = r'"""[^"\\]*+(?:(?:\\.|"{1,2}(?!"))[^"\\]*+)*+"""', r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    plain = F.regexp_replace(c, f"(?s)({block}|{string}|{char})|/\\*.*?\\*/|//[^\n]*", "$1")
    return F.size(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != "")).cast("long")


def first_hit(calls: DataFrame, sources: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """SYM-23/24: type of each call's receiver from the first source that knows its name: (type, source), null if none does.

    sources in order of precedence, each with keys and type, unique by keys.
    """
    out = calls
    for i, (_, s) in enumerate(sources):
        out = out.join(s.select(*keys, F.col("type").alias(f"_t{i}")), keys, "left")
    n = range(len(sources))
    source = F.lit(None).cast("string")
    for i in reversed(n):
        source = F.when(F.col(f"_t{i}").isNotNull(), sources[i][0]).otherwise(source)
    return out.withColumn("type", F.coalesce(*[F.col(f"_t{i}") for i in n])).withColumn("source", source).drop(*[f"_t{i}" for i in n])


def unambiguous(candidates: DataFrame, *keys: str) -> DataFrame:
    """SYM-24/31/36: the type of keys that have exactly one candidate."""
    return candidates.groupBy(*keys).agg(F.count_distinct("type").alias("_n"), F.min("type").alias("type")).filter("_n = 1").drop("_n")


def resolve_constants(fields: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """SYM-25/39: (name, value): string constants through references and concatenation.

    fields: name, tokens array<struct<kind, text>> (kind literal or reference).  A
    name that refers to itself, or to one that can't be resolved, is null.
    Raises if max_rounds rounds don't do.
    """
    parts = fields.select("name", F.posexplode("tokens").alias("i", "t")).select("name", "i", "t.kind", "t.text")
    done = fields.filter(~F.exists("tokens", lambda t: t["kind"] == "reference")).select("name", F.array_join(F.transform("tokens", lambda t: t["text"]), "").alias("value"))
    for _ in range(max_rounds):
        known = done.select(F.col("name").alias("text"), "value")
        p = parts.join(done, "name", "left_anti").join(known, "text", "left").withColumn("v", F.when(F.col("kind") == "literal", F.col("text")).otherwise(F.col("value")))
        ready = cut(p.groupBy("name").agg(F.count_if(F.col("v").isNull()).alias("open"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]), "").alias("value")).filter("open = 0").select("name", "value"))
        if ready.isEmpty():
            return fields.select("name").join(done, "name", "left")
        done = done.unionByName(ready)
    raise RuntimeError(f"constants did not settle in {max_rounds} rounds")


def type_name(reference: str | Column) -> Column:
    """SYM-30: a type without generics, arrays and nesting marks."""
    r = F.col(reference) if isinstance(reference, str) else reference
    return F.replace(F.trim(F.regexp_replace(F.regexp_replace(r, r"<.*>", ""), r"(?:\[\]|\.\.\.)", "")), F.lit("$"), F.lit("."))


def effective_annotations(ancestors: DataFrame, annotations: DataFrame) -> DataFrame:
    """SYM-05/33: of each class and annotation name, the nearest declaration; from ancestors only inheritable ones."""
    a = inherited(ancestors, annotations).filter((F.col("depth") == 0) | F.col("inheritable"))
    return a.groupBy("child", "short_name").agg(F.min_by(F.struct("ancestor", "body"), F.struct("depth", "ancestor")).alias("_b"), F.min("depth").alias("depth")).select("child", "short_name", "_b.ancestor", "_b.body", "depth")


def fixtures(ancestors: DataFrame, methods: DataFrame, rules: DataFrame) -> DataFrame:
    """SYM-11/13/34: fixture methods that a class runs, in order: annotated ones that no nearer class overrides, outer classes first for setup.

    methods: class_name, method_signature, annotation; rules: annotation, phase.
    """
    m = inherited(ancestors, methods)
    near = m.withColumn("_d", F.min("depth").over(Window.partitionBy("child", "method_signature"))).filter("depth = _d").drop("_d")
    f = near.join(F.broadcast(rules), "annotation")  # a fixed list of annotations
    order = F.when(F.col("phase") == "setup", -F.col("depth")).otherwise(F.col("depth"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("child", "phase").orderBy(order, "ancestor", "method_signature")))


def categorize(classes: DataFrame, test_classes: DataFrame, in_test_directory: Column) -> DataFrame:
    """SYM-01: each class as test, utility (in a test directory without tests) or application."""
    t = test_classes.select("class_name").distinct().withColumn("_t", F.lit(True))
    return classes.join(t, "class_name", "left").withColumn("category", F.when(F.col("_t"), "test").when(in_test_directory, "utility").otherwise("application")).drop("_t")


def parameter_values(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """SYM-26: values of a helper's parameters over all its calls: (callee, name, value), null where calls differ or one is unknown.

    calls: call_id, callee, values (array, null for unknown); parameters: callee, pos (from 0), name.
    """
    v = calls.select("call_id", "callee", F.posexplode("values").alias("pos", "value"))
    return v.join(parameters, ["callee", "pos"]).groupBy("callee", "name").agg(F.when((F.count("value") == F.count(F.lit(1))) & (F.count_distinct("value") == 1), F.min("value")).alias("value"))


def method_totals(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """SYM-22: per class, methods, complexity and objects that they create. methods: class_name, method_signature, complexity; calls: class_name, is_constructor."""
    made = calls.groupBy("class_name").agg(F.count_if("is_constructor").alias("objects_created"))
    out = methods.groupBy("class_name").agg(F.count(F.lit(1)).alias("methods"), F.sum("complexity").alias("complexity")).join(made, "class_name", "left")
    return out.withColumn("objects_created", F.coalesce("objects_created", F.lit(0)).cast("long"))


def imports_of(imports: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """SYM-32: imports of each class, its ancestors' too where they are given, each path once, with is_static.

    What a class inherits goes to it as one array for each ancestor and opens where all of
    a class's arrays are, so a task that joins holds no imports of the classes below.
    """
    own = imports.select("class_name", "path", "is_static", "is_wildcard").distinct()
    if ancestors is None:
        return own
    sets = own.groupBy("class_name").agg(F.collect_list(F.struct("path", "is_static", "is_wildcard")).alias("_i"))
    up = inherited(ancestors, sets).select(F.col("child").alias("class_name"), "_i")
    return sets.unionByName(up).repartition("class_name").select("class_name", F.explode("_i").alias("_i")).select("class_name", "_i.*").distinct()
