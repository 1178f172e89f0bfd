"""What the builders of a method give to its request events.

An event gets what the builders inside its span set: those of its receiver chain first,
then those in arguments.  A chain of builders without an event waits, and goes to the
next event of its framework that lacks a verb or a path; a REST Assured specification
also goes to a complete event that names it.  The first verb and the first path win,
names add up, and what each builder gave is kept.  calls: rows of classification.classify().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitestat.functions.lineage import cut
from suitestat.functions.urls import join_parts
from suitestat.operators import families as K
from suitestat.operators.classification import APPENDING, NAME, _in, method, no_names, text
from suitestat.operators.spans import nest
from suitestat.operators.verbs import frameworks_match

#: What a builder may give, in the order in which it is listed.
PROPERTIES = ("http_method", "path", "headers", "header_names", "query_names", "path_names", "form_names", "either_names", "has_body", "auth_hints")
LISTS = ("headers", "header_names", "query_names", "path_names", "form_names", "either_names", "auth_hints")
RA = "rest-assured"


def base_key() -> Column:
    """baseuri or basepath for REST Assured's setters of a prefix, else null."""
    return F.when((F.col("framework") == RA) & method().isin("baseuri", "basepath"), method())


def framework_class(framework: Column) -> Column:
    """Frameworks whose builders serve each other's events have one class."""
    return F.when(framework == "test-rest-template", "rest-template").otherwise(framework)


def _renamed(keys: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def composed(members: Column) -> Column:
    """CLS-21: one path of a chain's members (sorted structs with path, truncated, appends, call_id), where all but the first append and none but the last is cut; else null."""
    m = F.filter(members, lambda x: x["path"] != "")
    n = F.size(m)
    whole = (n >= 2) & F.forall(F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: x["appends"]) & ~F.exists(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: x["truncated"])
    path = F.aggregate(m, F.lit(""), lambda a, x: join_parts(a, x["path"]))
    return F.when(whole, F.struct(path.alias("path"), F.get(m, n - 1)["truncated"].alias("truncated"), F.transform(m, lambda x: x["call_id"]).alias("of")))


# ---- chains that wait


def target_names(chains: DataFrame, declarations: DataFrame | None, *keys: str) -> DataFrame:
    """CLS-40: chains with names: receivers of their members that are one identifier, and variables whose initialised declaration covers the whole chain.

    chains: keys, chain (its start), stop, receivers (array); declarations: keys, name,
    start, stop, initializer.  Declarations and chains are swept together in the order of their
    places, so a chain meets the declarations open around it and no others.
    """
    own = F.filter("receivers", lambda x: x.rlike(rf"^\s*{NAME}\s*$"))
    d = chains.withColumn("_own", F.transform(own, lambda x: F.trim(x)))
    if declarations is None:
        return d.withColumn("names", F.array_sort(F.array_distinct("_own"))).drop("_own")
    # Stretched so that a declaration contains a chain of the same span: 4s..4e+3 holds 4s+1..4e+2.
    spans = declarations.filter("trim(initializer) <> '' and trim(name) <> '' and start >= 0 and stop >= 0").groupBy(*keys, "start", "stop").agg(F.collect_set(F.trim("name")).alias("declared"))
    a = spans.select(*keys, F.concat_ws(":", F.lit("d"), "start", "stop").alias("call_id"), (F.col("start") * 4).alias("start"), (F.col("stop") * 4 + 3).alias("stop"), "declared", F.lit(False).alias("is_chain"), F.lit(None).cast(d.schema["chain"].dataType).alias("chain"))
    b = d.select(*keys, F.concat_ws(":", F.lit("c"), "chain").alias("call_id"), (F.col("chain") * 4 + 1).alias("start"), (F.col("stop") * 4 + 2).alias("stop"), F.lit(None).cast("array<string>").alias("declared"), F.lit(True).alias("is_chain"), "chain")
    swept = nest(a.unionByName(b), *keys, wanted="is_chain")
    around = swept.filter("is_chain").select(*keys, "chain", F.explode("ancestors.call_id").alias("call_id"))
    named = around.join(a.select(*keys, "call_id", "declared"), [*keys, "call_id"]).groupBy(*keys, "chain").agg(F.array_distinct(F.flatten(F.collect_list("declared"))).alias("_declared"))
    out = d.join(named, [*keys, "chain"], "left")
    return out.withColumn("names", F.array_sort(F.array_union("_own", F.coalesce("_declared", no_names())))).drop("_own", "_declared")


def drained(items: DataFrame, *keys: str) -> DataFrame:
    """CLS-20: (keys, cls, chain, event_id): the event that each waiting chain goes to; chains that none takes don't come out.

    items: keys, cls (class of frameworks), chain (start), stop, event_id (null for a
    waiting chain), open (the event lacks a verb or a path), receiver (one identifier or
    empty), names (array), base (the chain sets a base prefix).  An open event takes all that
    waits.  A complete event of REST Assured takes the chains that its receiver names;
    where it has no receiver, or no waiting chain has a name, it takes the first chain
    without names if such a chain sets a base prefix.  One pass in order: a task keeps what waits.
    """
    import pyarrow as pa

    schema = items.select(*keys, "cls", "chain", "event_id").schema
    order = [*keys, "cls", "chain", "event_id", "open", "receiver", "names", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        now, waiting, by_name, named, based = None, {}, {}, 0, 0
        for batch in batches:
            out = []
            for *key, cls, chain, event, open_, receiver, names, base in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if (mark := (*key, cls)) != now:
                    now, waiting, by_name, named, based = mark, {}, {}, 0, 0
                if event is None:
                    waiting[chain] = (names or [], bool(base))
                    for n in names or []:
                        by_name.setdefault(n, {})[chain] = None
                    named += bool(names)
                    based += bool(base) and not names
                    continue
                taken: list = []
                if open_:
                    taken = list(waiting)
                elif cls == RA and waiting:
                    taken = list(by_name.get(receiver, ())) if receiver else []
                    if not taken and not (receiver and named) and based:
                        taken = [next(c for c, (n, _) in waiting.items() if not n)]
                for c in taken:
                    had, was_base = waiting.pop(c)
                    for n in had:
                        by_name[n].pop(c, None)
                    named -= bool(had)
                    based -= was_base and not had
                    out.append((*mark, c, event))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    rows = items.select(*order, "stop").repartition(*keys, "cls").sortWithinPartitions(*keys, "cls", "chain", "stop", "event_id")
    return rows.select(*order).mapInArrow(run, schema)


# ---- merging


def _rank(a, b, c, d) -> Column:
    return F.struct(*[(F.lit(x) if isinstance(x, int) else x).cast("long").alias(n) for n, x in zip("abcd", (a, b, c, d), strict=True)])


def _paths(pairs: DataFrame, *by: str) -> DataFrame:
    """Composed paths of the builders of each chain."""
    member = F.struct("rank", F.when(F.col("base").isNull(), F.col("path")).otherwise("").alias("path"), "truncated", "appends", "call_id")
    return pairs.groupBy(*by).agg(composed(F.sort_array(F.collect_list(member))).alias("_c")).filter("_c is not null")


def correlate(calls: DataFrame, *keys: str, declarations: DataFrame | None = None, static_bases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """CLS-18/20..24: (events, sources).

    events: keys, call_id and, as the request ends up, http_method, path, truncated, the
    lists of LISTS (either_names gone into form_names or query_names) and has_body.
    sources: a row for each builder that gave something: keys, event_id, builder_id, method_name, line,
    framework, properties (array, in the order of PROPERTIES); a base prefix or a member
    of a composed path has a row of its own, with path.
    static_bases: keys, key (baseuri or basepath), path: defaults of a class.
    """
    ids = [*keys, "event_id"]
    base = calls.filter("request_role is not null").withColumn("base", base_key()).withColumn("appends", _in(APPENDING, text("family"), method())).withColumn("cls", framework_class(F.col("framework")))
    events = base.filter(F.col("request_role") == K.EVENT)
    builders = base.filter(F.col("request_role") == K.BUILDER)
    give = ["call_id", "start", "stop", "line", "method_name", "receiver_type", "framework", "family", "cls", "base", "appends", "http_method", "path", "truncated", "has_body", *LISTS]

    # Builders inside an event's span.
    e = events.select(*keys, F.col("call_id").alias("event_id"), F.col("start").alias("_s"), F.col("framework").alias("_f"))
    inside = builders.select(*keys, *give, F.explode("ancestors.call_id").alias("event_id")).join(e, ids)
    prefix = F.col("start") == F.col("_s")
    inside = inside.withColumn("rank", F.when(prefix, _rank(1, 0, F.col("stop"), 0)).otherwise(_rank(1, 1, F.col("start"), -F.col("stop")))).withColumn("_prefix", prefix)
    chained = _paths(inside.filter("_prefix"), *ids).withColumn("rank", _rank(1, -1, 0, 0))
    own = inside.filter(frameworks_match(F.col("framework"), F.col("_f"))).drop("_s", "_f", "_prefix")

    # What an event has without the chains that wait.
    has = own.groupBy(*ids).agg(F.bool_or(F.col("http_method") != K.UNKNOWN).alias("_v"), F.bool_or(F.col("path") != "").alias("_p"))
    joined = events.withColumnRenamed("call_id", "event_id").join(has, ids, "left").join(chained.select(*ids, F.lit(True).alias("_c")), ids, "left")
    lacks = ((F.col("http_method") == K.UNKNOWN) & ~F.coalesce("_v", F.lit(False))) | ~((F.col("path") != "") | F.coalesce("_p", F.lit(False)) | F.coalesce("_c", F.lit(False)))
    identifier = F.regexp_extract(text("receiver_expr"), rf"^\s*({NAME})\s*$", 1)
    asks = joined.select(*keys, "cls", F.col("start").alias("chain"), "stop", "event_id", lacks.alias("open"), identifier.alias("receiver"), no_names().alias("names"), F.lit(False).alias("base"))

    # Chains of builders without an event.
    with_event = events.select(*keys, "start").distinct()
    alone = builders.join(with_event, [*keys, "start"], "left_anti")
    spans = calls.join(alone.select(*keys, "start").distinct(), [*keys, "start"], "left_semi").groupBy(*keys, F.col("start").alias("chain")).agg(F.max("stop").alias("stop"), F.collect_set(text("receiver_expr")).alias("receivers"))
    targets = target_names(spans, declarations, *keys)
    waiting = alone.groupBy(*keys, "cls", F.col("start").alias("chain")).agg(F.bool_or(F.col("base").isNotNull()).alias("base")).join(targets.select(*keys, "chain", "stop", "names"), [*keys, "chain"])
    none = F.lit(None).cast(calls.schema["call_id"].dataType)
    items = asks.unionByName(waiting.select(*keys, "cls", "chain", "stop", none.alias("event_id"), F.lit(False).alias("open"), F.lit("").alias("receiver"), "names", "base"))
    went = drained(items, *keys)
    later = alone.select(*keys, *give, F.col("start").alias("chain")).join(went, [*keys, "cls", "chain"]).withColumn("rank", _rank(2, F.col("chain"), F.col("stop"), 0))
    queued = _paths(later, *ids, "chain").withColumn("rank", _rank(2, F.col("chain"), -1, 0))
    pairs = cut(own.unionByName(later.drop("chain")).select(*ids, "rank", *give))

    # The first path that is offered: the event's, a composed one, a builder's.
    event = events.withColumnRenamed("call_id", "event_id")
    none_of = F.array().cast(f"array<{calls.schema['call_id'].dataType.simpleString()}>")
    offer = F.struct("path", "truncated", F.col("call_id").alias("one"), F.col("of").alias("of"))
    offers = (
        event.filter("path <> ''").select(*ids, _rank(0, 0, 0, 0).alias("rank"), "path", "truncated", none.alias("call_id"), none_of.alias("of"))
        .unionByName(pairs.filter("path <> '' and base is null").select(*ids, "rank", "path", "truncated", "call_id", none_of.alias("of")))
        .unionByName(chained.unionByName(queued.drop("chain")).select(*ids, "rank", "_c.path", "_c.truncated", none.alias("call_id"), F.col("_c.of").alias("of")))
    )
    won = offers.groupBy(*ids).agg(F.min_by(offer, "rank").alias("_path"))

    # The first verb and body, and the names, each from the first that has it.
    first = pairs.groupBy(*ids).agg(
        F.min_by(F.when(F.col("http_method") != K.UNKNOWN, F.struct("http_method", "call_id")), F.when(F.col("http_method") != K.UNKNOWN, F.col("rank"))).alias("_verb"),
        F.min_by(F.when(F.col("has_body"), F.col("call_id")), F.when(F.col("has_body"), F.col("rank"))).alias("_body"),
        *_okhttp(),
    )
    named = lambda p: F.transform(p, lambda x, i: F.struct(F.lit(p).alias("property"), x.alias("name"), i.alias("i")))
    names = F.flatten(F.array(*[named(p) for p in LISTS]))
    said = event.select(*ids, _rank(0, 0, 0, 0).alias("rank"), none.alias("call_id"), F.explode(names).alias("n")).unionByName(pairs.select(*ids, "rank", "call_id", F.explode(names).alias("n")))
    once = cut(said.groupBy(*ids, "n.property", "n.name").agg(F.min(F.struct("rank", "n.i", "call_id")).alias("f")))
    lists = once.groupBy(*ids).agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("property") == p, F.struct("f.rank", "f.i", "name")))), lambda x: x["name"]).alias(f"_{p}") for p in LISTS])

    # Base prefixes: a chain's last setter, else the first that waited, else the class's.
    set_ = pairs.filter("base is not null and path <> ''")
    bases = set_.groupBy(*ids, F.col("base").alias("key")).agg(
        F.max_by(F.struct("path", "truncated", "call_id"), F.when(F.col("rank.a") == 1, F.col("rank"))).alias("_in"), F.min_by(F.struct("path", "truncated", "call_id"), F.when(F.col("rank.a") == 2, F.col("rank"))).alias("_out")
    ).select(*ids, "key", F.coalesce("_in", "_out").alias("b"))
    if static_bases is not None:
        given = event.filter(F.col("framework") == RA).select(*ids).join(static_bases, list(keys)).select(*ids, "key", F.struct("path", F.lit(False).alias("truncated"), none.alias("call_id")).alias("b"))
        bases = bases.unionByName(given.join(bases.select(*ids, "key"), [*ids, "key"], "left_anti"))
    based = bases.groupBy(*ids).agg(*[F.max(F.when(F.col("key") == k, F.col("b"))).alias(f"_{k}") for k in ("baseuri", "basepath")])

    d = event.join(won, ids, "left").join(first, ids, "left").join(lists, ids, "left").join(based, ids, "left")
    verb = F.when(F.col("http_method") != K.UNKNOWN, F.col("http_method")).otherwise(F.coalesce("_verb.http_method", F.lit(K.UNKNOWN)))
    get = (F.col("framework") == "okhttp") & (verb == K.UNKNOWN) & F.coalesce("_url", F.lit(False)) & ~F.coalesce("_fixed", F.lit(False))
    d = d.withColumn("_final", F.when(get, "GET").otherwise(verb))
    parts = F.filter(F.array(F.struct("_baseuri.path", "_baseuri.truncated"), F.struct("_basepath.path", "_basepath.truncated"), F.struct("_path.path", "_path.truncated")), lambda x: F.coalesce(x["path"] != "", F.lit(False)))
    n = F.size(parts)
    joins = (F.col("framework") == RA) & (F.col("_baseuri").isNotNull() | F.col("_basepath").isNotNull()) & ~F.coalesce(F.col("_path.path").rlike("^https?://"), F.lit(False)) & ~F.exists(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: x["truncated"])
    d = cut(d.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_parts", parts))
    path = F.when(F.col("_joins"), F.aggregate("_parts", F.lit(""), lambda a, x: join_parts(a, x["path"]))).otherwise(F.coalesce("_path.path", F.lit("")))
    truncated = F.when(F.col("_joins"), F.get("_parts", F.size("_parts") - 1)["truncated"]).otherwise(F.coalesce("_path.truncated", F.lit(False)))
    into = F.when(F.col("_final") == "POST", "form_names").when(F.col("_final") != K.UNKNOWN, "query_names")
    final = {p: F.coalesce(f"_{p}", no_names()) for p in LISTS}
    either = final.pop("either_names")
    for p in ("form_names", "query_names"):
        final[p] = F.when(into == p, F.array_union(final[p], either)).otherwise(final[p])
    out = d.select(*keys, F.col("event_id").alias("call_id"), F.col("_final").alias("http_method"), path.alias("path"), truncated.alias("truncated"), *[c.alias(p) for p, c in final.items()], (F.col("has_body") | F.col("_body").isNotNull()).alias("has_body"))

    # What each builder gave.
    ends = d.select(*ids, into.alias("_into"))
    of = lambda name, rows, builder: rows.select(*ids, F.col(builder).alias("call_id"), F.lit(name).alias("property"), F.lit(0).alias("part")).filter("call_id is not null")
    listed = once.filter("f.call_id is not null").join(ends, ids).withColumn("property", F.when(F.col("property") == "either_names", F.col("_into")).otherwise(F.col("property"))).filter("property is not null")
    gave = of("path", d, "_path.one").unionByName(of("http_method", d.filter(F.col("http_method") == K.UNKNOWN), "_verb.call_id")).unionByName(of("has_body", d.filter(~F.col("has_body")), "_body")).unionByName(listed.select(*ids, "f.call_id", "property", F.lit(0).alias("part")))
    separate = d.select(*ids, F.explode("_path.of").alias("call_id"), F.lit("path").alias("property"), F.lit(1).alias("part"))
    for k in ("_baseuri", "_basepath"):
        separate = separate.unionByName(d.filter(F.col("_joins") & F.col(f"{k}.call_id").isNotNull()).select(*ids, F.col(f"{k}.call_id").alias("call_id"), F.lit("path").alias("property"), F.lit(2).alias("part")))
    order = F.array(*[F.lit(p) for p in PROPERTIES])
    rows = gave.unionByName(separate).groupBy(*ids, "call_id", "part").agg(F.collect_set("property").alias("_s"))
    rows = rows.withColumn("properties", F.filter(order, lambda p: F.array_contains("_s", p))).drop("_s")
    told = builders.select(*keys, "call_id", text("method_name").alias("method_name"), "line", "framework")
    sources = rows.join(told, [*keys, "call_id"]).select(*ids, F.col("call_id").alias("builder_id"), "method_name", "line", "framework", "properties")
    return out, sources


def _okhttp() -> list[Column]:
    """CLS-24: whether a Request.Builder of the chain got a url, and whether its verb is set or copied elsewhere."""
    r = F.replace(text("receiver_type"), F.lit("$"), F.lit("."))
    ours = F.col("framework") == "okhttp"
    on = r.endswith("Request.Builder")
    copies = (F.col("method_name") == "newBuilder") & (F.regexp_extract(text("receiver_type"), r"([^.]*)$", 1) == "Request")
    return [F.bool_or(ours & on & (F.col("method_name") == "url")).alias("_url"), F.bool_or(ours & ((on & (F.col("method_name") == "method")) | copies)).alias("_fixed")]


def requests(calls: DataFrame, events: DataFrame, *keys: str) -> DataFrame:
    """CLS-26: a row for each call with a request role: what it is and what it asks for; events as they end up."""
    fields = ["http_method", "path", "truncated", *[p for p in LISTS if p != "either_names"], "has_body"]
    d = calls.filter("request_role is not null").join(events.select(*keys, "call_id", F.struct(*fields).alias("_e")), [*keys, "call_id"], "left")
    # Builders that no event merged keep their own, either_names unresolved.
    got = {f: F.when(F.col("_e").isNotNull(), F.col(f"_e.{f}")).otherwise(F.col(f)) for f in fields}
    return d.select(*keys, "call_id", "line", "method_name", "receiver_type", "callee_signature", "framework", "family", "request_role", *[c.alias(f) for f, c in got.items()])
