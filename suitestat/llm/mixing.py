"""Operator 2: mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words.  Targets: sources weigh 1, 2, 3,
repeating, by code point, and share the size of all documents; a target stops at
max_epochs times its source's size and the excess is shared again by weight.  A
source is then taken whole as often as it fits, and what remains of its budget is
fitted by a subset of its documents: counts by exact size go in proportion first,
the largest sizes next, and the last words by bounded-knapsack dynamic programming
over the counts that are left.  Which documents of a size are taken follows a
seeded hash.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitestat.llm.common import id_hash, materialize, n_words, unused, drop_columns

SALTS = 64


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> dict[str | None, Fraction]:
    """Target of each source: exact shares of the size of all, with the excess over the cap shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, out, open_ = Fraction(sum(sizes.values())), {}, list(order)
    while open_:
        unit = budget / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > max_epochs * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = Fraction(max_epochs * sizes[s])
            budget -= out[s]
            open_.remove(s)
    return out


def fit(counts: list[tuple[int, int]], budget: int, window: int = 1 << 16) -> dict[int, int]:
    """size -> how many of its documents to take, so that the sum comes to at most budget and as near as can be found.

    counts: (size, number).  The proportional part leaves less than the sum of the
    distinct sizes; the largest sizes that fit take that down to window words or to
    what no document fits in; the dynamic programme then finds the best sum of at
    most that rest.  Its tables are bits of one integer for each item of a binary
    split of the counts, so at most about window bits times the number of items.
    """
    counts = [(s, n) for s, n in sorted(counts) if s > 0]
    total = sum(s * n for s, n in counts)
    if not counts or budget <= 0:
        return {}
    if budget >= total:
        return dict(counts)
    take = {s: n * budget // total for s, n in counts}
    rest = budget - sum(s * k for s, k in take.items())
    for s, n in reversed(counts):
        if rest <= window:
            break
        more = min(n - take[s], (rest - window + s - 1) // s, rest // s)
        take[s] += more
        rest -= more * s
    # One document of each small size is given back, if it was taken, so that the programme has something to choose from.
    for s, _ in counts:
        if take[s] and rest + s <= window:
            take[s] -= 1
            rest += s
    bound = min(rest, 2 * window)
    mask = (1 << (bound + 1)) - 1
    reached, steps = 1, []
    for s, n in counts:
        left, part = min(n - take[s], bound // s), 1
        while left > 0:
            k = min(part, left)
            before = reached
            reached |= (reached << (s * k)) & mask
            if reached != before:
                steps.append((s, k, before))
            left, part = left - k, part * 2
        if reached >> bound & 1:
            break
    at = reached.bit_length() - 1
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            take[s] += k
            at -= s * k
    return {s: k for s, k in take.items() if k}


def source_plan(by_source: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(_s, words, target, epochs, _rest) of each source, by aggregates: the same numbers as targets() gives, in whole decimals.

    by_source: _s, words.  Sources are numbered in order without a single task.  The
    share of a weight unit only grows while sources reach their cap, so each round is
    one aggregate over the table, and the rounds end when no source is added.
    """
    from suitestat.operators.aggregates import global_rank

    # Code points order as the bytes of UTF-8 do.
    placed = global_rank(by_source, F.col("_s").isNull(), F.col("_s"), name="place")
    unit = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))
    wide = lambda c: c.cast("decimal(38,0)")
    d = materialize(placed.withColumn("w", wide(unit)).withColumn("cap", wide(F.col("words") * max_epochs)), "mix-sources")
    total = d.agg(F.sum("words"), F.sum("w")).first()
    budget, share, reached = int(total[0]), int(total[1]), 0
    while True:
        above = F.col("w") * F.lit(budget).cast("decimal(38,0)") > F.col("cap") * F.lit(share).cast("decimal(38,0)")
        n, held, gone = d.filter(above).agg(F.count("*"), F.sum("cap"), F.sum("w")).first()
        if n == reached:
            break
        reached, budget, share = n, int(total[0]) - int(held), int(total[1]) - int(gone)
        if not share:
            break
    # target = num w / den, or the cap: whole times the source, and what is left of it to the nearest word (halves to even).
    d = d.withColumn("num", F.lit(budget).cast("decimal(38,0)")).withColumn("den", F.lit(max(1, share)).cast("decimal(38,0)"))
    num, den = F.col("num"), F.col("den")
    capped = F.col("w") * num > F.col("cap") * den if share else F.lit(True)
    whole = F.when(F.col("words") == 0, 0).when(capped, max_epochs).otherwise(F.least(F.lit(max_epochs), F.expr("(w * num) div (den * greatest(words, 1))").cast("int")))
    d = d.withColumn("epochs", whole.cast("int")).withColumn("over", F.col("w") * num - den * wide(F.col("epochs") * F.col("words")))
    down = F.expr("over div den")
    twice = (F.col("over") - wide(down) * den) * 2
    up = (twice > den) | ((twice == den) & (down % 2 == 1))
    rest = F.when(capped | (F.col("epochs") >= max_epochs), 0).otherwise(F.greatest(F.lit(0), down + F.when(up, 1).otherwise(0)))
    target = F.when(capped, F.col("cap").cast("double")).otherwise((F.col("w") * num).cast("double") / den.cast("double"))
    return materialize(d.select("_s", "words", target.alias("target"), "epochs", rest.cast("long").alias("_rest")), "mix-plan")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 2, max_sources: int = 100_000) -> DataFrame:
    """docs with size, source_size, target, times (0..max_epochs) and taken = times * size; columns of those names are replaced.

    Null and empty texts have size 0: they are taken as often as their source is taken
    whole.  A null source is a source of its own, the last.  Rows that repeat are
    documents of their own; equal rows may be taken a different number of times, which
    of them doesn't show.  An empty table gives an empty table.  Up to
    max_sources sources are planned on the driver, more by aggregates over the table of
    sources, with the same result.  Sizes of one source meet in
    one group as counts, one for each distinct size (at most the square root of twice
    the source's words).  Documents of one size are ranked within SALTS parts, so that
    a size that a third of all documents have spreads out.
    """
    import pandas as pd

    own = ["size", "source_size", "target", "times", "taken"]
    docs = drop_columns(docs, *own, keep=(key, source, text))
    spark = docs.sparkSession
    h, salt, rank, quota_, epochs, s_ = (unused(docs, name) for name in ("h", "salt", "rank", "quota", "epochs", "s"))
    sized = docs.withColumn("size", n_words(F.col(text))).withColumn(h, id_hash(F.col(key), seed)).withColumn(salt, F.pmod(h, F.lit(SALTS)).cast("int"))
    parts = materialize(sized.groupBy(F.col(source).alias("_s"), "size", F.col(salt).alias("_salt")).agg(F.count("*").alias("_n")), "mix-counts")
    by_source = parts.groupBy("_s").agg(F.sum(F.col("size") * F.col("_n")).alias("words"))
    rows = by_source.limit(max_sources + 1).collect()
    few = len(rows) <= max_sources
    if few:
        sizes = {r["_s"]: int(r["words"]) for r in rows}
        goal = targets(sizes, weights, max_epochs)
        whole = {s: min(max_epochs, int(goal[s] // sizes[s])) if sizes[s] else 0 for s in sizes}
        rest = {s: max(0, round(goal[s] - whole[s] * sizes[s])) if whole[s] < max_epochs else 0 for s in sizes}
        plan = spark.createDataFrame([(s, sizes[s], float(goal[s]), whole[s], rest[s]) for s in sizes], f"{s_} string, source_size long, target double, {epochs} int, _rest long")
    else:
        plan = source_plan(by_source, weights, max_epochs).select(F.col("_s").alias(s_), F.col("words").alias("source_size"), "target", F.col("epochs").alias(epochs), "_rest")
    sent = F.broadcast if few else lambda d: d.hint("merge")  # a row for each source: at most max_sources are broadcast

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["_s"].iloc[0]
        s = None if s is None or s != s else s
        take = fit(list(zip(pdf["size"].tolist(), pdf["_n"].tolist(), strict=True)), int(pdf["_rest"].iloc[0]))
        return pd.DataFrame({"_s": pd.Series([s] * len(take), dtype=object), "size": pd.Series(list(take), dtype="int64"), "more": pd.Series(list(take.values()), dtype="int64")})

    by_size = parts.groupBy("_s", "size").agg(F.sum("_n").alias("_n"))
    by_size = by_size.join(sent(plan.select(F.col(s_).alias("_p"), "_rest")), F.col("_s").eqNullSafe(F.col("_p"))).drop("_p")
    more = by_size.groupBy("_s").applyInPandas(choose, "_s string, size long, more long")
    # How many of the documents of each part of a size are taken once more: parts in order, each whole while the number lasts.
    before = F.sum("_n").over(Window.partitionBy("_s", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    same = lambda a, b, cs: [a[c].eqNullSafe(b[c]) for c in cs]
    counted = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    # Both may have a row for each document: never broadcast.
    quota = counted.join(more.hint("merge"), same(counted, more, ["_s", "size"])).select(counted["_s"], counted["size"], "_salt", F.least(F.col("_n"), F.col("more") - F.col("_before")).alias(quota_)).filter(F.col(quota_) > 0)
    quota = materialize(quota, "mix-quota")
    ranked = sized.withColumn(rank, F.row_number().over(Window.partitionBy(source, "size", salt).orderBy(h, key)))
    out = ranked.join(quota.hint("merge"), [ranked[source].eqNullSafe(quota["_s"]), ranked["size"] == quota["size"], ranked[salt] == quota["_salt"]], "left").select(*[ranked[c] for c in ranked.columns], quota_)
    out = out.join(sent(plan), out[source].eqNullSafe(plan[s_]), "left")
    times = F.col(epochs) + F.when(F.col(rank) <= F.coalesce(quota_, F.lit(0)), 1).otherwise(0)
    out = out.withColumn("times", times.cast("int")).withColumn("taken", (F.col("times") * F.col("size")).cast("long"))
    return out.select(*docs.columns, "size", "source_size", "target", "times", "taken")
