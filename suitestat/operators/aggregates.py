"""Shared aggregates: exact summaries, shares, concentration, and combination tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY = ("count", "min", "max", "mean", "p25", "p50", "p75", "p90")
CRUD = ("create", "read", "update", "delete")
VERBS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE")


def summary(value: str | Column) -> list[Column]:
    """The eight summary columns of a numeric sample; nulls are not in the sample, and all but count are null on an empty one.

    Percentiles are exact, by linear interpolation between order statistics.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    at = F.percentile(x, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)]))
    return [F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), *[F.get(at, i).alias(n) for i, n in enumerate(SUMMARY[4:])]]


def summarize(df: DataFrame, value: str | Column, *keys: str) -> DataFrame:
    """AGG-01: a row of summary columns for each key; one row without keys, even over no rows."""
    return df.groupBy(*keys).agg(*summary(value)) if keys else df.agg(*summary(value))


def share(flag: str | Column, count: str = "true_count", total: str = "total", proportion: str = "proportion") -> list[Column]:
    """AGG-03: how many flags are true, of how many; the proportion is null without any."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return [F.count_if(f).alias(count), F.count(F.lit(1)).alias(total), F.try_divide(F.count_if(f).cast("double"), F.count(F.lit(1))).alias(proportion)]


def count_share(count: str | Column, total: str | Column) -> Column:
    """AGG-04: count over total, null where total is 0."""
    c, t = (F.col(x) if isinstance(x, str) else x for x in (count, total))
    return F.try_divide(c.cast("double"), t)


def domain(spark, column: str, keys: Sequence[str]) -> DataFrame:
    """The fixed keys of a table, in order: a few rows, whose number the caller writes down."""
    return spark.createDataFrame(list(enumerate(keys)), f"rank int, {column} string")


def complete_shares(counts: DataFrame, column: str, keys: Sequence[str], total: Column, count: str = "n") -> DataFrame:
    """AGG-05: a row for each key of a fixed list, 0 where counts has none; total is a constant or a one-row subquery's column."""
    base = domain(counts.sparkSession, column, keys)
    out = base.join(counts, column, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))
    return out.withColumn("total", total.cast("long")).withColumn("proportion", count_share(count, "total"))


def observed_and_canonical(counts: DataFrame, column: str, keys: Sequence[str], count: str = "n") -> DataFrame:
    """AGG-13: canonical keys in their order (0 where absent), then the others by name."""
    out = domain(counts.sparkSession, column, keys).join(counts, column, "full")
    return out.select(column, F.coalesce(count, F.lit(0)).cast("long").alias(count), F.coalesce("rank", F.lit(len(keys))).alias("rank"))


def code_order(code: str | Column) -> list[Column]:
    """AGG-06: order of status codes: numbers by value, then other text."""
    c = F.col(code) if isinstance(code, str) else code
    return [c.try_cast("int").asc_nulls_last(), c.asc()]


def top_count(n: Column, percent: float) -> Column:
    """ceil(n * percent / 100), at least 1 where there is anything."""
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n * percent / 100.0))).cast("long")


def ranked_runs(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Values in descending order with how many items come before: counts by value, so that no item is ranked by itself.

    A rank over items would send each key's items through one task; there are far
    fewer distinct values than items.
    """
    runs = df.groupBy(*keys, F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("v"))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*keys)
    return runs.withColumn("before", before).withColumn("items", F.sum("n").over(whole)).withColumn("total_value", F.sum(F.col("v") * F.col("n")).over(whole))


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with a rank over all rows (from 1, in order; rows that compare equal rank in any order).

    Rows are dealt to partitions by ranges of the order and numbered within them; what the
    partitions before hold is added.  Only counts of partitions are summed in one place.
    The numbered rows are written once, so that counts and rows see the same ranges.
    """
    from suitestat.functions.lineage import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = cut(dealt.withColumn("_rank_at", F.monotonically_increasing_id()))
    part = F.shiftright("_rank_at", 33)
    counts = numbered.groupBy(part.alias("_rank_part")).agg(F.count(F.lit(1)).alias("_rank_n"))
    before = F.coalesce(F.sum("_rank_n").over(Window.orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = counts.select("_rank_part", before.alias("_rank_before"))
    return numbered.withColumn("_rank_part", part).join(F.broadcast(offsets), "_rank_part").withColumn(name, (F.col("_rank_before") + F.col("_rank_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("_rank_at", "_rank_part", "_rank_before")


def concentration(df: DataFrame, value: str, *keys: str, percents: Sequence[int] = (1, 5, 10, 25)) -> DataFrame:
    """AGG-07/08: the share of the total that the items of the top percents hold, one row for each key and percent.

    Columns: keys, percent, item_count (all), total, top_count, share_of_total (null
    where the total is 0).
    """
    runs = ranked_runs(df, value, *keys)
    cut = runs.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    cut = cut.withColumn("top_count", F.when(F.col("items") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("items") * F.col("percent") / 100.0))).cast("long"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("top_count") - F.col("before")))
    return cut.groupBy(*keys, "percent").agg(F.max("items").alias("item_count"), F.max("total_value").alias("total"), F.max("top_count").alias("top_count"), F.try_divide(F.sum(taken * F.col("v")).cast("double"), F.max("total_value")).alias("share_of_total"))


def evenness(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """AGG-09: the top decile's share of the total over its share of the items."""
    top = concentration(df, value, *keys, percents=(10,))
    return top.withColumn("evenness_ratio", F.try_divide(F.col("share_of_total"), F.try_divide(F.col("top_count").cast("double"), F.col("item_count"))))


def canonical(ops: str | Column, order: Sequence[str] = CRUD) -> Column:
    """AGG-12: the distinct members of an array that order has, in that order."""
    return F.array_intersect(F.array(*[F.lit(o) for o in order]), F.col(ops) if isinstance(ops, str) else ops)


def combination_label(ops: str | Column) -> Column:
    """AGG-10: x-only for one operation, a hyphen-joined list for more."""
    o = F.col(ops) if isinstance(ops, str) else ops
    return F.when(F.size(o) == 1, F.concat(F.get(o, 0), F.lit("-only"))).otherwise(F.array_join(o, "-"))


def subsets(order: Sequence[str] = CRUD) -> list[str]:
    """Labels of the non-empty subsets, by size and then by place."""
    n = len(order)
    every = sorted((tuple(i for i in range(n) if m >> i & 1) for m in range(1, 1 << n)), key=lambda t: (len(t), t))
    return [f"{order[t[0]]}-only" if len(t) == 1 else "-".join(order[i] for i in t) for t in every]


def combination_table(df: DataFrame, ops: str, order: Sequence[str] = CRUD) -> DataFrame:
    """AGG-11: every non-empty subset with its count (0 where none has it) and share of the rows that have one."""
    some = df.filter(F.size(ops) > 0).withColumn("combination", combination_label(canonical(ops, order)))
    counts = some.groupBy("combination").agg(F.count(F.lit(1)).alias("n"))
    base = domain(df.sparkSession, "combination", subsets(order)).join(counts, "combination", "left")
    base = base.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    whole = Window.partitionBy()  # a row for each subset
    return base.withColumn("total", F.sum("n").over(whole)).withColumn("proportion", count_share("n", "total")).select("combination", "n", "total", "proportion")
