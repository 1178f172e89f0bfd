"""Tables behind figures: categories and series over suites.  Columns: suite, category, value, pos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_union(series: DataFrame) -> DataFrame:
    """FIG-01: categories in the order in which suites first show them."""
    return series.groupBy("category").agg(F.min(F.struct("suite_rank", "pos")).alias("first")).select("category", F.row_number().over(Window.orderBy("first", "category")).alias("place"))


def prune_zeros(series: DataFrame) -> DataFrame:
    """FIG-02: without categories that are zero or null in every suite."""
    some = series.groupBy("category").agg(F.bool_or(F.coalesce(F.col("value") != 0, F.lit(False))).alias("_s")).filter("_s").select("category")
    return series.join(some, "category", "left_semi")


def drop_unknown(series: DataFrame, unknown: str = "unknown") -> DataFrame:
    """FIG-03."""
    return series.filter(F.col("category") != unknown)


def rescale_without_unknown(series: DataFrame, total: float = 100.0, unknown: str = "unknown") -> DataFrame:
    """FIG-04: shares scaled by total / (total - the unknown share) of their suite."""
    share = F.coalesce(F.sum(F.when(F.col("category") == unknown, F.col("value"))).over(Window.partitionBy("suite")), F.lit(0.0))
    return series.withColumn("value", F.try_divide(F.col("value") * total, total - share)).filter(F.col("category") != unknown)


def box(summaries: DataFrame) -> DataFrame:
    """FIG-05: what a box plot needs, of summaries that are not empty."""
    return summaries.filter("count > 0").select(*[c for c in summaries.columns if c not in ("count", "max")])


def scope_links(scopes: DataFrame) -> DataFrame:
    """FIG-06: links of the scope split between its three levels."""
    a = scopes.groupBy(F.concat(F.lit("requests:"), "requests").alias("source"), F.concat(F.lit("resources:"), "resources").alias("target")).agg(F.sum("n").alias("n"))
    b = scopes.groupBy(F.concat(F.lit("resources:"), "resources").alias("source"), F.concat(F.lit("endpoints:"), "endpoints").alias("target")).agg(F.sum("n").alias("n"))
    return a.unionByName(b)


def nonzero_sorted(series: DataFrame) -> DataFrame:
    """FIG-07: categories with a value, the largest first."""
    return series.filter("value > 0").withColumn("place", F.row_number().over(Window.partitionBy("suite").orderBy(F.desc("value"), "category")))


def comparison(series: DataFrame, suites: list[str]) -> DataFrame:
    """FIG-08..13: one statistic over several suites: a row for each category, a column for each suite, null where a suite lacks it."""
    return series.groupBy("category").pivot("suite", suites).agg(F.first("value"))


def skipped(suites: DataFrame, series: DataFrame) -> DataFrame:
    """FIG-08: suites that don't have the statistic."""
    return suites.join(series, "suite", "left_anti")
