"""Statistics over sequences: transitions, shapes, checks, placement, combinations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitestat.operators.aggregates import count_share, domain, summary

ROLES = ("status", "body", "header")


def transitions(seqs: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """ST1-34/35/37: pairs of neighbouring sequences of a test by value, every cell of the domain, 0 where none; ends with one value only."""
    one = F.when(F.size(column) == 1, F.get(column, 0))
    after = F.lead(one).over(Window.partitionBy("test_id").orderBy("seq"))
    counts = seqs.select(one.alias("source"), after.alias("target")).filter("source is not null and target is not null").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    base = domain(seqs.sparkSession, "source", order).select("source").crossJoin(domain(seqs.sparkSession, "target", order).select("target"))  # the square of a fixed list
    out = base.join(counts, ["source", "target"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    out = out.withColumn("total", F.sum("n").over(Window.partitionBy()))
    return out.withColumn("proportion", count_share("n", "total"))


def self_affinity(cells: DataFrame) -> DataFrame:
    """ST1-36: per operation, marginals, repeats and the lift over independence; and for all operations."""
    same = F.when(F.col("source") == F.col("target"), F.col("n")).otherwise(0)
    s = cells.groupBy(F.col("source").alias("operation")).agg(F.sum("n").alias("s"), F.sum(same).alias("r"), F.max("total").alias("n"))
    t = cells.groupBy(F.col("target").alias("operation")).agg(F.sum("n").alias("t"))
    m = s.join(t, "operation")
    div = lambda a, b: F.try_divide(a.cast("double"), b)
    c = F.col
    rows = m.select("operation", div(c("s"), c("n")).alias("source_share"), div(c("t"), c("n")).alias("target_share"), div(c("r"), c("s")).alias("self_repeat_given_source"), div(c("r") * c("n"), c("s") * c("t")).alias("lift"))
    every = m.agg(div(F.sum(c("s") * c("t")), F.max(c("n") * c("n"))).alias("e"), div(F.sum("r"), F.max("n")).alias("o"))
    total = every.select(F.lit("all").alias("operation"), F.lit(None).cast("double").alias("source_share"), F.col("e").alias("target_share"), F.col("o").alias("self_repeat_given_source"), F.try_divide("o", "e").alias("lift"))
    return rows.unionByName(total)


SHAPES = ("build-dispatch-verification", "build-dispatch-no-verification", "dispatch-only", "dispatch-verification-no-build")


def shapes(seqs: DataFrame) -> DataFrame:
    """ST1-26: sequences by shape, every shape listed."""
    b, v = F.col("builds") > 0, F.col("checks") > 0
    label = F.when(b & v, SHAPES[0]).when(b, SHAPES[1]).when(~v, SHAPES[2]).otherwise(SHAPES[3])
    counts = seqs.filter("requests > 0").groupBy(label.alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    out = domain(seqs.sparkSession, "shape", SHAPES).join(counts, "shape", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("shape", "n", (100.0 * count_share("n", F.sum("n").over(Window.partitionBy()))).alias("percent"))


def unverified(seqs: DataFrame) -> DataFrame:
    """ST1-29: sequences without a check by operation, and whether a later sequence, or one that reads, follows in the test."""
    w = Window.partitionBy("test_id").orderBy("seq")
    reads = F.max(F.array_contains("operations", "read")).over(w.rowsBetween(1, Window.unboundedFollowing))
    bucket = F.when(F.size("operations") == 1, F.get("operations", 0)).otherwise("uncategorized")
    rows = seqs.select("checks", bucket.alias("operation"), reads.alias("later_read"), F.lead("seq").over(w).alias("nxt")).filter("checks = 0")
    counts = rows.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count("nxt").alias("followed_by_sequence"), F.count_if("later_read").alias("followed_by_read"))
    out = domain(seqs.sparkSession, "operation", ("create", "read", "update", "delete", "uncategorized")).join(counts, "operation", "left").drop("rank")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "followed_by_sequence", "followed_by_read")})
    return out.withColumns({"sequence_share": count_share("followed_by_sequence", "n"), "read_share": count_share("followed_by_read", "n")})


def multi_sequence(tests: DataFrame) -> DataFrame:
    """ST1-30..32: tests of several sequences, and the largest tenth of them by size (ties by test).

    The tenth is cut by counts of sizes: only tests of the size at the cut are ranked.
    """
    multi = tests.filter("sequences > 1")
    sizes = multi.groupBy("sequences").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.desc("sequences"))  # a row for each size
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_k", F.ceil(F.sum("_n").over(Window.partitionBy()) * 0.1))
    placed = multi.join(sizes.select("sequences", (F.col("_k") - F.col("_before")).alias("_left"), "_n").filter("_left > 0"), "sequences")
    whole = placed.filter("_left >= _n")
    part = placed.filter("_left < _n").withColumn("_r", F.row_number().over(Window.partitionBy("sequences").orderBy("test_id"))).filter("_r <= _left").drop("_r")
    both = multi.withColumn("cohort", F.lit("multi")).unionByName(whole.unionByName(part).select(*multi.columns, F.lit("top_decile").alias("cohort")))
    rate = lambda c: F.avg(c.cast("int"))
    return both.groupBy("cohort").agg(F.count(F.lit(1)).alias("tests"), F.avg("sequences").alias("mean_sequences"), F.avg("endpoints").alias("mean_endpoints"), rate(F.col("endpoints") >= 2).alias("share_multiple_endpoints"), rate(F.col("re_dispatches")).alias("share_re_dispatches"), rate(F.col("has_repeated")).alias("share_repeated"))


def placement(seqs: DataFrame) -> DataFrame:
    """ST1-33: of tests of several sequences, where checks stand: in the last sequence, before it, both or nowhere."""
    last = F.max_by("checks", "seq")
    tests = seqs.groupBy("test_id").agg(F.count(F.lit(1)).alias("k"), last.alias("end"), F.sum("checks").alias("all")).filter("k > 1")
    end, inside = F.col("end") > 0, F.col("all") > F.col("end")
    label = F.when(end & inside, "both").when(end, "terminal-only").when(inside, "interior-only").otherwise("unverified")
    out = tests.groupBy(label.alias("placement")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("proportion", count_share("n", F.sum("n").over(Window.partitionBy())))


def by_role(seqs: DataFrame) -> DataFrame:
    """A row for each sequence and checked role."""
    return seqs.unpivot(["project_id", "test_id", "seq"], [f"{r}_checks" for r in ROLES], "role", "n").withColumn("role", F.regexp_replace("role", "_checks$", ""))


def checks_per_sequence(seqs: DataFrame) -> DataFrame:
    """ST1-10: per role, the sequences that bear it and how many checks they have."""
    per = by_role(seqs).groupBy("role").agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.expr("n > 0")).alias("bearing"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_checks"), F.count_if(F.expr("n = 1")).alias("exactly_one"), F.count_if(F.expr("n >= 2")).alias("two_or_more"), F.count_if(F.expr("n > 3")).alias("more_than_three"))
    return per.filter("bearing > 0").select("role", "bearing", count_share("bearing", "_t").alias("bearing_share"), "mean_checks", "exactly_one", "two_or_more", "more_than_three")


def blob_or_spread(seqs: DataFrame) -> DataFrame:
    """ST1-11: per role, tests with one check, all checks in one sequence, or checks in several."""
    t = by_role(seqs).groupBy("role", "test_id").agg(F.sum("n").alias("total"), F.count_if(F.expr("n > 0")).alias("bearing"), F.max("n").alias("most")).filter("total > 0")
    label = F.when(F.col("total") == 1, "single-check").when(F.col("bearing") == 1, "concentrated-blob").otherwise("spread-across-sequences")
    out = t.groupBy("role", label.alias("spread")).agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean_checks"), F.max("most").alias("most"))
    return out.withColumn("proportion", count_share("n", F.sum("n").over(Window.partitionBy("role"))))


def co_occurrence(seqs: DataFrame) -> DataFrame:
    """ST1-12/13: body and header checks on one sequence, and in one test, against independence."""
    per_seq = seqs.select(F.lit("sequence").alias("unit"), (F.col("body_checks") > 0).alias("b"), (F.col("header_checks") > 0).alias("h"))
    per_test = seqs.groupBy("test_id").agg(F.sum("body_checks").alias("b"), F.sum("header_checks").alias("h")).select(F.lit("test").alias("unit"), (F.col("b") > 0).alias("b"), (F.col("h") > 0).alias("h"))
    k = per_seq.unionByName(per_test).groupBy("unit").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.expr("b and h")).alias("both_count"), F.count_if("b").alias("body_count"), F.count_if("h").alias("header_count"))
    lift = F.try_divide((F.col("both_count") * F.col("items")).cast("double"), F.col("body_count") * F.col("header_count"))
    return k.withColumns({"header_given_body": count_share("both_count", "body_count"), "body_given_header": count_share("both_count", "header_count"), "lift": lift})


def method_diversity(seqs: DataFrame) -> DataFrame:
    """ST1-38: distinct verbs of a test, over all tests with one and over those of several sequences."""
    v = seqs.select("test_id", "seq", F.explode("verbs").alias("v")).groupBy("test_id").agg(F.count_distinct("v").alias("verbs"), F.count_distinct("seq").alias("n"))
    rows = v.select(F.explode(F.when(F.col("n") > 1, F.array(F.lit("all"), F.lit("multi-request"))).otherwise(F.array(F.lit("all")))).alias("cohort"), "verbs")
    return rows.groupBy("cohort").agg(*summary("verbs"), F.try_divide(F.count_if(F.expr("verbs > 1")).cast("double"), F.count(F.lit(1))).alias("share_multiple"))


def verb_combinations(rseqs: DataFrame) -> DataFrame:
    """ST1-41: observed combinations of verbs on a resource within a test."""
    rows = rseqs.filter(F.size("verbs") > 0)
    out = rows.groupBy(F.array_join("verbs", "-").alias("combination"), F.size("verbs").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("proportion", count_share("n", F.sum("n").over(Window.partitionBy())))


def create_delete_pairing(rseqs: DataFrame) -> DataFrame:
    """ST1-40: of (test, resource) pairs that create, those that delete too."""
    c, d = F.array_contains("exercised", "create"), F.array_contains("exercised", "delete")
    out = rseqs.filter(F.size("exercised") > 0).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.size("exercised") > 1).alias("multi_operation"), F.count_if(c).alias("with_create"), F.count_if(c & d).alias("create_and_delete"))
    return out.withColumn("delete_given_create", count_share("create_and_delete", "with_create"))
