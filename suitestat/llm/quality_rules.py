"""Operator 3: quality rules as a learned decision list, in DataFrame operations only.

Base statistics of every whole text are computed within its row, by array
functions.  A decision list for the negative class is then learned by sequential
covering: a rule is a conjunction of thresholds (feature <= t or feature > t) that
grows on two thirds of the labelled rows by FOIL's information gain and is pruned
on the other third; rows it covers are set aside and the next rule is grown.  The
learner sees labelled rows as counts by (feature, bin, label) that Spark aggregates;
thresholds are quantiles of the labelled rows.  The list becomes one ordered
CASE WHEN expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import id_hash, materialize, unused, drop_columns, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHINGLE = 5


def features() -> dict[str, Column]:
    """Rates that rules may use; null where there is no denominator, which no condition covers."""
    c = F.col
    return {
        "n_words": c("n_words").cast("double"),
        "word_length": F.try_divide(c("word_chars"), c("n_words")),
        "symbols_per_word": F.try_divide(c("n_symbols"), c("n_words")),
        "dup_line_rate": F.try_divide(c("n_dup_lines"), c("n_lines")),
        "repeat_rate": F.try_divide(c("n_repeat_words"), c("n_words")),
        "upper_rate": F.try_divide(c("n_upper"), c("word_chars")),
        "distinct_rate": F.try_divide(c("n_distinct"), c("n_words")),
    }


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with STATS, n_lines, n_upper and n_distinct in place of the text.

    Words in windows found twice: windows are hashed with 64 bits; only texts in
    which a hash occurs twice sort their windows.  Sorted (hash, position) pairs show
    the repeated positions, and sorted positions the words they cover, so the work is
    n log n in the words of a text.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    t, w, h, l_, s, p = (unused(docs, name) for name in "twhlsp")
    d = docs.withColumn(t, whole).withColumn(w, words(F.col(t)))
    d = d.withColumn("n_words", F.size(w).cast("long"))
    d = d.withColumn(h, F.when(F.col("n_words") > SHINGLE, F.transform(F.sequence(F.lit(1), (F.col("n_words") - SHINGLE + 1).cast("int")), lambda i: F.xxhash64(F.slice(F.col(w), i, SHINGLE)))).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn(l_, lines)
    d = d.withColumns(
        {
            "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(l_).cast("long"),
            "n_dup_lines": (F.size(l_) - F.size(F.array_distinct(l_))).cast("long"),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_distinct": F.size(F.array_distinct(w)).cast("long"),
            s: F.when(F.size(h) > F.size(F.array_distinct(h)), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
        }
    ).drop(t, w, l_, h, text)
    before, after = (lambda i: F.get(F.col(s), i - 1)["h"]), (lambda i: F.get(F.col(s), i + 1)["h"])
    twice = F.filter(s, lambda x, i: (x["h"] == F.coalesce(before(i), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(after(i), F.bitwise_not(x["h"]))))
    d = d.withColumn(p, F.sort_array(F.transform(twice, lambda x: x["i"]))).drop(s)
    covered = F.transform(p, lambda x, i: F.least(F.lit(SHINGLE), F.coalesce(F.get(F.col(p), i + 1) - x, F.lit(SHINGLE))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop(p)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# ---- the learner


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return F.coalesce(x > self.threshold if self.above else x <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def learn(labelled: DataFrame, names: list[str], bins: int = 64, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_support: float = 0.002) -> list[Rule]:
    """Rules for the rows with bad = 1, in order.  labelled: bad (0/1), fold (0 prunes, others grow), and the features.

    A rule is kept if, on rows that earlier rules leave, it covers at least the share
    min_support of the growing rows and at least the share min_precision of what it
    covers on the pruning rows is bad.  What the driver gets is counts by feature, bin
    and label: at most len(names) * (bins + 1) * 4 rows a step.
    """
    cuts = quantiles(labelled, names, bins)
    names = [n for n in names if cuts[n]]
    if not names:
        return []
    rules: list[Rule] = []
    left = labelled
    total = None
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = binned_counts(left.filter(covers(rule)), names, cuts)
            pos, neg = (sum(v[b] for k, v in counts.items() if k[0] == names[0] and k[2]) for b in (1, 0))
            if total is None:
                total = pos + neg
            if not pos or not neg:
                break
            best = best_condition(counts, names, cuts, pos, neg, max(1.0, min_support * total))
            if best is None:
                break
            rule += (best,)
        if not rule:
            break
        rule = prune(left, rule)
        held = left.filter(covers(rule)).agg(*[F.count_if((F.col("bad") == b) & ((F.col("fold") == 0) == p)).alias(f"{'p' if p else 'g'}{b}") for b in (0, 1) for p in (True, False)]).first()
        if held["g1"] + held["g0"] < min_support * total or held["p1"] + held["p0"] == 0 or held["p1"] < min_precision * (held["p1"] + held["p0"]):
            break
        rules.append(rule)
        left = left.filter(~covers(rule))
    return rules


def quantiles(df: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Thresholds of each feature: its distinct approximate quantiles, fixed in number."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in names]).first()
    return {n: sorted(set(row[n] or [])) for n in names}


def binned_counts(df: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> dict[tuple[str, int, bool], list[int]]:
    """(feature, bin, grows) -> [rows with bad = 0, rows with bad = 1]; bin = thresholds below the value, -1 for null."""
    def bin_of(n: str) -> Column:
        x = F.col(n)
        return F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[n]]), lambda c: x > c)))

    bins = F.array(*[F.struct(F.lit(n).alias("f"), bin_of(n).alias("b")) for n in names])
    rows = df.select("bad", (F.col("fold") != 0).alias("grows"), F.explode(bins).alias("x")).groupBy("x.f", "x.b", "grows", "bad").count().collect()
    out: dict[tuple[str, int, bool], list[int]] = {}
    for f, b, grows, bad, n in rows:
        out.setdefault((f, b, grows), [0, 0])[int(bad)] += n
    return out


def best_condition(counts: dict, names: list[str], cuts: dict, pos: int, neg: int, least: float) -> Condition | None:
    """The condition of the greatest FOIL gain on the growing rows; ties go to the first feature and the lowest threshold."""
    base, best, found = math.log2(pos / (pos + neg)), 1e-9, None
    for n in names:
        below = [0, 0]
        known = [sum(v[b] for k, v in counts.items() if k[0] == n and k[2] and k[1] >= 0) for b in (0, 1)]
        for i, t in enumerate(cuts[n]):
            got = counts.get((n, i, True), [0, 0])
            below = [below[0] + got[0], below[1] + got[1]]
            for above, (q, p) in ((False, below), (True, (known[0] - below[0], known[1] - below[1]))):
                if p and p + q >= least and p + q < pos + neg:
                    gain = p * (math.log2(p / (p + q)) - base)
                    if gain > best:
                        best, found = gain, Condition(n, above, t)
    return found


def prune(left: DataFrame, rule: Rule) -> Rule:
    """The shortest start of the rule that has the greatest (p - n) / (p + n) on the pruning rows."""
    starts = [rule[: i + 1] for i in range(len(rule))]
    row = left.filter(F.col("fold") == 0).agg(*[F.count_if(covers(s) & (F.col("bad") == b)).alias(f"c{i}_{b}") for i, s in enumerate(starts) for b in (0, 1)]).first()
    worth = [(row[f"c{i}_1"] - row[f"c{i}_0"]) / max(1, row[f"c{i}_1"] + row[f"c{i}_0"]) for i in range(len(starts))]
    return starts[worth.index(max(worth))]


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that covers a row (1 on), 0 for the default."""
    if not rules:
        return F.lit(0)
    head = F.when(covers(rules[0]), 1)
    for i, rule in enumerate(rules[1:], 2):
        head = head.when(covers(rule), i)
    return head.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", train_rows: int = 200_000, seed: int = 3, **learner) -> DataFrame:
    """docs without the text, with STATS, base_failed, rule (0: none) and kept.

    The list is learned from at most about train_rows labelled rows, drawn by a hash
    of the key over the whole table; labels that are null are left out, and of
    repeated labels of one key each counts.  Without labelled rows the list is empty
    and base_failed alone decides.  Null and empty texts have no words: base_failed.
    Rows that repeat stay; columns of docs with the names used here are replaced.
    """
    own = [*STATS, "n_lines", "n_upper", "n_distinct", "base_failed", "rule", "kept"]
    docs = drop_columns(docs, *own, keep=(key,))
    stats = materialize(statistics(docs, text), "quality")
    feats = features()
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, (F.col(label) == 0).cast("int").alias("bad"))
    n = known.count()
    draw = F.pmod(id_hash(F.col(key), seed), F.lit(1_000_000))
    known = known.filter(draw < int(math.ceil(1e6 * min(1.0, train_rows / max(1, n)))))
    fold = F.pmod(id_hash(F.col(key), seed + 1), F.lit(3)).alias("fold")
    labelled = materialize(stats.join(known, key).select("bad", fold, *[c.alias(k) for k, c in feats.items()]), "quality-labelled")
    rules = learn(labelled, list(feats), **learner)
    own = {k: unused(stats, f"_f_{k}") for k in feats}
    out = stats.withColumns({own[k]: c for k, c in feats.items()})
    named = [tuple(Condition(own[c.feature], c.above, c.threshold) for c in r) for r in rules]
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", verdict(named))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*own.values())
