"""Operator 8: substring dedup by hashing of paragraphs or lines.

Units are normalised (lower case, white space folded) and digested with 128 bits.
Digests are grouped over all documents; the earliest occurrence of each by (document,
place) stays and every other goes, with its offsets in the original text.

A passage may start and end within a unit, which no digest of units shows.  So windows of SEED words are hashed too;
of every SEED + 1 neighbouring windows the one of the smallest hash is kept, so two
texts that share 2 * SEED words or more keep a window in common (winnowing).  Repeated
windows of one shift against their first occurrence abut or overlap, and a run of them
is extended word by word to either side against that occurrence.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitestat.llm.common import GOLDEN, WORD, _power, block_words, discard, materialize, mix64, release, unused, drop_columns

SEED = 25  # words of a window

def units_of(text: str, unit: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit that has a word; offsets count code points.

    A line ends at a line feed; a paragraph is a run of lines that have a word.
    """
    at, start, end, ws = 0, 0, 0, []
    for line in [*text.split("\n"), ""] if unit == "paragraph" else text.split("\n"):
        found = line.lower().encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters alone
        if found:
            start, end = (start if ws else at), at + len(line)
            ws += found
        if ws and (unit == "line" or not found):
            yield start, end, len(ws), hashlib.md5(b" ".join(ws)).digest()
            ws = []
        at += len(line) + 1


def unit_rows(docs: DataFrame, text: str, key: str, unit: str) -> DataFrame:
    import pyarrow as pa

    schema = pa.schema([("k", pa.int64()), ("pos", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, found in enumerate(units_of(t or "", unit)):
                    for c, v in zip(cols, (k, pos, *found), strict=True):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols = ([], [], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        release()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, pos int, start int, stop int, words int, digest binary")


def removals(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "paragraph", written: list | None = None) -> DataFrame:
    """What whole units lose.  A row for each document that loses something: k, spans array<struct<start, stop>> in order, words (lost).

    Documents are ranked by key, null first.  Rows that share a key are one document
    to this operator: what one of them has first, none of them loses; give keys that
    are unique.  Digests combine before they shuffle, and only those that occur twice
    are joined back, from a written table, so a unit that a third of all documents
    share is a join whose large side Spark may split.  The tables that the result
    reads are added to written.
    """
    rows = materialize(unit_rows(docs, text, key, unit), "units")
    first = rows.groupBy("digest").agg(F.min(F.struct("k", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    first = materialize(first, "repeated")
    if written is not None:
        written += [rows, first]
    again = rows.join(first, "digest").filter(~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("pos") == F.col("first.pos"))))
    return again.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sum("words").cast("long").alias("words"))


def word_hashes_of(text: str) -> np.ndarray:
    """Hashes of the words in lower case, which has the same white space."""
    return block_words(text.lower().encode("utf-8", "surrogatepass"))[0]


def seeds_of(h: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, 128 bits of digest) of the windows that are kept."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), h[:0], h[:0]
    up, down = _power(len(h) + 1)
    total = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(np.stack([mix64(h), mix64(h ^ GOLDEN)]) * up[: len(h)], axis=1, out=total[:, 1:])
    d1, d2 = mix64((total[:, size:] - total[:, :-size]) * down[:n])
    w = min(size + 1, n)
    at = np.unique(np.arange(n - w + 1) + np.lib.stride_tricks.sliding_window_view(d1, w).argmin(axis=1))
    # One word over and over: windows that abut, and the last, say the same.
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (at[1:] == at[:-1] + 1) & (d1[at[1:]] == d1[at[:-1]])
    head = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(at))))
    at = at[~same[:-1] | ~same[1:] | ((np.arange(len(at)) - head) % size == 0)]
    return at, d1[at], d2[at]


def seed_rows(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [seeds_of(word_hashes_of(t.as_py() or ""), size) for t in batch.column(1)]
            n = np.array([len(f[0]) for f in found], np.int64)
            if n.sum():
                at, d1, d2 = (np.concatenate(c) for c in zip(*found, strict=True))
                k = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([k, pa.array(at.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["k", "pos", "d1", "d2"])
        release()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, pos int, d1 long, d2 long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


LEFT, RIGHT, CORE, WHOLE = range(4)
_ANSWER = "kind int, k long, pos int, hashes array<long>, around array<struct<i:int,start:int,stop:int>>, spans array<struct<start:int,stop:int>>, words long"


def answers(text: str, asked: list[dict], reach: int) -> Iterator[tuple]:
    """(kind, pos, hashes, around, spans, words) of a text: the reach words to the LEFT or RIGHT of each place that is asked for, nearest first,
    and as CORE the merged spans of its runs of windows and whole units, with their words.  around has the bounds of the words beyond those spans."""
    h = word_hashes_of(text)
    n = len(h)
    at = np.array([m.span() for m in re.finditer(WORD, text)], np.int64).reshape(-1, 2)
    start, stop = at[:, 0], at[:, 1]
    step = np.zeros(n + 1, np.int64)
    spans = []
    for r in asked:
        a, b = r["a"], r["b"]
        if r["kind"] == CORE and a < b <= n:
            spans.append((int(start[a]), int(stop[b - 1])))
        elif r["kind"] == WHOLE:
            spans.append((a, b))
            a, b = np.searchsorted(start, (a, b))
        else:
            continue
        step[a] += 1
        step[b] -= 1
    inside = np.cumsum(step)[:n] > 0
    if any(r["kind"] == CORE for r in asked):
        yield CORE, None, None, None, [{"start": a, "stop": b} for a, b in merged(spans)], int(inside.sum())
    for r in asked:
        if r["kind"] == LEFT:
            places = range(min(r["a"], n) - 1, max(r["a"] - reach, 0) - 1, -1)
            bounds = [(i, int(start[i]), int(start[i + 1]) if i + 1 < n else int(stop[i])) for i in places]
        elif r["kind"] == RIGHT:
            places = range(r["a"], min(r["a"] + reach, n))
            bounds = [(i, int(stop[i - 1]) if i else int(start[i]), int(stop[i])) for i in places]
        else:
            continue
        around = [None if inside[i] else {"i": i, "start": a, "stop": b} for i, a, b in bounds]
        yield r["kind"], r["a"], h[list(places)].view(np.int64).tolist(), around, None, None


def removed_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "paragraph", size: int = SEED) -> DataFrame:
    """removals(), and passages that start or end within a unit: every run of 2 * size words or more that an earlier place has.

    Earlier is as in removals(); within a document, windows that overlap their first
    occurrence stay.  A run is extended against the first occurrence of its windows only.
    Where a document loses such a passage, its spans are merged and words counts
    words between the six ASCII white-space characters.
    """
    import pyarrow as pa

    used: list[DataFrame] = []
    whole = materialize(removals(docs, text, key, unit, used), "whole-units")
    discard(*used)
    seeds = materialize(seed_rows(docs, text, key, size), "seeds")
    first = seeds.groupBy("d1", "d2").agg(F.min(F.struct("k", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "first")
    first = materialize(first, "repeated-seeds")
    hits = seeds.join(first, ["d1", "d2"]).select("k", "pos", F.col("first.k").alias("fk"), (F.col("pos") - F.col("first.pos")).alias("shift"))
    hits = hits.filter(~(F.col("k").eqNullSafe(F.col("fk")) & (F.col("shift") < size)))
    w = Window.partitionBy("k", "fk", "shift").orderBy("pos")
    hits = hits.withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(w) > size, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = hits.groupBy("k", "fk", "shift", "run").agg(F.min("pos").alias("a"), (F.max("pos") + size).alias("b")).drop("run")
    runs = materialize(runs, "runs")
    discard(seeds, first)
    side = lambda kind, pos: F.struct(F.lit(kind).alias("kind"), F.col(pos).alias("pos"))
    edges = runs.withColumn("e", F.explode(F.array(side(LEFT, "a"), side(RIGHT, "b")))).select("k", "fk", "e.kind", "e.pos", (F.col("e.pos") - F.col("shift")).alias("fpos")).distinct()
    no = F.lit(None).cast("int").alias("b")
    asks = edges.select("k", "kind", F.col("pos").alias("a"), no).unionByName(edges.select(F.col("fk").alias("k"), "kind", F.col("fpos").alias("a"), no))
    asks = asks.unionByName(runs.select("k", F.lit(CORE).alias("kind"), "a", "b")).distinct()
    asks = asks.unionByName(whole.withColumn("s", F.explode("spans")).select("k", F.lit(WHOLE).alias("kind"), F.col("s.start").alias("a"), F.col("s.stop").alias("b")))
    asked = asks.groupBy("k").agg(F.collect_list(F.struct("kind", "a", "b")).alias("asked"), F.min("kind").alias("least")).filter(F.col("least") < WHOLE)
    names = ["kind", "k", "pos", "hashes", "around", "spans", "words"]
    place = pa.struct([("i", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(place), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for t, k, a in zip(*batch.columns, strict=True):
                for kind, *rest in answers(t.as_py() or "", a.as_py(), size + 1):
                    out.append((kind, k.as_py(), *rest))
                    if len(out) >= 5000:
                        yield flush(out)
                        out = []
            if out:
                yield flush(out)
        release()

    rows = docs.select(F.col(key).cast("long").alias("dk"), F.col(text).cast("string").alias("t"))
    rows = rows.join(asked.hint("merge"), F.col("dk").eqNullSafe(F.col("k"))).select("t", "k", "asked")
    told = materialize(rows.mapInArrow(run, _ANSWER), "passages")
    near = told.filter(F.col("kind") < CORE).dropDuplicates(["k", "kind", "pos"])
    own = near.select(F.col("k").alias("k1"), F.col("kind").alias("kind1"), F.col("pos").alias("pos1"), F.col("hashes").alias("x"), "around")
    theirs = near.select(F.col("k").alias("k2"), F.col("kind").alias("kind2"), F.col("pos").alias("pos2"), F.col("hashes").alias("y"))
    both = edges.join(own, F.col("k").eqNullSafe(F.col("k1")) & (F.col("kind") == F.col("kind1")) & (F.col("pos") == F.col("pos1")))
    both = both.join(theirs, F.col("fk").eqNullSafe(F.col("k2")) & (F.col("kind") == F.col("kind2")) & (F.col("fpos") == F.col("pos2")))
    unlike = F.array_position(F.zip_with("x", "y", lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    alike = F.when(unlike > 0, unlike - 1).otherwise(F.size("x"))
    more = both.select("k", F.explode(F.slice("around", F.lit(1), alike)).alias("e")).filter("e is not null").groupBy(F.col("k").alias("mk")).agg(F.collect_set("e").alias("more"))
    core = told.filter(F.col("kind") == CORE).select("k", "spans", "words").dropDuplicates(["k"])
    found = core.join(more, F.col("k").eqNullSafe(F.col("mk")), "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<i:int,start:int,stop:int>>")))

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def join_spans(spans: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in row])] for row in spans])

    words = F.col("words") + F.size(F.array_distinct(F.transform("more", lambda e: e["i"])))
    ordered = F.array_sort(F.concat("spans", F.transform("more", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop")))))
    found = found.select("k", join_spans(ordered).alias("spans"), words.cast("long").alias("words"), F.lit(1).alias("_r"))
    every = whole.select("k", "spans", "words", F.lit(0).alias("_r")).unionByName(found)
    return every.groupBy("k").agg(F.max_by(F.struct("spans", "words"), "_r").alias("_s")).select("k", "_s.spans", "_s.words")


def cut(text: str | None, spans: list) -> str | None:
    """The text without the spans (sorted, apart), and without the lines that this leaves blank; what stays, stays as it is."""
    if not isinstance(text, str) or spans is None or not len(spans):
        return text
    kept, cuts, at, size = [], [], 0, 0
    for s in spans:
        kept.append(text[at : s["start"]])
        size += len(kept[-1])
        cuts.append(size)
        at = s["stop"]
    left = "".join([*kept, text[at:]])
    out, begin, i = [], 0, 0
    for line in left.split("\n"):
        end = begin + len(line)
        while i < len(cuts) and cuts[i] < begin:
            i += 1
        touched = i < len(cuts) and cuts[i] <= end
        if not touched or line.strip(" \t"):
            out.append(line)
        begin = end + 1
    return "\n".join(out)


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "paragraph", size: int = SEED) -> DataFrame:
    """docs with the text cut, and removed_spans (offsets in the original text) and removed_words.

    A null text stays null and an empty one empty; both lose nothing; a text is handled
    whole, however long, and an empty table gives an empty table.  Columns of docs
    with the names that are added are replaced.  Rows that repeat a key: see removals().  What goes: see removed_passages().
    """
    docs = drop_columns(docs, "removed_spans", "removed_words")
    gone = removed_passages(docs, text, key, unit, size)
    own = unused(docs, "k")
    gone = gone.select(F.col("k").alias(own), F.col("spans").alias("removed_spans"), F.col("words").alias("removed_words"))
    out = docs.join(gone, docs[key].eqNullSafe(gone[own]), "left").drop(own)
    out = out.withColumn("removed_spans", F.coalesce("removed_spans", F.array().cast("array<struct<start:int,stop:int>>"))).withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))

    @F.pandas_udf("string")
    def cut_all(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, s) for t, s in zip(texts, spans, strict=True)])

    return out.withColumn(text, F.when(F.size("removed_spans") > 0, cut_all(F.col(text), F.col("removed_spans"))).otherwise(F.col(text)))
