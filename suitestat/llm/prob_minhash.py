"""Operator 7: near-duplicate documents by ProbMinHash, banding and verification.

Distinct shingles of five words weigh 1 each: pairs are verified as sets, and with other
weights sets of one similarity could have signatures of less.  Each shingle is a Poisson process whose
rate is its weight: arrivals come at the sums of exponential gaps (from the shingle's
hash, so they are the same in every document) and fall on random places of the
signature; a place keeps the shingle that arrived first.  A process ends when its
next arrival is later than the latest first arrival of any place.  Two places agree
with the probability Jaccard similarity, which at equal weights is that of the sets.  Bands of the signature give candidate
groups.  Pairs are verified by the exact Jaccard similarity of their shingle sets.

Equal texts are one representative first.  In a candidate group all members are
compared with its head; where a group then still holds several components, members
outside the head's are compared with those of other components, block by block
within tasks.  So no pair that could join two components is left out, and no group is
expanded into rows for its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import GOLDEN, hash_words, materialize, mix64, release, shingles, split_words, unused, drop_columns
from suitestat.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
BLOCK = 200_000  # shingles signed at once


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, places: int) -> np.ndarray:
    """(n, places) shingle hashes for n documents; element i with its weight belongs to document owner[i]."""
    first = np.full(n * places, np.inf)
    sign = np.zeros(n * places, np.uint64)
    element, weight, doc = elements, weights, owner
    clock = np.zeros(len(elements))
    state = mix64(elements)
    while len(element):
        state = mix64(state + GOLDEN)
        clock = clock - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        time = clock / weight
        place = doc * places + (mix64(state ^ GOLDEN) % np.uint64(places)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time == first[place]
        sign[place[won]] = element[won]
        latest = first.reshape(n, places).max(axis=1)
        on = time < latest[doc]
        element, weight, doc, clock, state = element[on], weight[on], doc[on], clock[on], state[on]
    return sign.reshape(n, places)


def shingle_set(text: str | None, k: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """Distinct shingle hashes in order, and a digest of the words."""
    ws = split_words(text)
    found = np.unique(shingles(hash_words(ws), k))
    return found, hashlib.md5(" ".join(ws).encode("utf-8", "surrogatepass")).digest()


def sign(docs: DataFrame, text: str, key: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, digest, bands array<long>) of the documents that have an id and a word."""
    import pyarrow as pa

    def flush(held: list, out: list) -> None:
        if not held:
            return
        sizes = [len(h[2]) for h in held]
        owner = np.repeat(np.arange(len(held)), sizes)
        elements = np.concatenate([h[2] for h in held])
        weights = np.ones(len(elements))
        s = signatures(elements, weights, owner, len(held), bands * rows).reshape(len(held), bands, rows)
        key_ = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(held), bands)).copy()
        for i in range(rows):
            key_ = mix64(key_ * GOLDEN + s[:, :, i])
        out.append(([h[0] for h in held], [h[1] for h in held], key_.view(np.int64)))
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list = []
            out: list = []
            n = 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, digest = shingle_set(t.as_py(), k)
                if len(found):
                    held.append((i, digest, found))
                    n += len(found)
                    if n > BLOCK:
                        flush(held, out)
                        n = 0
            flush(held, out)
            for ids, digests, keys in out:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "digest", "bands"])
        release()

    rows_ = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows_.mapInArrow(run, "id long, digest binary, bands array<long>")


def shingle_table(docs: DataFrame, text: str, key: str, ids: DataFrame, k: int) -> DataFrame:
    """(id, set binary): sorted shingle hashes of the documents that ids names."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k)[0].tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids.hint("merge"), "id", "left_semi")
    return rows.mapInArrow(run, "id long, set binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose shingle sets have the Jaccard similarity."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = 0
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                on.append(both >= threshold * (len(x) + len(y) - both) - 1e-9 if both else False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def across(members: DataFrame, root: DataFrame, sets: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """Links (a, b) between the components that one group holds.

    Of each group, members outside the component of its head ask all members of other
    components.  Blocks of askers meet blocks of members in tasks; what leaves a task is
    at most one link for each asker and component, so nothing grows with the square of
    a group but the comparisons, which an exact answer needs.
    """
    import pyarrow as pa

    placed = members.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "head", "size", "rep", F.coalesce("root", "rep").alias("root"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("rep") == F.col("head"), F.col("root"))).alias("main")).filter("lo <> hi").select("bucket", "main")
    mixed = materialize(mixed, "mixed")
    # The head has been compared with all.
    rows = placed.join(mixed, "bucket").filter("rep <> head")
    n = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    every = F.explode(F.sequence(F.lit(0), n - 1))
    live = rows.withColumn("lb", own).withColumn("ab", every).withColumn("asks", F.lit(False))
    ask = rows.filter("root <> main").withColumn("lb", every).withColumn("ab", own).withColumn("asks", F.lit(True))
    columns = ["bucket", "lb", "ab", "asks", "rep", "root"]
    both = live.select(columns).unionByName(ask.select(columns)).join(sets.withColumnRenamed("id", "rep").hint("merge"), "rep")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        reps, roots, raw = (table.column(c).to_pylist() for c in ("rep", "root", "set"))
        at, live_at = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: list[tuple[int, int]] = []
        if len(at) and len(live_at):
            sets_ = [np.frombuffer(raw[i], np.uint64) for i in live_at.tolist()]
            sizes = np.array([len(x) for x in sets_])
            token, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), sizes)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            live_rep, live_root = np.array([reps[i] for i in live_at]), np.array([roots[i] for i in live_at])
            for i in at.tolist():
                x = np.frombuffer(raw[i], np.uint64)
                lo, hi = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
                n = hi - lo
                hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[hit], minlength=len(sizes))
                on = (both >= threshold * (len(x) + sizes - both) - 1e-9) & (live_root != roots[i])
                for r in np.unique(live_root[on]).tolist():
                    out.append((reps[i], int(live_rep[on & (live_root == r)].min())))
        return pa.Table.from_pylist([{"a": a, "b": b} for a, b in out], schema=schema)

    return both.groupBy("bucket", "lb", "ab").applyInArrow(meet, "a long, b long").distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id) of the documents in a class of two or more: class_id is the smallest id of the class.

    Texts of fewer than k words are one shingle of all their words.  Texts without a
    word, and rows without an id, are in no class.  Rows that repeat an id are
    compared like others and add nothing to the result.  A pair of the similarity
    threshold shares a band with probability 1 - (1 - threshold^rows)^bands: 0.99997
    as set here, more above it.
    """
    signed = materialize(sign(docs, text, key, k, bands, rows), "signed")
    # Copies: one representative for each digest.
    copies = materialize(signed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")), "copies")
    keyed = materialize(copies.select("rep", "n", F.explode("bands").alias("bucket")), "banded")
    # The head of a group is its text with the most copies: the one that near copies are likest to.
    heads = keyed.groupBy("bucket").agg(F.min(F.struct(-F.col("n"), "rep")).alias("head"), F.count("*").alias("size")).filter("size > 1").select("bucket", "head.rep", "size")
    heads = materialize(heads.withColumnRenamed("rep", "head"), "heads")
    members = materialize(keyed.drop("n").join(heads, "bucket"), "members")
    stars = materialize(members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    involved = members.select(F.col("rep").alias("id")).distinct()
    sets = materialize(shingle_table(docs, text, key, involved, k).dropDuplicates(["id"]), "sets")
    linked = materialize(verify(stars, sets, threshold), "linked")
    # What the stars leave: pairs of one group in different components.
    root = materialize(components(linked), "roots")
    more = materialize(across(members.filter("size > 2"), root, sets, threshold), "linked-more")
    root = components(linked.unionByName(more))
    groups = copies.join(root.withColumnRenamed("id", "rep"), "rep", "left").filter("root is not null or n > 1").select("digest", F.coalesce("root", "rep").alias("class_id"))
    groups = materialize(groups, "groups")
    return signed.join(groups, "digest").groupBy("id").agg(F.min("class_id").alias("class_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with class_id (its own id where it is in no class; null without an id) and kept (one document of each class, and all without an id).

    Null and empty texts are in no class; a text is handled whole, however long.  Columns
    of docs with those names, in any case, are replaced.  Rows that repeat an id are one
    document of the classes and all come out.  An empty table gives an empty table.
    """
    docs = drop_columns(docs, "class_id", "kept")
    name = unused(docs, "id")
    found = classes(docs, text, key, **options).withColumnRenamed("id", name)
    out = docs.join(found, docs[key] == found[name], "left").drop(name)
    own = F.col(key).cast("long")
    return out.withColumn("class_id", F.coalesce("class_id", own)).withColumn("kept", F.coalesce(F.col("class_id") == own, F.lit(True)))
