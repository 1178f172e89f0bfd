"""Operator 5: line dedup by an exact set-similarity join.

A line is the set of its five-word shingles; a line of one to four words is one token
of all its words, so short lines match equal ones.  Tokens are ordered by rarity: by the
corpus counts of their words, which a first pass gathers into a fixed number of counters,
then by hash.  Any one order gives the same result; a rare one first makes the index
short.  Lines of one token set are one set.  Two sets of the similarity t share a token
among the first n - ceil(t n) + 1 of each (prefix filter), so a row for each set and
prefix token is dealt out by token, once.  Under a token, a set stays if another set
there has a size that t allows (length filter) and the tokens left after the places of
both reach the overlap that t asks for (positional filter); sizes and places travel as
bounds of 8 and 4 bits, which never reject a pair that the exact values would pass.

Tokens whose sets are the same are one group: the tokens of a lone pair of near copies
cost one comparison.  Sets that are in a group are read from the texts once more with all
their tokens and meet there, in blocks of at most 2 * PER_PART sets a task; a pair that
shares several groups is compared in the least of them alone.  Pairs are verified by the
exact Jaccard similarity.  What leaves a task is a row for each set that has links, never
the pairs.  A line goes if a line before it, in the order of documents and lines, has its
set or a similar one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import GOLDEN, block_words, discard, materialize, mix64, release, shingles, unused, drop_columns

SHINGLE, THRESHOLD = 5, 0.8
COUNTERS, PART = 1 << 16, 1 << 10
SUMS = 256  # sums of one part of the counters that are made side by side
PER_PART = 1024  # sets of one side of a comparison
SMALL = 16  # groups of so many sets are compared many at once
HELD = 50_000  # sets of a token that are looked at together
BLOCK = 1 << 19  # bytes of text handled at once; a longer text is a block of its own
STEPS = 4  # classes of sizes in one factor of the threshold
PLACES = 16  # classes of places within a prefix


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], bytes]]:
    """Runs of texts as (their places, their bytes with a line feed after each)."""
    held: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BLOCK:
            yield held, b"\n".join(parts)
            held, parts, size = [], [], 0
        held.append(i)
        parts.append(raw)
        size += len(raw) + 1
    if held:
        yield held, b"\n".join(parts)


def first_lines(raw: bytes, texts: list[str | None]) -> np.ndarray:
    """Number of the first line of each text of a block."""
    return np.cumsum([0, *[(t or "").count("\n") + 1 for t in texts]])


def word_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of all words of the corpus in COUNTERS counters by hash: what comes to the driver is of one size."""
    import pyarrow as pa

    from pyspark import TaskContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, raw in blocks(batch.column(0).to_pylist()):
                total += np.bincount((block_words(raw)[0] >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        parts = total.reshape(-1, PART)
        lane = TaskContext.get().partitionId() % SUMS
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([lane] * len(parts), pa.int32())], names=["part", "counts", "lane"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "counts"])

    # A tree: each task's counts stream into SUMS sums for each part, those into one; a task holds one sum for each part.
    kind = "part int, counts binary"
    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, f"{kind}, lane int")
    first = counted.repartition("part", "lane").mapInArrow(add, kind)
    rows = first.repartition("part").mapInArrow(add, kind).collect()
    out = np.zeros(COUNTERS, np.int64)
    for r in rows:
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.int64)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Whole steps of the logarithm: words of like counts tie, and hashes decide."""
    return np.round(16 * np.log2(1 + counts)).astype(np.int64)


def in_order(line: np.ndarray, rare: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Places in the order of line, rarity and token: by one key of 24, 13 and 27 bits where no two that differ share it."""
    if not len(line) or line.max() >> 24 or rare.max() >> 13:
        return np.lexsort((token, rare, line))
    key = line.astype(np.uint64) << np.uint64(40) | rare.astype(np.uint64) << np.uint64(27) | token >> np.uint64(37)
    order = np.argsort(key)
    key, token_ = key[order], token[order]
    if ((key[1:] == key[:-1]) & (token_[1:] != token_[:-1])).any():
        return np.lexsort((token, rare, line))
    return order


def line_sets(h: np.ndarray, line: np.ndarray, weight: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(line, token) of the distinct tokens of each line that has a word, the rarest of a line first."""
    if not len(h):
        return line, h
    rare = weight[(h >> np.uint64(48)).astype(np.int64)]
    total = np.concatenate([[0], np.cumsum(rare)])
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.append(start, len(line)))
    lines, tokens, rares = [], [], []
    if len(h) >= k:
        inside = line[: len(h) - k + 1] == line[k - 1 :]
        lines, tokens, rares = [line[: len(h) - k + 1][inside]], [shingles(h, k)[inside]], [(total[k:] - total[:-k])[inside]]
    for n in range(1, k):
        at = start[size == n]
        token = np.zeros(len(at), np.uint64)
        for i in range(n):
            token = mix64(token + h[at + i] + GOLDEN)
        lines.append(line[at])
        tokens.append(token)
        rares.append(np.zeros(len(at), np.int64))
    line, token, rare = np.concatenate(lines), np.concatenate(tokens), np.concatenate(rares)
    order = in_order(line, rare, token)
    line, token = line[order], token[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    return line[new], token[new]


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def digests(token: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its tokens."""
    return np.add.reduceat(mix64(token), start).view(np.int64), np.add.reduceat(mix64(token ^ GOLDEN), start).view(np.int64)


def block_sets(texts: list[str | None], weight: np.ndarray) -> Iterator[tuple]:
    """For each block of texts: (places of its texts, text of each set, line of each set, tokens of all, start of each set's, size of each)."""
    for held, raw in blocks(texts):
        h, _, line = block_words(raw)
        line, token = line_sets(h, line, weight)
        if not len(line):
            continue
        start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        head = first_lines(raw, [texts[i] for i in held])
        doc = np.searchsorted(head, line[start], "right") - 1
        yield held, doc, line[start] - head[doc], token, start, np.diff(np.append(start, len(line)))


def size_class(n: np.ndarray, threshold: float) -> np.ndarray:
    """Whole steps of the logarithm of a set's size, at most 255: similar sets are no more than STEPS + 1 apart."""
    return np.minimum(np.floor(STEPS * np.log(n) / -np.log(threshold)), 255).astype(np.int64)


def place_class(place: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(np.floor(PLACES * place / ((1 - threshold) * n) + 1e-9), PLACES - 1).astype(np.int64)


def able_cells(threshold: float) -> np.ndarray:
    """[difference of size classes + STEPS + 1, place class, place class]: whether some sizes and places of those classes pass the positional filter."""
    d = np.arange(-STEPS - 1, STEPS + 2)
    least, most = threshold ** (-(d - 1) / STEPS), threshold ** (-(d + 1) / STEPS)
    left = 1 - np.arange(PLACES) / PLACES * (1 - threshold)
    share = threshold / (1 + threshold)
    one = left[None, :] >= share * (1 + least[:, None]) - 1e-9
    two = left[None, :] >= share * (1 + 1 / most[:, None]) - 1e-9
    return one[:, :, None] & two[:, None, :]


def able(a: np.ndarray, b: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether sets with these low bits (size class, place class) can be similar; the last size class has no upper end."""
    d = (b >> 4) - (a >> 4)
    near = np.abs(d) <= STEPS + 1
    fits = cells[np.where(near, d, 0) + STEPS + 1, a & 15, b & 15]
    return (near & fits) | ((a >> 4) == 255) | ((b >> 4) == 255)


def line_rows(docs: DataFrame, text: str, key: str, counts: np.ndarray, threshold: float) -> DataFrame:
    """A row for each line that has a word: k, pos (line number), d1, d2 (digest of the token set), index.

    The index of a set has a number for each prefix token, which stands with its first
    line (once in a task, so that a line that stands a thousand times is one set): 52
    bits of the token, the size class and the place class.
    """
    import pyarrow as pa

    weight = rarity(counts)
    low = np.uint64(0xFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for held, doc, pos, token, start, n in block_sets(batch.column(1).to_pylist(), weight):
                d1, d2 = digests(token, start)
                on = np.zeros(len(d1), bool)
                for i, d in enumerate(d1.tolist()):
                    if d not in seen:
                        seen.add(d)
                        on[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                take = np.where(on, prefix_length(n, threshold), 0)
                place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                size = np.repeat(n, take)
                bits = size_class(size, threshold) << 4 | place_class(place, size, threshold)
                index = (token[np.repeat(start, take) + place] & ~low) | bits.astype(np.uint64)
                ends = pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32))
                k = batch.column(0).take(pa.array(np.array(held)[doc]))
                yield pa.RecordBatch.from_arrays([k, pa.array(pos.astype(np.int32)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(ends, pa.array(index.view(np.int64)))], names=["k", "pos", "d1", "d2", "index"])
        release()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, pos int, d1 long, d2 long, index array<long>")


def memberships(lines: DataFrame, threshold: float) -> DataFrame:
    """(token, d1): the sets under each prefix token that another set there may be similar to; lines: see line_rows().

    Of a token with more than HELD sets all stay.
    """
    import pyarrow as pa

    cells = able_cells(threshold)

    def kept(key: np.ndarray) -> np.ndarray:
        """Of whole groups in order, the rows that have an able partner."""
        token = key >> 12
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(key)))
        bits = key & 0xFFF
        on = np.zeros(len(key), bool)
        two = start[size == 2]
        on[two] = on[two + 1] = able(bits[two], bits[two + 1], cells)
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            cell, which, times = np.unique(bits[s : s + n], return_inverse=True, return_counts=True)
            fits = able(cell[:, None], cell[None, :], cells)
            fits[np.diag_indices(len(cell))] &= times > 1
            on[s : s + n] = fits.any(axis=1)[which]
        return on

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda key, d1: pa.RecordBatch.from_arrays([pa.array(key >> 12), pa.array(d1)], names=["token", "d1"])
        key, d1, open_ = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key, d1 = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([d1, batch.column(1).to_numpy()])
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])
            key, d1 = key[new], d1[new]
            token = key >> 12
            if open_ is not None:
                n = int(np.searchsorted(token, open_, "right"))
                if n:
                    yield out(key[:n], d1[:n])
                    key, d1, token = key[n:], d1[n:], token[n:]
                if not len(key):
                    continue
                open_ = None
            # The last group may go on in the next batch.
            n = int(np.searchsorted(token, token[-1], "left"))
            if n:
                on = kept(key[:n])
                yield out(key[:n][on], d1[:n][on])
                key, d1 = key[n:], d1[n:]
            if len(key) > HELD:
                yield out(key, d1)
                open_ = key[-1] >> 12
                key, d1 = key[:0], d1[:0]
        if len(key):
            on = kept(key)
            yield out(key[on], d1[on])

    index = lines.select(F.explode("index").alias("key"), "d1")
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, F.shiftright("key", 12)).sortWithinPartitions("key", "d1")
    return dealt.mapInArrow(under, "token long, d1 long")


def groups_of(members: DataFrame) -> DataFrame:
    """(d1, groups array<struct<id, parts>>): the groups of each set; tokens with the same sets are one group, whose id is the least of those tokens."""
    alike = members.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("d1")).alias("x"), F.bit_xor(F.xxhash64("d1", F.lit(1))).alias("y"))
    kept = alike.filter("n > 1").groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("n") / PER_PART).cast("int").alias("parts"))
    found = members.join(kept.hint("merge"), "token")
    return found.groupBy("d1").agg(F.array_sort(F.collect_set(F.struct(F.col("token").alias("id"), "parts"))).alias("groups"))


_SET = "id long, a int, b int, part int, d1 long, d2 long, k long, pos int, groups binary, tokens binary"


def lines_at(text: str | None, places: list[int]) -> str:
    """The lines of a text at these places, which rise; a place beyond its end has none."""
    lines = (text or "").split("\n")
    return "\n".join([lines[p] for p in places if p < len(lines)])


def set_rows(docs: DataFrame, text: str, key: str, wanted: DataFrame, counts: np.ndarray) -> DataFrame:
    """The sets that wanted (d1, d2, k, pos, groups) names by a line that has them, with their tokens: a row for each of a set's groups.

    A group of several parts is compared part with part, so a set stands once for each
    part that its own meets, under (a, b) with a <= b.
    """
    import pyarrow as pa

    weight = rarity(counts)
    schema = pa.schema([("id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("k", pa.int64()), ("pos", pa.int32()), ("groups", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return done

        for batch in batches:
            texts, keys, asked = (c.to_pylist() for c in batch.columns)
            by = [{r["pos"]: r for r in a} for a in asked]
            places = [sorted(a) for a in by]
            for held, doc, pos, token, start, n in block_sets([lines_at(t, p) for t, p in zip(texts, places, strict=True)], weight):
                d1, d2 = digests(token, start)
                for j, (d, p, e1, e2) in enumerate(zip(doc.tolist(), pos.tolist(), d1.tolist(), d2.tolist(), strict=True)):
                    p = places[held[d]][p]
                    r = by[held[d]][p]
                    # Rows that share a key may hold other texts: only the set that was asked for counts.
                    if r["d1"] != e1 or r["d2"] != e2:
                        continue
                    raw, ids = token[start[j] : start[j] + n[j]].tobytes(), np.array([g["id"] for g in r["groups"]], np.int64).tobytes()
                    for g in r["groups"]:
                        own = e2 % g["parts"]
                        for other in range(g["parts"]):
                            rows.append((g["id"], min(own, other), max(own, other), own, e1, e2, keys[held[d]], p, ids, raw))
                            size += len(raw)
                            if size > 4 * BLOCK:
                                yield flush()
                                size = 0
        if rows:
            yield flush()
        release()

    asked = wanted.groupBy("k").agg(F.collect_list(F.struct("pos", "d1", "d2", "groups")).alias("asked"))
    rows = docs.select(F.col(key).cast("long").alias("dk"), F.col(text).cast("string").alias("t"))
    rows = rows.join(asked.hint("merge"), F.col("dk").eqNullSafe(F.col("k"))).select("t", "k", "asked")
    return rows.mapInArrow(run, _SET)


class Met:
    """The rows of one or more whole groups that meet in a task."""

    def __init__(self, rows: dict[str, list]):
        turn = list(zip(rows["id"], rows["a"], rows["b"], rows["d1"], rows["d2"], strict=True))
        # Rows of documents that repeat show a set again.
        at = np.array(list({t: i for i, t in enumerate(turn)}.values()))
        pick = lambda c: np.array(rows[c])[at]
        self.id, self.a, self.b, self.part, self.d1, self.d2, self.pos = (pick(c) for c in ("id", "a", "b", "part", "d1", "d2", "pos"))
        self.k = [rows["k"][i] for i in at.tolist()]
        sets = [rows["tokens"][i] for i in at.tolist()]
        groups = [rows["groups"][i] for i in at.tolist()]
        self.n = np.array([len(x) // 8 for x in sets])
        self.token, self.owner = np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), self.n)
        size = np.array([len(x) // 8 for x in groups])
        self.others, self.others_of = np.frombuffer(b"".join(groups), np.int64), np.repeat(np.arange(len(groups)), size)
        less = self.others < self.id[self.others_of]
        self.others, self.others_of = self.others[less], self.others_of[less]
        new = np.ones(len(self.id), bool)
        new[1:] = (self.id[1:] != self.id[:-1]) | (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1])
        self.turn = np.cumsum(new) - 1
        self.rank = np.empty(len(self.k), np.int64)
        known = np.array([x is not None for x in self.k])
        self.rank[np.lexsort((self.pos, np.array([x or 0 for x in self.k]), known))] = np.arange(len(self.k))
        self.links = np.zeros(len(self.k), np.int64)
        self.best = np.full(len(self.k), len(self.k), np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, 1)
        np.add.at(self.links, j, 1)
        np.minimum.at(self.best, i, self.rank[j])
        np.minimum.at(self.best, j, self.rank[i])

    def overlaps(self, key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, shared keys) of the pairs i < j of rows of small groups that share one."""
        # One key for group and token, mixed one to one within a group; where those of two groups meet, the exact order.
        turn, key = self.turn[owner], key.view(np.uint64)
        mixed = mix64(key + turn.astype(np.uint64) * GOLDEN)
        order = np.argsort(mixed)
        mixed, ordered = mixed[order], turn[order]
        if ((mixed[1:] == mixed[:-1]) & (ordered[1:] != ordered[:-1])).any():
            order = np.lexsort((owner, key, turn))
        key, owner, turn = key[order], owner[order], turn[order]
        pairs = []
        for lag in range(1, SMALL):
            on = (key[lag:] == key[:-lag]) & (turn[lag:] == turn[:-lag])
            if not on.any():
                break
            one, two = owner[:-lag][on], owner[lag:][on]
            pairs.append(np.minimum(one, two) * len(self.k) + np.maximum(one, two))
        if not pairs:
            return owner[:0], owner[:0], owner[:0]
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        return pair // len(self.k), pair % len(self.k), times

    def small(self, on: np.ndarray, threshold: float) -> None:
        """Compares groups of at most SMALL sets all at once."""
        mine = on[self.owner]
        i, j, both = self.overlaps(self.token[mine], self.owner[mine])
        good = (both >= threshold * (self.n[i] + self.n[j] - both) - 1e-9) & ((self.a[i] == self.b[i]) | (self.part[i] != self.part[j]))
        i, j = i[good], j[good]
        mine = on[self.others_of]
        x, y, _ = self.overlaps(self.others[mine], self.others_of[mine])
        again = np.isin(i * len(self.k) + j, x * len(self.k) + y)
        self.link(i[~again], j[~again])

    def large(self, lo: int, hi: int, threshold: float) -> None:
        """Compares the sets of one group, rows lo to hi: each counts what it shares with all, from an index of their tokens."""
        s, e = np.searchsorted(self.owner, (lo, hi))
        order = np.argsort(self.token[s:e], kind="stable")
        token, owner, n, m = self.token[s:e][order], self.owner[s:e][order] - lo, self.n[lo:hi], hi - lo
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        alone = np.repeat(np.diff(np.append(new, len(token))) == 1, np.diff(np.append(new, len(token))))
        token, owner = token[~alone], owner[~alone]
        if not len(token):
            return
        run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(first, len(token)))
        by = np.argsort(owner, kind="stable")
        runs, ends = run[by], np.searchsorted(owner[by], np.arange(m + 1))
        g0, g1 = np.searchsorted(self.others_of, (lo, hi))
        others, others_of = self.others[g0:g1], self.others_of[g0:g1] - lo
        same = self.a[lo] == self.b[lo]
        part = self.part[lo:hi]
        for i in range(m):
            # Of two parts, one asks.
            if not same and part[i] != self.a[lo]:
                continue
            r = runs[ends[i] : ends[i + 1]]
            if not len(r):
                continue
            c = length[r]
            hit = np.repeat(first[r] - np.cumsum(c) + c, c) + np.arange(c.sum())
            both = np.bincount(owner[hit], minlength=m)
            good = both >= threshold * (n[i] + n - both) - 1e-9
            good &= (np.arange(m) > i) if same else (part != part[i])
            if len(others):
                mine = others[others_of == i] if good.any() else others[:0]
                if len(mine):
                    good[others_of[np.isin(others, mine)]] = False
            j = np.flatnonzero(good)
            if len(j):
                self.link(np.full(len(j), lo + i), lo + j)

    def compare(self, threshold: float) -> None:
        start = np.flatnonzero(np.concatenate([[True], self.turn[1:] != self.turn[:-1]]))
        size = np.diff(np.append(start, len(self.turn)))
        self.small(np.repeat(size <= SMALL, size), threshold)
        for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            self.large(s, s + n, threshold)


def links_within(sets: DataFrame, threshold: float) -> DataFrame:
    """(d1, d2, links, first_k, first_pos): for each set with similar ones, how many, and the earliest line that has one of those; sets: see set_rows().

    A set has a row for each comparison that found it links.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in _SET.split(", ")]
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("links", pa.int64()), ("first_k", pa.int64()), ("first_pos", pa.int32())])

    def answer(rows: dict[str, list]) -> pa.RecordBatch:
        met = Met(rows)
        met.compare(threshold)
        on = np.flatnonzero(met.links)
        order = np.argsort(met.rank)
        first = order[met.best[on]] if len(on) else on
        return pa.RecordBatch.from_arrays([pa.array(met.d1[on]), pa.array(met.d2[on]), pa.array(met.links[on]), pa.array([met.k[i] for i in first.tolist()], pa.int64()), pa.array(met.pos[first].astype(np.int32), pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            for c, v in zip(names, batch.columns, strict=True):
                held[c] += v.to_pylist()
            last = len(held["id"]) - 1
            if last < 2 * PER_PART:
                continue
            turn = lambda i: (held["id"][i], held["a"][i], held["b"][i])
            # The last group may go on in the next batch.
            end = last
            while end >= 0 and turn(end) == turn(last):
                end -= 1
            if end >= 0:
                yield answer({c: v[: end + 1] for c, v in held.items()})
                held = {c: v[end + 1 :] for c, v in held.items()}
        if held["id"]:
            yield answer(held)
        release()

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.repartition(n, "id", "a", "b").sortWithinPartitions("id", "a", "b").mapInArrow(run, "d1 long, d2 long, links long, first_k long, first_pos int")


def removed_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with a word: k, n_lines (with a word), n_links, removed (line numbers from 0).

    n_links counts, over its lines, the other token sets that are similar.  Documents
    are ranked by key, null first, lines by number.  Rows that share a key count as one
    document, whose first occurrences stay in each of them: give keys that are unique.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be above 0 and below 1")
    counts = word_counts(docs, text)
    lines = materialize(line_rows(docs, text, key, counts, threshold), "lines")
    firsts = materialize(lines.groupBy("d1", "d2").agg(F.min(F.struct("k", "pos")).alias("first"), F.count("*").alias("copies")), "line-sets")
    members = materialize(memberships(lines, threshold), "line-members")
    groups = materialize(groups_of(members), "line-groups")
    wanted = materialize(firsts.join(groups.hint("merge"), "d1").select("d1", "d2", "first.k", "first.pos", "groups"), "line-wanted")
    discard(members, groups)
    found = materialize(links_within(set_rows(docs, text, key, wanted, counts), threshold), "line-links")
    discard(wanted)
    seen = found.groupBy("d1", "d2").agg(F.sum("links").alias("links"), F.min(F.struct(F.col("first_k").alias("k"), F.col("first_pos").alias("pos"))).alias("other"))
    known = firsts.join(seen, ["d1", "d2"], "left").filter("copies > 1 or links > 0").select("d1", "d2", F.coalesce("links", F.lit(0)).alias("links"), F.least("first", "other").alias("first"))
    known = materialize(known, "line-known")
    discard(firsts, found)
    rows = lines.select("k", "pos", "d1", "d2").join(known, ["d1", "d2"], "left")
    before = F.col("first").isNotNull() & ~F.struct("k", "pos").eqNullSafe(F.struct(F.col("first.k"), F.col("first.pos")))
    gone = F.array_sort(F.collect_set(F.when(before, F.col("pos"))))
    return rows.groupBy("k").agg(F.count("*").alias("n_lines"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"), gone.alias("removed"))


def without(text: str | None, removed: list[int] | None) -> str | None:
    if not isinstance(text, str) or removed is None or not len(removed):
        return text
    gone = set(removed)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the text without its removed lines, and n_lines, n_links, removed; columns of those names are replaced.

    Null and empty texts stay as they are; a text is handled whole, however long.  See
    removed_lines() for keys that repeat.  An empty table gives an empty table.
    """
    docs = drop_columns(docs, "n_lines", "n_links", "removed")
    own = unused(docs, "k")
    found = removed_lines(docs, text, key, threshold).withColumnRenamed("k", own)
    out = docs.join(found, docs[key].cast("long").eqNullSafe(found[own]), "left").drop(own)
    none = F.array().cast("array<int>")
    out = out.withColumns({"n_lines": F.coalesce("n_lines", F.lit(0)).cast("long"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "removed": F.coalesce("removed", none)})

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([without(t, r) for t, r in zip(texts, removed, strict=True)])

    return out.withColumn(text, F.when(F.size("removed") > 0, cut(F.col(text), F.col("removed"))).otherwise(F.col(text)))
