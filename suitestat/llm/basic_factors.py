"""Operator 11: periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q, repeated min_exponent times at
least, that no neighbouring word extends.  For each power of two L the dictionary
names every factor of L words that occurs twice or more in its text: a factor of 2L
words is named by its two halves, and one whose half occurs only once can't recur, so
a level holds only what still repeats.  Occurrences of a factor that fit into twice
its length form one arithmetic progression, whose difference is a period.  So each
factor's successor at a distance p, L/2 < p <= L, proposes the period p; neighbouring
starts that propose the same p are one progression step after step, and their stretch,
with L + p added, is a whole run: it can't be extended (the next start would propose p
too), p is its smallest period (a smaller one would give a nearer successor), and no
other level finds it.  Runs of three periods or more all show at their level.

The texts of a batch are handled together, so numpy works on long arrays; words are
numbered exactly, not hashed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suitestat.llm.common import bound_batches, release, unused

#: Words handled together; a longer text is handled alone.
CHUNK_WORDS = 400_000
MIN_EXPONENT, MIN_LENGTH = 4, 6
NEW = "n_words long, n_runs long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def find_runs(word: np.ndarray, text: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in texts that stand one after another, by start and then period.

    word: number of each word; text: number of its text, not falling.  min_exponent: 3 at least.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods may have no factor of their level")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, size = len(word), 1
    at = np.arange(n)
    key = text.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    while len(at):
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        gap = np.diff(at)
        near = same & (gap <= size) & (2 * gap > size)
        if near.any():
            p, start = gap[near], at[:-1][near]
            order = np.argsort(start)
            p, start = p[order], start[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(p) != 0)]))
            last = np.append(first[1:], len(start)) - 1
            begin, q = start[first], p[first]
            length = start[last] - begin + size + q
            whole = (length >= min_length) & (length >= min_exponent * q)
            found.append((begin[whole], length[whole], q[whole]))
        # What occurs once goes; the others' names are their places in the order.
        name = np.full(n + size, -1, np.int64)
        again = np.append(same, False) | np.insert(same, 0, False) if len(at) > 1 else np.zeros(len(at), bool)
        name[at[again]] = np.insert(np.cumsum(~same), 0, 0)[again] if len(at) > 1 else 0
        at = np.sort(at[again])
        at = at[name[at + size] >= 0]
        key = name[at] * (n + 1) + name[at + size]
        size *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Mask of the words that stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) > 0


def periodic_runs(df: DataFrame, text: str = "text", key: str = "doc_id", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """df without the text, with n_words, n_runs, runs (by start, then period; starts number words from 0) and collapsed.

    collapsed: the words joined by one space, without those that a run repeats after its
    first period.  prepare: changes the words of a text (UTF-8) before, given its key.
    Null and empty texts have no words, no runs and an empty collapsed text.  One row in,
    one row out: repeated rows stay, ties can't arise, and an empty table gives an empty
    table.  Columns of df with those names, in any case, are replaced.  A text is handled
    whole, in memory of some ten numbers a word; texts are chunked by words, not cut.
    """
    import pyarrow as pa

    def flush(rows: list[list[bytes]]) -> tuple[list, list, list]:
        number = defaultdict(count().__next__)
        sizes = np.array([len(ws) for ws in rows], np.int64)
        word = np.fromiter((number[w] for ws in rows for w in ws), np.int64, int(sizes.sum()))
        start, length, period = find_runs(word, np.repeat(np.arange(len(rows)), sizes), min_exponent, min_length)
        first = np.cumsum(sizes) - sizes
        of = np.searchsorted(first, start, side="right") - 1
        own = start - first[of]
        gone = repeats(len(word), start, length, period)
        lo, hi = np.searchsorted(of, np.arange(len(rows)), side="left"), np.searchsorted(of, np.arange(len(rows)), side="right")
        runs, texts = [], []
        for i, ws in enumerate(rows):
            here = slice(lo[i], hi[i])
            runs.append([{"start": s, "length": m, "period": p} for s, m, p in zip(own[here].tolist(), length[here].tolist(), period[here].tolist(), strict=True)])
            if lo[i] < hi[i]:
                ws = [w for w, g in zip(ws, gone[first[i] : first[i] + sizes[i]].tolist(), strict=True) if not g]
            texts.append(b" ".join(ws))
        return sizes.tolist(), runs, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, texts = [], [], []
            rows, held = [], 0
            for i, raw in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                ws = (raw.as_py() or b"").split()  # bytes split on the six ASCII white-space characters alone
                if prepare:
                    ws = prepare(i, ws)
                rows.append(ws)
                held += len(ws)
                if held >= CHUNK_WORDS:
                    for out, new in zip((sizes, runs, texts), flush(rows), strict=True):
                        out += new
                    rows, held = [], 0
            if rows:
                for out, new in zip((sizes, runs, texts), flush(rows), strict=True):
                    out += new
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            new = [pa.array(sizes, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=names)
        release()

    own = StructType.fromDDL(NEW)
    taken = {f.name.lower() for f in own}
    kept = [F.col(f"`{c}`") for c in df.columns if c != text and (c == key or c.lower() not in taken)]
    schema = df.select(*kept).schema
    frame = bound_batches(df).select(*kept, F.col(key).alias(unused(df, "key")), F.col(text).cast("string").cast("binary").alias(unused(df, "raw")))
    for field in own:
        schema = schema.add(field)
    names = schema.names
    return frame.mapInArrow(run, schema)


def repeat_tail(key: int | None, ws: list[bytes]) -> list[bytes]:
    """Plants a repetition into one text of ten, by the checksum of its key; a null key plants none."""
    import zlib

    n = len(ws)
    if not n or key is None or (h := zlib.crc32(str(key).encode())) % 10:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    body = ws[a : a + p]
    return ws[:a] + (body * ((n - a) // len(body) + 1))[: n - a]
