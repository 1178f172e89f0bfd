"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitestat.functions.lineage import shared_dir

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while a plan runs, and are as before after it."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Rows of an Arrow batch for operators on texts: a batch of 10,000 long texts, several times over, is a large share of an executor.
TEXT_BATCH = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    later readers prune columns.  Spark deletes the shuffle files of the write when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/suitestat-{name}-{uuid.uuid4().hex}"
    batch = int(spark.conf.get(BATCH_SETTING))
    batch = min(batch, TEXT_BATCH) if batch > 0 else TEXT_BATCH
    with settings(spark, {CLEAN_SETTING: "true", BATCH_SETTING: str(batch)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(df: DataFrame) -> DataFrame:
    """Lower the session's rows of an Arrow batch to TEXT_BATCH, where it is above that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > TEXT_BATCH:
        df.sparkSession.conf.set(name, TEXT_BATCH)
    return df


def release() -> None:
    """Give memory that a task has freed back to the system: Python workers live on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has its own rules
        pass


def drop_columns(df: DataFrame, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns that have one of the names, in any case: Spark doesn't tell Score from score."""
    taken = {n.lower() for n in names}
    return df.drop(*[df[f"`{c}`"] for c in df.columns if c.lower() in taken and c not in keep])


def unused(df: DataFrame, name: str) -> str:
    """A column name for an operator's own use that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(id_col: Column, seed: int) -> Column:
    return F.xxhash64(id_col, F.lit(seed))


# ---- 64-bit hashing in numpy -------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen last; forgets all of them when full, so its size is bounded."""

    def __init__(self, limit: int = 200_000, seed: int = 0):
        super().__init__()
        import xxhash

        self.limit, self.seed, self.digest = limit, seed, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word.encode("utf-8", "surrogatepass"), self.seed)
        return value


_hashes: dict[int, WordHashes] = {}


def word_hashes(seed: int = 0) -> WordHashes:
    """One table for each Python worker, kept from task to task."""
    return _hashes.setdefault(seed, WordHashes(seed=seed))


# ---- words of many texts at once

_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
_STEP = np.uint64(0x9FB21C651E98DF25)  # odd, so that it has an inverse
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of _STEP and of its inverse, n at least, kept in the worker."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            steps = np.full(max(n, 1 << 20), base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def block_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, line) of each word of a text in UTF-8, without a step of Python for each word.

    A word's hash is a polynomial of its bytes, taken from running sums; the gap
    characters are ASCII, so bytes show them.  Line numbers count line feeds from 0.
    """
    b = np.frombuffer(raw, np.uint8)
    edge = np.diff(_GAP[b].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, start, np.searchsorted(np.flatnonzero(b == 10), start)


_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def split_words(text: str | None) -> list[str]:
    """The words of a text by the definition of WORD: other Unicode spaces don't split."""
    return [w for w in text.translate(_SPACES).split(" ") if w] if text else []


def hash_words(ws: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(word_hashes(seed).__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the windows of k words, in order; of all words together where there are fewer than k."""
    n = len(h) - k + 1
    if len(h) == 0:
        return h
    if n < 1:
        n, k = 1, len(h)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out + h[i : i + n] + GOLDEN)
    return out
