"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words and their starts, pairs of neighbours, and pairs with one or
two words between, hashed into 2^18 places; a feature counts once in a text.
FTRL-proximal has a rate for each coordinate and an L1 term that leaves most weights
at zero.  Spark tasks read the features of a bounded, seeded sample of the labelled
rows; the model is learned from those in one sequence and what goes to the tasks is
one sparse vector of at most 2^18 weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suitestat.llm.common import GOLDEN, WordHashes, bound_batches, id_hash, mix64, release, split_words, drop_columns

BITS = 18
SIZE = 1 << BITS
BIAS = SIZE  # the place of the constant
STEM = 5  # letters of a word's start, which inflected and compound forms share
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


class _Normal(WordHashes):
    """Hashes words in lower case without punctuation at their ends, whole or their first letters."""

    def __init__(self, letters: int | None = None):
        super().__init__(seed=6 if letters is None else 60 + letters)
        self.letters = letters

    def __missing__(self, word: str) -> int:
        value = super().__missing__(word.lower().strip(EDGES)[: self.letters])
        self[word] = value
        return value


_normal: list[_Normal] = []


def features(text: str | None) -> np.ndarray:
    """Places of the features of a whole text, with repeats."""
    if not _normal:
        _normal.extend((_Normal(), _Normal(STEM)))
    ws = split_words(text)
    h, stem = (np.fromiter(map(x.__getitem__, ws), np.uint64, len(ws)) for x in _normal)
    parts = [mix64(h + GOLDEN), mix64(stem)]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append(mix64(mix64(h[:-gap]) + h[gap:] * np.uint64(2 * gap + 1)))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class FTRL:
    """FTRL-proximal: w follows from the sums z and n of each coordinate."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BIAS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def held_out(key: str):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, train_rows: int, seed: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero."""
    import pyarrow as pa

    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("_y"))
    n = known.count()
    draw = F.pmod(id_hash(F.col(key), seed), F.lit(1 << 30)) / float(1 << 30)
    known = known.filter(draw < min(1.0, train_rows / max(1, n)))
    rows = docs.select(key, F.col(text).alias("text")).join(known, key).select(id_hash(F.col(key), seed + 1).alias("h"), F.col("_y").cast("int").alias("y"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.unique(features(t.as_py())).astype("<i4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["h", "y", "at"])

    drawn = rows.mapInArrow(read, "h long, y int, at binary").limit(2 * train_rows).collect()
    drawn.sort(key=lambda r: (r["h"], r["y"], bytes(r["at"])))
    model = FTRL(alpha, beta, l1, l2)
    for _ in range(epochs):
        for r in drawn:
            model.learn(np.append(np.frombuffer(r["at"], "<i4"), BIAS), r["y"])
    w = model.weights(np.arange(SIZE + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def score_text(text: str | None, w: np.ndarray) -> float:
    """Probability of label 1: the sum of the weights of the distinct features."""
    at = features(text)
    at = np.unique(at[w[at] != 0])
    return sigmoid(w[at].sum() + w[BIAS])


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", train_rows: int = 10_000, seed: int = 6, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.05) -> DataFrame:
    """docs with held_out, score and predicted; columns of those names are replaced.

    Labels are read only from rows that are not held out, and about train_rows of
    them at most train the model.  Null and empty texts get the score of the constant
    alone.  Of several labels of one key the greatest counts.  Without labels all
    weights are 0 and every score is 0.5.  A text of any length is read
    whole; rows that repeat stay; a score of exactly 0.5 predicts 1.  An empty table gives an empty table.
    """
    import pyarrow as pa

    docs = drop_columns(bound_batches(docs), "held_out", "score", "predicted")
    at, found = learn(docs, labels, text, key, label, train_rows, seed, epochs, alpha, beta, l1, l2)
    base = docs.withColumn("held_out", held_out(key))
    place = base.columns.index(text)
    names = [*base.columns, "score", "predicted"]
    schema = StructType([*base.schema.fields, *StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(SIZE + 1)
        w[at] = found
        for batch in batches:
            s = np.array([score_text(t.as_py(), w) for t in batch.column(place)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)
        release()

    return base.mapInArrow(run, schema)
