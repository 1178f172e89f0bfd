"""Operator 9: language identification by a convolutional network over bytes.

Filters of widths 2, 3 and 4 run over windows of 256 bytes; the largest answer of
each filter in a window passes a rectifier and a softmax layer.  Filters read bytes
as one-hot columns, so a filter is a table row for each byte and offset.  Training
is plain numpy (Adam on the cross entropy); the gradient of a maximum touches one
place for each filter.  A document's language is that of the greatest mean
probability over all windows of its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import bound_batches, id_hash, release, unused, drop_columns

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> dict[str, np.ndarray]:
        """Tables by two bytes, so that a filter of width 4 is two look-ups."""
        t = self.tables
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return {"2": two(t[2][0], t[2][1]), "3": two(t[3][0], t[3][1]), "4a": two(t[4][0], t[4][1]), "4b": two(t[4][2], t[4][3])}


def answers(net: Network, x: np.ndarray, pairs: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each width, (windows, places, FILTERS)."""
    wide = x.astype(np.int32)
    two = (wide[:, :-1] << 8) | wide[:, 1:]
    a2 = pairs["2"].take(two, axis=0)
    a3 = pairs["3"].take(two[:, :-1], axis=0)
    a3 += net.tables[3][2].take(wide[:, 2:], axis=0)
    a4 = pairs["4a"].take(two[:, :-2], axis=0)
    a4 += pairs["4b"].take(two[:, 2:], axis=0)
    return [a2, a3, a4]


def probabilities(net: Network, x: np.ndarray, pairs: dict[str, np.ndarray], block: int = 128) -> np.ndarray:
    """(windows, languages), a block of windows at a time."""
    out = np.empty((len(x), len(net.languages)), np.float32)
    for i in range(0, len(x), block):
        top = np.concatenate([a.max(axis=1) for a in answers(net, x[i : i + block], pairs)], axis=1)
        out[i : i + block] = softmax(np.maximum(top + net.bias, 0) @ net.out + net.out_bias)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 9) -> Network:
    """x: (windows, WINDOW) bytes, y: index of the language of each."""
    rng = np.random.default_rng(seed)
    n, k = len(WIDTHS) * FILTERS, len(languages)
    net = Network(languages, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(n, np.float32), rng.normal(0, 0.3, (n, k)).astype(np.float32), np.zeros(k, np.float32))
    params = [*(net.tables[w] for w in WIDTHS), net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            every = answers(net, xb, net.pairs())
            places = [a.argmax(axis=1) for a in every]
            top = np.concatenate([np.take_along_axis(a, p[:, None, :], axis=1)[:, 0] for a, p in zip(every, places, strict=True)], axis=1)
            hidden = np.maximum(top + net.bias, 0)
            d = softmax(hidden @ net.out + net.out_bias)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            back = (d @ net.out.T) * (hidden > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                part = back[:, j * FILTERS : (j + 1) * FILTERS].ravel()
                g = np.empty((w, 256, FILTERS), np.float32)
                for o in range(w):
                    seen = np.take_along_axis(xb, places[j] + o, axis=1).astype(np.int64) * FILTERS + np.arange(FILTERS)
                    g[o] = np.bincount(seen.ravel(), part, 256 * FILTERS).reshape(256, FILTERS)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows of whole texts, the last one of each filled with zero bytes; and how many each text has (1 or more)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(b) // WINDOW)) for b in raw])
    whole = b"".join(b.ljust(c * WINDOW, b"\0") for b, c in zip(raw, counts.tolist(), strict=True))
    return np.frombuffer(whole, np.uint8).reshape(-1, WINDOW), counts


def held_out(key: str) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, text: str, lang: str, key: str, train_docs: int, windows_each: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of about train_docs labelled documents, shared evenly among the languages; at most windows_each from places spread over each whole text."""
    import pyarrow as pa

    known = docs.filter(F.col(lang).isNotNull() & ~held_out(key) & F.col(text).rlike(r"\p{L}"))
    counts = {r[lang]: r["count"] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    languages = sorted(counts)
    share = -(-train_docs // len(languages))
    shares = docs.sparkSession.createDataFrame([(name, float(min(1.0, share / counts[name]))) for name in languages], "_lang string, _share double")
    if len(languages) <= 1000:  # a row for each language; more are left to Spark
        shares = F.broadcast(shares)
    draw = F.pmod(id_hash(F.col(key), seed), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(shares, F.col(lang) == F.col("_lang")).filter(draw < F.col("_share")).select(F.col(lang).alias("lang"), F.pmod(id_hash(F.col(key), seed + 1), F.lit(1 << 30)).alias("h"), F.col(text).alias("text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_lang, out_x = [], []
            for name, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                rng = np.random.default_rng(h)
                n = min(windows_each, -(-len(raw) // WINDOW))
                for s in rng.integers(0, max(1, len(raw) - WINDOW + 1), n).tolist():
                    out_lang.append(name)
                    out_x.append(raw[s : s + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_x, pa.binary())], names=["lang", "x"])

    rows = drawn.mapInArrow(pick, "lang string, x binary").limit(4 * share * len(languages) * windows_each).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(-1, WINDOW)
    at = {name: i for i, name in enumerate(languages)}
    return x, np.array([at[r["lang"]] for r in rows], int), languages


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = 2000, windows_each: int = 4, seed: int = 9) -> DataFrame:
    """docs with held_out, lang_pred and score (mean probability of lang_pred over the windows); columns of those names are replaced.

    Null texts and texts without a letter are und with score 0; so is every text if
    there is nothing to learn from.  Each language of the labelled rows has a column of
    the softmax and at least one document to learn from, however many there are; of
    equal probabilities the first in code-point order wins.  Labels are read only from rows that are not held
    out; about train_docs of them train the network (fewer in a small table).  A text
    of any length is read whole.  Rows that repeat stay.
    """
    import pyarrow as pa

    docs = drop_columns(bound_batches(docs), "held_out", "lang_pred", "score")
    x, y, languages = sample(docs, text, lang, key, train_docs, windows_each, seed)
    net = train(x, y, languages) if languages else None
    base = docs.withColumn("held_out", held_out(key)).withColumn(letters := unused(docs, "letters"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = base.columns[:-1]
    schema = base.drop(letters).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs() if net else {}
        for batch in batches:
            letter = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            pred, score = [UNKNOWN] * len(letter), np.zeros(len(letter))
            at = np.flatnonzero(letter) if net else np.zeros(0, int)
            texts = batch.column(names.index(text))
            for i in range(0, len(at), 64):
                part = at[i : i + 64]
                xs, counts = windows([texts[j].as_py() for j in part.tolist()])
                p = probabilities(net, xs, pairs)
                mean = np.add.reduceat(p, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
                best = mean.argmax(axis=1)
                for j, b in zip(part.tolist(), best.tolist(), strict=True):
                    pred[j] = languages[b]
                score[part] = np.clip(mean.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])
        release()

    return base.mapInArrow(run, schema)
