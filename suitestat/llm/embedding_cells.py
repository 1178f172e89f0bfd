"""Operator 4: embedding near-dedup by spherical k-means cells and blocked cosine products.

Equal vectors are one representative first.  Spherical k-means, fitted on a bounded
sample, gives every representative its home cell.  A pair above the threshold may
straddle cells, so a vector is also asked of each cell into which a partner could
fall: a partner lies within the angle t = acos(threshold), so its cell c can't be
reached from the home h if y.(h - c) > sin(t) |h - c|.  With that bound no pair is
lost, whatever the centroids are.  Cells are cut into blocks, and blocks of askers meet
blocks of residents as matrix products: each ordered pair is seen once.  What leaves
a block is one row for each linked vector: how many it is linked to, and the
smallest vector it is joined to within the block, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import id_hash, materialize
from suitestat.llm.components import components

THRESHOLD = 0.93


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by way of their largest part so that nothing overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 4) -> np.ndarray:
    """Spherical k-means: unit centroids; an empty cell takes the vector that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        s = x @ c.T
        home = s.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, home, x)
        length = np.sqrt((new * new).sum(axis=1))
        far = np.argsort(s.max(axis=1))
        for i, j in enumerate(np.flatnonzero(length < 1e-9)):
            new[j] = x[far[i % len(far)]]
            length[j] = 1.0
        c = new / length[:, None]
    return c


def probes(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each row, mask of the cells where a partner could be)."""
    s = x @ c.T
    home = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    lead = s[np.arange(len(x)), home][:, None] - s
    return home, lead <= math.sqrt(max(0.0, 1 - threshold * threshold)) * apart[home] + 1e-9


def local_roots(ask: np.ndarray, live: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id joined to each asker and each resident by the links (ask[i], live[j])."""
    a, b = ask.copy(), live.copy()
    while True:
        before = a.sum(dtype=np.float64) + b.sum(dtype=np.float64), a.copy(), b.copy()
        np.minimum.at(b, j, a[i])
        np.minimum.at(a, i, b[j])
        # An id that stands on both sides has one label.
        ids = np.concatenate([ask, live])
        labels = np.concatenate([a, b])
        order = np.lexsort((labels, ids))
        first = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
        least = labels[order][first]
        where = np.searchsorted(ids[order][first], ids)
        a, b = least[where[: len(ask)]], least[where[len(ask) :]]
        if (a == before[1]).all() and (b == before[2]).all():
            return a, b


def vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, dim, v): v holds the floats of a vector that can link, else null."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for i, y, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ok = i is not None and y is not None and v and None not in v
                if ok:
                    a = np.array(v, np.float32)
                    ok = np.isfinite(a).all() and a.any()
                out.append((a + np.float32(0)).tobytes() if ok else None)
                dims.append(len(v) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "dim", "v"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "id long, label string, dim int, v binary")


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, per_cell: int = 500, max_cells: int = 1024, sample: int = 20_000, block: int = 2048, seed: int = 4) -> DataFrame:
    """A row for each row of df: the key, n_links, component_id, kept.

    Vectors link if labels are equal and their cosine is at least the threshold.
    Vectors that are null, empty or zero or hold null or non-finite parts, and rows
    with a null label or key, link with nothing: n_links 0, their own component, kept.
    Vectors of different lengths don't link.  Rows that repeat are vectors of their
    own, linked to each other.  The number of cells of a length follows the number of
    vectors, per_cell each within a label, up to max_cells; centroids are fitted on at
    most about sample vectors, and every vector is asked.
    """
    base = materialize(vectors(df, key, vector, label), "vectors")
    reps = base.filter("v is not null").groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = materialize(reps, "vector-reps")
    sizes = reps.groupBy("dim").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()
    found = None
    for row in sorted(sizes, key=lambda r: r["dim"]):  # a length of vectors is a table of its own; there are few
        part = _links_of(reps.filter(F.col("dim") == row["dim"]), row["n"], row["labels"], threshold, per_cell, max_cells, sample, block, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        out = base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    found = materialize(found, "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    root = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    r = reps.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(root.withColumnRenamed("id", "rep"), "rep", "left")
    r = r.filter("n > 1 or links > 0").select("label", "dim", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    r = materialize(r, "vector-classes")
    out = base.join(r, ["label", "dim", "v"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _links_of(reps: DataFrame, n: int, labels: int, threshold: float, per_cell: int, max_cells: int, sample: int, block: int, seed: int) -> DataFrame:
    """(id, links, root) from the representatives of one length."""
    import pandas as pd
    import pyarrow as pa

    draw = F.pmod(id_hash(F.col("rep"), seed), F.lit(1 << 30)) / float(1 << 30)
    drawn = reps.filter(draw < min(1.0, sample / n)).select("rep", "v").limit(2 * sample).collect() or reps.select("rep", "v").limit(1).collect()
    drawn.sort(key=lambda r: r["rep"])
    x = unit(matrix([bytes(r["v"]) for r in drawn]))
    k = max(1, min(max_cells, len(x), -(-n // (per_cell * max(1, labels)))))
    centroids = kmeans(x, k, seed=seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vs = batch.column(1).to_pylist()
            for s in range(0, len(vs), 4096):
                home, mask = probes(unit(matrix(vs[s : s + 4096])), centroids, threshold)
                i, c = np.nonzero(mask)
                rows = batch.slice(s, 4096).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(c.astype(np.int32)), pa.array(home[i] == c)], names=["label", "v", "rep", "n", "cell", "home"])

    placed = materialize(reps.select("label", "v", "rep", "n").mapInArrow(place, "label string, v binary, rep long, n long, cell int, home boolean"), "placed-vectors")
    cells = placed.groupBy("label", "cell").agg(F.count_if("home").alias("live"), F.count("*").alias("ask")).filter("live > 0")
    cells = materialize(cells.select("label", "cell", F.ceil(F.col("live") / block).cast("int").alias("lives"), F.ceil(F.col("ask") / block).cast("int").alias("asks")), "cells")
    both = placed.join(cells, ["label", "cell"])
    mine = F.pmod(id_hash(F.col("rep"), seed + 1), F.lit(1 << 30))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    live = both.filter("home").withColumn("lb", F.pmod(mine, F.col("lives")).cast("int")).withColumn("ab", span("asks")).withColumn("asks_", F.lit(False))
    ask = both.withColumn("ab", F.pmod(mine, F.col("asks")).cast("int")).withColumn("lb", span("lives")).withColumn("asks_", F.lit(True))
    columns = ["label", "cell", "lb", "ab", "asks_", "rep", "n", "v"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks_"]], pdf[~pdf["asks_"]]
        none = pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        if a.empty or b.empty:
            return none
        ask, live, n = a["rep"].to_numpy(), b["rep"].to_numpy(), b["n"].to_numpy()
        near = unit(matrix(a["v"].tolist())) @ unit(matrix(b["v"].tolist())).T >= threshold
        near &= ask[:, None] != live[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            return none
        links = np.bincount(i, n[j], len(ask)).astype(np.int64)
        ra, rb = local_roots(ask, live, i, j)
        on = np.unique(j)
        return pd.DataFrame({"id": np.concatenate([ask[links > 0], live[on]]), "links": np.concatenate([links[links > 0], np.zeros(len(on), np.int64)]), "root": np.concatenate([ra[links > 0], rb[on]])})

    return live.select(columns).unionByName(ask.select(columns)).groupBy("label", "cell", "lb", "ab").applyInPandas(meet, "id long, links long, root long")
