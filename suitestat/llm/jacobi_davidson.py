"""Operator 12: embedding whitening by a block Jacobi-Davidson method.

Vectors become integers x = floor(1024 c) + 100000 and are written once as blocks of
rows.  The covariance V is never formed: the method needs only products V W with a few
columns W, and each is one Spark job over the blocks.  A block is centred exactly, as
n x - S in integers, before it is multiplied; sums of its products leave a task, never
its rows.

The wanted pairs are searched in a subspace.  A round of Rayleigh-Ritz gives
approximate pairs (e, u) and residuals r; pairs whose residual has reached double
precision are locked, the largest first.  For the others the correction equation
(I - QQ')(V - e I)(I - QQ') t = -r, where Q holds the locked vectors and the pairs of
the round, is solved by a few steps of MINRES.  The recurrences of all pairs run side
by side, so that a step of all of them is one distributed product.  The corrections
extend the subspace, which restarts from its best vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.llm.common import CLEAN_SETTING, materialize, release, settings

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(np.float64).eps)
#: Bytes of a block of rows.
BLOCK_BYTES = 2 << 20
Product = Callable[[np.ndarray], np.ndarray]


# ---- the solver: it sees V only as a product


def orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns that extend against (orthonormal) by the span of x; those that add nothing go."""
    out: list[np.ndarray] = []
    for v in x.T:
        size = np.linalg.norm(v)
        if size == 0 or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):  # again until orthogonal to rounding
            v = v - against @ (against.T @ v)
            for o in out:
                v = v - o * (o @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        if size >= 1e-10:
            out.append(v)
    return np.array(out).T.reshape(len(x), len(out))


def minres(product: Product, shift: np.ndarray, b: np.ndarray, project: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of P(V - shift_j I)P t_j = b_j for all columns at once, P = I - project project'.

    Lanczos with Givens rotations, a recurrence for each column; a column that has been
    reduced enough, or that has broken down, stands still.
    """
    def p(x: np.ndarray) -> np.ndarray:
        x = x - project @ (project.T @ x)
        return x - project @ (project.T @ x)

    d, m = b.shape
    x = np.zeros((d, m))
    v_old, v = np.zeros((d, m)), p(b)
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    live = beta > 0
    v = v / np.where(live, beta, 1.0)
    eta = beta.copy()
    c = c_old = np.ones(m)
    s = s_old = np.zeros(m)
    w = w_old = np.zeros((d, m))
    beta = np.zeros(m)
    for _ in range(steps):
        if not live.any():
            break
        # Only columns that still move are sent out.
        z = np.zeros((d, m))
        z[:, live] = product(v[:, live])
        z = p(z - v * shift) - v_old * beta
        alpha = (v * z).sum(axis=0)
        z = z - v * alpha
        beta_new = np.linalg.norm(z, axis=0)
        rho0 = c * alpha - c_old * s * beta
        rho1 = np.sqrt(rho0 * rho0 + beta_new * beta_new)
        rho2 = s * alpha + c_old * c * beta
        rho3 = s_old * beta
        live = live & (rho1 > 0)
        safe = np.where(rho1 > 0, rho1, 1.0)
        c_new, s_new = rho0 / safe, beta_new / safe
        w_new = (v - w_old * rho3 - w * rho2) / safe
        x = x + np.where(live, c_new * eta, 0.0) * w_new
        eta = np.where(live, -s_new * eta, eta)
        v_old, v = v, z / np.where(beta_new > 0, beta_new, 1.0)
        w_old, w, c_old, c, s_old, s, beta = w, w_new, c, c_new, s, s_new, beta_new
        live = live & (beta_new > EPS * first) & (np.abs(eta) > reduce * first)
    return x


def eigenpairs(product: Product, d: int, k: int, seed: int = 12, steps: int = 4, most: int | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, unit vectors, residuals) of the k largest eigenpairs of the symmetric V of order d, by falling value.

    A pair is locked when its residual is at most 100 roundings of the largest value.
    Raises if that isn't reached, so no half-solved pair comes out.
    """
    k = min(k, d)
    most = min(d, most or max(8 * k, 24))
    w = orthonormal(np.random.default_rng(seed).standard_normal((d, k)), np.zeros((d, 0)))
    aw = product(w)
    locked, values, left = np.zeros((d, 0)), [], []
    for _ in range(rounds):
        need = k - locked.shape[1]
        h = w.T @ aw
        e, y = np.linalg.eigh((h + h.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        u, au = w @ y[:, :need], aw @ y[:, :need]
        r = au - u * e[:need]
        r = r - locked @ (locked.T @ r)
        top = max([*values, e[0], 0.0])
        size = np.linalg.norm(r, axis=0)
        good = 0
        while good < need and size[good] <= 100 * EPS * top:
            good += 1
        if good:
            # The others of the subspace go on, orthogonal to what is locked.
            locked = np.hstack([locked, u[:, :good]])
            values += e[:good].tolist()
            left += size[:good].tolist()
            if locked.shape[1] == k:
                break
            rest = y[:, good:]
            w, aw = w @ rest, aw @ rest
            u, r, e, size = u[:, good:], r[:, good:], e[good:], size[good:]
            need -= good
        if w.shape[1] + locked.shape[1] >= d:
            # The subspace is all of the space, so its pairs are exact but for rounding: fresh products take that away.
            w = orthonormal(w, locked)
            aw = product(w)
            continue
        if w.shape[1] + need > most:
            keep = y[:, good : good + max(need, most // 2)] if not good else np.eye(w.shape[1])[:, : max(need, most // 2)]
            w, aw = w @ keep, aw @ keep
        t = minres(product, e[:need], -r, np.hstack([locked, u]), steps, 0.01)
        new = orthonormal(np.hstack([t, r]) if not t.any() else t, np.hstack([locked, w]))
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + w.shape[1]).standard_normal((d, need)), np.hstack([locked, w]))
        w, aw = np.hstack([w, new]), np.hstack([aw, product(new)])
    else:
        raise RuntimeError(f"Jacobi-Davidson: residuals above double precision after {rounds} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(left)[order]


# ---- blocks of rows, and jobs over them


def block_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(dim int, ids array, x binary): up to BLOCK_BYTES of rows of whole numbers each; rows that have no such vector go.

    An entry beyond 2^53 / 1024 has no exact whole number: such a vector goes with the null and the non-finite ones.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat = v.flatten()  # of the lists that aren't null
            size = pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.append(0, np.cumsum(size))
            c = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            bad = np.append(0, np.cumsum(~(np.abs(c) < (1 << 53) / SCALE)))
            ok = (size > 0) & (bad[off[1:]] == bad[off[:-1]])
            for dim in np.unique(size[ok]):
                rows = np.flatnonzero(ok & (size == dim))
                for part in np.array_split(rows, -(-len(rows) * int(dim) * 8 // BLOCK_BYTES)):
                    x = np.floor(c[off[part][:, None] + np.arange(dim)] * SCALE).astype(np.int64) + SHIFT
                    ids = batch.column(0).take(pa.array(part))
                    one = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), one, pa.array([x.tobytes()], pa.binary())], names=["dim", "ids", "x"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, f"dim int, ids array<{kind}>, x binary")


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, dim)


def _summed(blocks: DataFrame, shape: tuple[int, int], each: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """The sum over all blocks of each(x), a matrix of that shape; a task sends one row for each row of it."""
    import pyarrow as pa

    names = ["i", *(f"v{j}" for j in range(shape[1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += each(_matrix(raw, dim))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), *(pa.array(total[:, j]) for j in range(shape[1]))], names=names)

    schema = "i int, " + ", ".join(f"{n} double" for n in names[1:])
    spark = blocks.sparkSession
    parts = str(min(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": parts, CLEAN_SETTING: "true"}):
        rows = blocks.select("x").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
    out = np.zeros(shape)
    for r in rows:
        out[r["i"]] = r[1:]
    return out


def fit(blocks: DataFrame, dim: int, components: int = COMPONENTS, **solver) -> dict:
    """n, exact sums, trace, and the leading values and vectors of the covariance, by products over the blocks."""
    import pyarrow as pa

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = _matrix(raw, dim)
                n += len(x)
                high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)  # so that no sum of a block overflows
                total = [t + (int(h) << 31) + int(lo) for t, h, lo in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], names=["i", "n", "s"])

    rows = blocks.select("x").mapInArrow(totals, "i int, n long, s string").groupBy("i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).collect()
    n = rows[0][1]
    sums = [0] * dim
    for r in rows:
        sums[r[0]] = int(r[2])
    model = {"n": n, "sums": sums}
    model["trace"] = float(_summed(blocks, (1, 1), lambda x: np.array([[(centred(x, n, sums) ** 2).sum()]]), dim)[0, 0]) / n

    def product(w: np.ndarray) -> np.ndarray:
        def each(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return y.T @ (y @ w)

        return _summed(blocks, w.shape, each, dim) / n

    values, vectors, residuals = eigenpairs(product, dim, components, **solver)
    # A value that is only rounding has no direction to be scaled by.
    real = values > dim * EPS * max(model["trace"], 0.0)
    return model | {"values": values[real], "vectors": vectors[:, real], "residuals": residuals[real]}


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: in 64 bits where they hold it, else in Python's integers."""
    s = np.array(sums, object)
    big = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    return x * np.int64(n) - s.astype(np.int64) if big < 1 << 61 else x.astype(object) * n - s


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return apart(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over a row of (n x - sums)^2, exact; null where that is beyond a long."""
    y = apart(x, n, sums)
    if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
        return (y * y).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(a) ** 2 for a in row) for row in y)]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, **solver) -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error, eigenvalue, residual.

    Vectors that are null or empty, or hold null or non-finite entries, are left out; of
    vectors of several lengths those of the most frequent length stay (of equals, the
    longest).  Null keys and rows that repeat count as rows.  Where the vectors span fewer
    directions than asked for, there are as many components; none at all, or an empty table,
    gives no rows.  Equal eigenvalues share their space: any unit vectors of it may come.
    Other columns of df don't come out; the key can't have the name of a new column.
    """
    import pyarrow as pa

    new = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"
    if key.lower() in {c.split(" ")[0] for c in new.split(", ")}:
        raise ValueError(f"the key can't be named {key}")
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {new}"
    blocks = materialize(block_rows(df, key, vector), "whitening")
    lengths = blocks.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["dim"]
    blocks = blocks.filter(F.col("dim") == dim)
    model = fit(blocks, dim, components, **solver)
    n, sums, k = model["n"], model["sums"], len(model["values"])
    if not k:
        return spark.createDataFrame([], schema)
    scaled = model["vectors"] / np.sqrt(model["values"])

    # The covariance of what comes out, centred before it is multiplied.
    mean = _summed(blocks, (1, k), lambda x: (centred(x, n, sums) @ scaled).sum(axis=0, keepdims=True), dim) / n

    def squares(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ scaled - mean
        return z.T @ z

    error = float(np.abs(_summed(blocks, (k, k), squares, dim) / n - np.eye(k)).max())
    explained, values, residuals = (v.tolist() for v in (model["values"] / model["trace"], model["values"], model["residuals"]))
    names = [key, *(c.split(" ")[0] for c in new.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch.column(1)[i].as_py(), dim)
                ids = batch.column(0)[i].values
                z = centred(x, n, sums) @ scaled
                m = len(x)
                each = np.repeat(np.arange(m), k)
                repeated = lambda v: pa.array(np.tile(v, m))
                columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(z.ravel())]
                yield pa.RecordBatch.from_arrays([*columns, repeated(explained), pa.array(np.full(m * k, error)), repeated(values), repeated(residuals)], names=names)
        release()

    return blocks.select("ids", "x").mapInArrow(run, schema)
