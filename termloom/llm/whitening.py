"""Embedding whitening by QDWH spectral divide and conquer.

Two passes over the vectors give the fit: exact sums of the scaled integers, then the covariance of centred
entries. Each task adds up its own rows; what tasks made is added up in two more rounds of bounded groups, so the
driver gets one matrix whatever the number of rows or tasks. The matrix (dimension x dimension) is split there:
the polar factor of ``V - shift`` by dynamically weighted Halley iterations gives the projector onto the
eigenvectors above the shift, whose range and complement are invariant subspaces; both are split in turn, the
upper one first, until the wanted components stand alone. The components are broadcast, and a third pass measures
the covariance of what the last one then returns.

Edge cases: null and empty vectors, and vectors with null or non-finite entries, or entries so large that the
scaled integer does not fit (2^62), are dropped; vectors of each length are fitted and whitened apart, with their
own n; repeated rows count each; a null vec_id stays; components without variance beyond rounding have null
``whitened`` and do not take part in the identity error, which is 0 where there are none; a deviation beyond a
long is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Groups that the tasks' sums meet in before they meet in one.
SLOTS = 64
_EPS = np.finfo(float).eps


class Fit(NamedTuple):
    """Of the vectors of one length: their number, exact sums, eigenvalues and components (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


# Scaled integers -----------------------------------------------------------------------------------------------------


def scaled(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of usable vectors in a column of lists."""
    lengths = np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()  # null lists have no entries here
    ok = np.repeat(np.arange(len(lengths)), lengths)
    c = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        y = np.floor(c * SCALE)
    bad = np.zeros(len(lengths), bool)
    bad[ok[~(np.abs(y) < 2.0**62)]] = True
    first = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == length) & ~bad)
        if len(rows):
            yield rows, y[first[rows][:, None] + np.arange(length)].astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, in integers of any size where 64 bits might not do."""
    if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in zip(*x.tolist())]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean goes first, in integers, so that no digit of it is lost."""
    whole = np.array([s // n for s in sums])
    return (x - whole).astype(float) - np.array([s % n for s in sums], float) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact."""
    far = max(abs(n * int(v) - s) for m in (x.min(axis=0), x.max(axis=0)) for v, s in zip(m, sums))
    if n * int(np.abs(x).max()) < 1 << 62 and far * far * len(sums) < 1 << 63:
        d = n * x - np.array(sums)
        return (d * d).sum(axis=1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


# Sums over all rows --------------------------------------------------------------------------------------------------

_SUMS = "slot int, dim int, n long, sums array<string>, matrix array<double>"


def _rows(slot: int, got: dict) -> pa.RecordBatch:
    """A row for each length: number, exact sums as digits, matrix row by row."""
    return pa.RecordBatch.from_arrays(
        [pa.array([slot] * len(got), pa.int32()), pa.array(list(got), pa.int32()), pa.array([g[0] for g in got.values()], pa.int64()), pa.array([[str(v) for v in g[1]] for g in got.values()], pa.list_(pa.string())), pa.array([g[2].ravel() for g in got.values()], pa.list_(pa.float64()))],
        ["slot", "dim", "n", "sums", "matrix"],
    )


def _added(got: dict, dim: int, n: int, sums, matrix) -> None:
    n0, s0, m0 = got.get(dim, (0, [0] * len(sums), 0.0))
    got[dim] = (n0 + n, [a + b for a, b in zip(s0, sums)], m0 + matrix)


def _total(df: DataFrame, add) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """What add makes of every batch, added up over all of df: (number, sums, matrix) by length of vector."""

    def partial(batches):
        from pyspark import TaskContext

        got: dict = {}
        for b in batches:
            add(got, b)
        yield _rows(TaskContext.get().partitionId() % SLOTS, got)

    def merge(batches):
        got: dict = {}
        for b in batches:
            for dim, n, sums, matrix in zip(*(b.column(c).to_pylist() for c in ("dim", "n", "sums", "matrix"))):
                _added(got, dim, n, [int(v) for v in sums], np.array(matrix))
        yield _rows(0, got)

    parts = mapped(df, partial, _SUMS).repartition(SLOTS, "slot").mapInArrow(merge, _SUMS)
    rows = parts.repartition(1).mapInArrow(merge, _SUMS).collect()  # SLOTS rows of each length at most, added one by one
    return {r.dim: (r.n, [int(v) for v in r.sums], np.array(r.matrix)) for r in rows}


# Spectral divide and conquer -----------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by dynamically weighted Halley iterations in QR form."""
    m = len(a)
    x = a / np.linalg.norm(a)
    r = np.abs(np.diag(np.linalg.qr(x, mode="r")))
    low = max(r.min() / np.sqrt(m), _EPS * _EPS)  # a lower bound of the singular values; a poor one costs an iteration
    for _ in range(60):
        q = low * low
        d = np.cbrt(4 * (1 - q) / (q * q)) if q < 1 else 0.0
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - q) / (q * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q_, _r = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(m)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q_[:m] @ q_[m:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * q) / (1 + wc * q))
        moved, x = np.linalg.norm(new - x), new
        if moved < np.cbrt(_EPS) and 1 - low < 10 * _EPS:
            break
    return x


def divided(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix that splits a at the shift, and how many columns belong above it; None where it parts nothing."""
    m = len(a)
    if np.linalg.norm(a - shift * np.eye(m)) <= 4 * _EPS * scale:
        return None
    above = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = round(np.trace(above))
    if not 0 < k < m:
        return None
    noise = np.random.default_rng(m).standard_normal((m, m))
    basis = np.linalg.qr(np.hstack([above @ noise[:, :k], noise[:, k:] - above @ noise[:, k:]]))[0]
    basis = np.linalg.qr(np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]]))[0]
    off = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
    return (basis, k) if off <= 50 * m * _EPS * scale else None


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to split at: between diagonal entries near the middle, then anywhere in their range."""
    d = np.sort(np.diag(a))
    gaps = sorted(range(len(d) - 1), key=lambda i: abs(2 * i + 2 - len(d)))
    yield from ((d[i] + d[i + 1]) / 2 for i in gaps[:6])
    mean, spread = np.trace(a) / len(a), np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a)))
    yield mean
    yield from (mean + t * spread for t in np.random.default_rng(len(a)).uniform(-0.7, 0.7, 24))


def spectral(v: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = np.linalg.norm(v)
    wanted = min(len(v), wanted or len(v))
    values, columns, todo = [], [], [np.eye(len(v))]  # invariant subspaces, the uppermost last
    while todo and len(values) < wanted:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        parts = None
        if len(a) > 1:
            parts = next((p for s in _shifts(a) if (p := divided(a, s, scale)) is not None), None)
        if parts is None:  # one column, or eigenvalues that rounding does not tell apart: any basis will do
            values += [a[i, i] for i in range(len(a))]
            columns += [basis[:, i] for i in range(len(a))]
        else:
            q, k = parts
            todo += [basis @ q[:, k:], basis @ q[:, :k]]
    order = sorted(range(len(values)), key=lambda i: -values[i])[:wanted]
    e, w = np.array([values[i] for i in order]), np.column_stack([columns[i] for i in order])
    return e, w / np.sqrt((w * w).sum(axis=0))


# The operator --------------------------------------------------------------------------------------------------------


def fit(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> dict[int, Fit]:
    """A fit for each length of vector."""
    rows = embeddings.select(F.col(vector).alias("vector"))

    def add_sums(got, b):
        for _, x in scaled(b.column("vector")):
            _added(got, x.shape[1], len(x), exact_sums(x), np.zeros(0))

    sums = {dim: (n, s) for dim, (n, s, _) in _total(rows, add_sums).items()}

    def add_products(got, b):
        for _, x in scaled(b.column("vector")):
            y = centred(x, *sums[x.shape[1]])
            _added(got, x.shape[1], len(x), [0], (y.T @ y).ravel())

    out = {}
    for dim, (n, _, products) in (_total(rows, add_products) if sums else {}).items():
        v = products.reshape(dim, dim) / n
        e, w = spectral((v + v.T) / 2, components)
        out[dim] = Fit(n, sums[dim][1], e, w, float(np.trace(v)))
    return out


def projection(f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(columns over sqrt(e), which of them have variance)."""
    has = f.values > len(f.sums) * _EPS * max(f.trace, 0)
    return f.components / np.sqrt(np.where(has, f.values, 1)), has


def identity_error(embeddings: DataFrame, fits: dict[int, Fit], vector: str = "embedding") -> dict[int, float]:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all of them."""
    shared = embeddings.sparkSession.sparkContext.broadcast({d: (f.n, f.sums, *projection(f)) for d, f in fits.items()})

    def add(got, b):
        for _, x in scaled(b.column("vector")):
            n, sums, p, has = shared.value[x.shape[1]]
            z = centred(x, n, sums) @ p[:, has]
            _added(got, x.shape[1], len(x), [0], np.concatenate([z.sum(axis=0), (z.T @ z).ravel()]))

    out = {}
    for dim, (n, _, got) in (_total(embeddings.select(F.col(vector).alias("vector")), add) if fits else {}).items():
        k = int(projection(fits[dim])[1].sum())
        mean = got[:k] / n
        out[dim] = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def whiten(embeddings: DataFrame, fits: dict[int, Fit], errors: dict[int, float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    plain = {d: (f.n, f.sums, *projection(f), np.where(f.trace > 0, f.values / (f.trace or 1), 0.0), errors[d]) for d, f in fits.items()}
    shared = embeddings.sparkSession.sparkContext.broadcast(plain)
    kind = embeddings.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for b in batches:
            for rows, x in scaled(b.column("vector")):
                n, sums, p, has, explained, error = shared.value[x.shape[1]]
                z, k, m = centred(x, n, sums) @ p, p.shape[1], len(rows)
                z = pa.array(z.ravel(), mask=np.tile(~has, m))
                deviation = pa.array(deviations(x, n, sums), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each), z, pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names,
                )

    rows = embeddings.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return mapped(rows, run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
