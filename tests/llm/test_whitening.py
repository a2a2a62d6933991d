import math
from fractions import Fraction

import numpy as np
import pytest
from termloom.llm import queries, whitening


def brute(rows, components=8):
    """{vec_id: [(component, n, deviation, |whitened|, explained)]} by exact sums and the library's eigenvectors."""
    kept = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for dim in {len(x) for _, x in kept}:
        own = [(i, x) for i, x in kept if len(x) == dim]
        n, sums = len(own), [sum(c) for c in zip(*(x for _, x in own))]
        y = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums)] for _, x in own])
        e, w = np.linalg.eigh(y.T @ y / n)
        e, w = e[::-1][:components], w[:, ::-1][:, :components]
        for (i, x), row in zip(own, y):
            deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
            out[i] = [(k + 1, n, deviation, abs(row @ w[:, k]) / math.sqrt(e[k]) if e[k] > 1e-6 else None, e[k] / max(1e-300, np.trace(y.T @ y / n))) for k in range(len(e))]
    return out


def compare(got, expected):
    assert len(got) == sum(map(len, expected.values()))
    for r in got:
        k, n, deviation, z, explained = expected[r.vec_id][r.component - 1]
        assert (r.component, r.n, r.deviation) == (k, n, deviation)
        assert (r.whitened is None) == (z is None) and (z is None or abs(abs(r.whitened) - z) < 1e-7 * max(1, z))
        assert abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9


def whitened(df, **more):
    fits = whitening.fit(df, **more)
    return whitening.whiten(df, fits, whitening.identity_error(df, fits)).collect()


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'y' as n", "'y' as component", "'y' as key", "'y' as vector").repartition(3)


def test_the_tables_against_another_eigensolver(spark):
    got = queries.op11_whitening(spark, "/root/testdata/sf0.01").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(got, brute(rows))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r.whitened)
    z = np.array([by[k] for k in sorted(by)])
    assert np.abs(z @ z.T / z.shape[1] - np.eye(len(z))).max() < 1e-9  # one sign for all rows


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((40, 12)) * rng.uniform(0.1, 9, 12))]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (101, None), (102, []), (103, [1.0, None] * 6), (104, [float("nan")] * 12), (105, [float("inf")] + [0.0] * 11), (106, [1e300] * 12)]
    rows += [(200 + i, [float(i), 2.0 * i, 5.0]) for i in range(4)]  # another length, of rank one
    got = whitened(frame(spark, rows))
    usable = [(i, v) for i, v in rows if i not in (101, 102, 103, 104, 105, 106)]
    expected = brute(usable)
    assert sorted(str((r.vec_id, r.component)) for r in got) == sorted(str((i, k + 1)) for i, v in usable for k in range(min(8, len(v))))
    for r in got:
        k, n, deviation, z, explained = expected[r.vec_id][r.component - 1]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9
        assert (r.whitened is None) == (z is None) and (z is None or abs(abs(r.whitened) - z) < 1e-7)
    assert all(r.whitened is None for r in got if r.n == 4 and r.component > 1)


def test_equal_rows_empty_tables_and_large_entries(spark):
    equal = whitened(frame(spark, [(1, [1.0, 2.0])] * 3))
    assert len(equal) == 6 and all(r.whitened is None and r.explained == 0 == r.identity_error and r.deviation == 0 for r in equal)
    assert whitened(frame(spark, [])) == [] == whitened(frame(spark, [(1, None)]))
    large = [(i, [float(1 << 40) * i, 1.0 * (i % 3)]) for i in range(5)]
    got, expected = whitened(frame(spark, large)), brute(large)
    assert len(got) == 10 and all(r.deviation == (None if (v := expected[r.vec_id][0][2]) >= 1 << 63 else v) for r in got)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [1e6, 1, 1, 1, 1e-6], [2, 2, 2, 1, 1, 1], [0, 0, 0], [3.0], [1, 1 + 1e-12, 1 - 1e-12, 0.5], list(np.linspace(1, 2, 64)), [7, 7, 7, 7], list(np.geomspace(1, 1e14, 20))])
def test_spectral_divide_and_conquer(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, w = whitening.spectral(a)
    scale = max(1e-300, np.abs(values).max())
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-12 * scale
    assert np.abs(a @ w - w * e).max() < 2e-13 * len(values) * scale
    assert np.abs(w.T @ w - np.eye(len(values))).max() < 1e-12
    e3, _ = whitening.spectral(a, 3)
    assert np.allclose(e3, e[:3], atol=1e-12 * scale)


def test_polar_factor_of_an_indefinite_matrix():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((30, 30)))[0]
    signs = np.where(np.arange(30) % 3 == 0, -1.0, 1.0)
    u = whitening.polar(q @ np.diag(signs * np.geomspace(1e-9, 1, 30)) @ q.T)
    assert np.abs(u - q @ np.diag(signs) @ q.T).max() < 1e-6  # an eigenvalue of 1e-9 holds its vector to 1e-7
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
