import inspect
import math

import numpy as np
import pyarrow as pa
import pytest
from termloom.llm import embeddings


def fixture(spark):
    rng = np.random.default_rng(8)
    rows = []
    for label in (1, 2):
        for base in rng.standard_normal((12, 16)):
            for _ in range(rng.integers(1, 9)):
                rows.append((base + 0.11 * rng.standard_normal(16), label))
    rows += [(rows[0][0], 1), (rows[0][0], 1), (rows[0][0] * 2.5, 1), (rows[0][0], 2), (rows[0][0], None), (np.zeros(16), 1), (rows[0][0][:8], 1)]
    out = [(i, [float(np.float32(v)) for v in x], label) for i, (x, label) in enumerate(rows)]
    n = len(out)
    out += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0, None], 1), (n + 3, [float("nan")] * 2, 1), (n + 4, [float("inf"), 1.0], 1), (n + 5, [1e-30] * 3, 2), (n + 6, [2e-30] * 3, 2), (0, out[0][1], 1), (None, out[0][1], 1)]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, label int").selectExpr("*", "'y' as n", "'y' as x", "'y' as id", "'y' as codes").repartition(3), out


def brute(rows):
    def ok(x, label):
        return x and label is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)

    def cosine(a, b):
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    part, links = list(range(len(rows))), [0] * len(rows)
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows[:i]):
            if ok(x, a) and ok(y, b) and a == b and len(x) == len(y) and (x == y or cosine(x, y) >= 0.98):
                links[i] += 1
                links[j] += 1
                old = part[i]
                part = [part[j] if p == old else p for p in part]
    least = {}
    for (i, _, _), p in zip(rows, part):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    return sorted(((i, n, least.get(p), i == least.get(p)) for (i, _, _), n, p in zip(rows, links, part)), key=str)


def result(df, **more):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **more).collect()), key=str)


def test_brute_force(spark):
    df, rows = fixture(spark)
    assert result(df) == brute(rows)


def test_small_blocks_and_windows(spark):
    """Cut into many blocks, passes alone still find nearly all links and no wrong one."""
    df, rows = fixture(spark)
    assert result(df, window=2, block_rows=5, passes=1) == brute(rows)  # what one pass leaves is closed
    whole, cut = brute(rows), result(df, window=8, block_rows=16, passes=8, exact_rows=0)
    assert [r[0] for r in whole] == [r[0] for r in cut]
    assert all(b[1] <= a[1] for a, b in zip(whole, cut))
    assert sum(r[1] for r in cut) >= 0.9 * sum(r[1] for r in whole)


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expected, got = brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]), result(df)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in expected)
    assert all(b[1] <= a[1] for a, b in zip(expected, got))


def test_empty(spark):
    df, _ = fixture(spark)
    assert result(df.limit(0)) == []
    assert all(r[1] == 0 for r in result(df.where("label is null")))


def test_links_of_a_group_larger_than_the_window(spark):
    """Thousands of distinct similar vectors, not all of them linked with one another."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(64)
    spread = rng.uniform(0.01, 0.16, (3000, 1))
    x = np.concatenate([centre + spread * rng.standard_normal((3000, 64)), rng.standard_normal((200, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(3)
    x = x.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    expected = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert 1000 < expected.max() and expected[:3000].min() < expected.max() / 2
    for rows, exact in ((embeddings.BLOCK_ROWS, 0), (700, 0), (700, 5000)):
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, block_rows=rows, exact_rows=exact).collect()}
        assert [got[i] for i in range(3200)] == expected.tolist()


@pytest.mark.parametrize("n,noise", [(20_000, 0.24), (40_000, 0.24)])
def test_crowded_labels_lose_no_link(spark, n, noise):
    """Pairs of near copies about one centre, where hyperplanes do not part the crowd."""
    rng = np.random.default_rng(n)
    centre = rng.standard_normal(64)
    base = centre + noise * rng.standard_normal((n // 2, 64))
    x = np.concatenate([base, base + 0.06 * rng.standard_normal(base.shape)]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.ones(n, np.int32)})).repartition(8)
    x = x.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    expected = np.concatenate([(x[a : a + 2000] @ x.T >= 0.98).sum(axis=1) - 1 for a in range(0, n, 2000)])
    assert expected.sum() >= n
    got = embeddings.near_duplicates(df).select("vec_id", "n_links").toPandas().set_index("vec_id")["n_links"]
    assert (got.sort_index().to_numpy() == expected).all()


def test_no_size_switches_the_check_off(spark):
    """without a bound of the caller's, labels of any size are closed by all their pairs."""
    assert inspect.signature(embeddings.near_duplicates).parameters["exact_rows"].default is None
    df, rows = fixture(spark)
    assert result(df, window=1, block_rows=3, passes=1) == brute(rows)
