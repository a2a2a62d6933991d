import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from termloom.llm import queries, suffixes

from .cases import AWKWARD, documents


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(x for x, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **more):
    return sorted((tuple(r) for r in suffixes.without_repeats(df, digest=True, **more).collect()), key=str)


def passages(seed, n=60):
    """Texts of few letters with passages that they share, whole, cut, changed in places, overlapping and periodic."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abç ") for _ in range(k))
    shared = [word(rng.randint(15, 90)) for _ in range(6)] + ["ab" * 40, "z" * 70]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            if rng.random() < 0.5:
                a = rng.randint(0, len(p))
                p = p[a : a + rng.randint(0, len(p))]
            if rng.random() < 0.3 and p:
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, word(rng.randint(0, 30))]
        out.append("".join(parts))
    return out + out[:5] + [None, ""]


@pytest.mark.parametrize("length,crowd", [(20, 20_000), (20, 1), (33, 2), (50, 20_000), (1, 20_000)])
def test_brute_force(spark, length, crowd, monkeypatch):
    """Every level of grams, where the crowd is small."""
    texts = passages(length + crowd)
    df = documents(spark, texts, extra=True)
    assert result(df, length=length, crowd=crowd) == brute(list(enumerate(texts)), length)


def test_small_blocks_and_ranges(spark, monkeypatch):
    """Many ranges, parts of ranges, and blocks of few suffixes."""
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 3)
    monkeypatch.setattr(suffixes, "MOST_RANGES", 5)
    texts = passages(7, 150)
    assert result(documents(spark, texts), length=25) == brute(list(enumerate(texts)), 25)


def test_awkward_rows(spark):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(AWKWARD)] + [(50, "x" * 1500), (51, "y" * 400), (52, "y" * 399), (53, "ab" * 300 + "é" * 300)]
    assert result(documents(spark, rows)) == brute(rows, 400)
    assert result(documents(spark, [])) == []


def test_query_over_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_suffixes(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, 400)
    assert sum(r[2] > 0 for r in got) > 10


def test_removed_runs_and_what_is_kept(spark):
    df = documents(spark, ["0123456789abcdefghij--", "??0123456789abcdefghij", "other"])
    got = {r.doc_id: (r.removed, r.kept) for r in suffixes.without_repeats(df, length=10).collect()}
    assert [(r.start, r.end) for r in got[0][0]] == [(0, 20)] and bytes(got[0][1]) == b"--"
    assert [(r.start, r.end) for r in got[1][0]] == [(2, 22)] and bytes(got[1][1]) == b"??"
    assert got[2][0] == [] and bytes(got[2][1]) == b"other"


def test_merging_never_looks_at_known_prefixes_again():
    rng = random.Random(4)
    strings = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(500)) + [b"a" * 300] * 20
    for k in (1, 2, 3, 7, 16):
        runs = [[] for _ in range(k)]
        for s in sorted(strings):
            run = rng.choice(runs)
            run.append((suffixes._shared(run[-1][1], s, 0) if run else 0, s, id(run)))
        looked = 0

        def counted(a, b, known):
            nonlocal looked
            n = suffixes._shared(a, b, known)
            assert a[:known] == b[:known]
            looked += n - known
            return n

        got = list(suffixes.merged(runs, counted))
        assert [r[1] for r in got] == sorted(strings)
        assert [r[0] for r in got] == suffixes.common_prefixes([r[1] for r in got]).tolist()
        assert looked <= sum(r[0] for r in got) + 0  # each shared byte once at most
    assert list(suffixes.merged([])) == []


def test_anchors_do_not_depend_on_surroundings():
    rng = np.random.default_rng(3)
    window = rng.integers(0, 3, 40, dtype=np.uint8)
    seen = set()
    for _ in range(20):
        head = rng.integers(0, 3, rng.integers(0, 50), dtype=np.uint8)
        raw = np.concatenate([head, window, rng.integers(0, 3, rng.integers(0, 50), dtype=np.uint8)])
        own, at, lo, hi, _, _ = suffixes.anchors(raw, np.array([len(raw)]), 8, 40)
        (k,) = np.flatnonzero((lo <= len(head)) & (hi >= len(head)))
        seen.add(int(at[k]) - len(head))
    assert len(seen) == 1


def test_least_and_prefixes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 100, 57).astype(np.uint64)
    for w in (1, 2, 5, 57):
        assert suffixes.least(x, w).tolist() == [x[i : i + w].min() for i in range(58 - w)]
    assert suffixes.common_prefixes([b"", b"a", b"a" * 70, b"a" * 69 + b"b", b"a" * 69 + b"b"]).tolist() == [0, 0, 1, 69, 70]
