"""Anchored containers, stitched and mediated pairs, fingerprints: brute force with ties."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from termloom.operators import align as A
from termloom.operators import fingerprint
from termloom.plans import pairing_queries as Q


def anchored_by_hand(units, pairs):
    out, partner = [], {}
    for s, a, b in pairs:
        partner.setdefault((s, a), b)
        partner.setdefault((s, b), a)
    for s in sorted({u[0] for u in units}):
        of = {}
        for u in sorted((u for u in units if u[0] == s), key=lambda u: (u[3], u[1])):
            of.setdefault(u[2], []).append(u)
        for x, y in itertools.combinations(of, 2):
            ids = {u[1] for u in of[y]}
            if not any(partner.get((s, u[1])) in ids for u in of[x]):
                continue
            free = [[u for u in of[c] if u[5] and (s, u[1]) not in partner] for c in (x, y)]
            if len(free[0]) == len(free[1]):
                for p, q in zip(*free):
                    if p[4] != q[4]:
                        a, b = (p, q) if p[4] else (q, p)
                        out.append((s, a[1], b[1]))
                        partner[s, a[1]], partner[s, b[1]] = b[1], a[1]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_anchored_containers_of_moved_decks(spark, seed):
    rng, units, pairs = random.Random(seed), [], []
    for s in range(12):
        ids = list(range(rng.randint(0, 18)))
        rows = [(s, i, rng.choice("abc"), rng.randint(0, 20), rng.random() < 0.5, rng.random() < 0.9) for i in ids]
        units += rows
        rng.shuffle(ids)
        pairs += [(s, a, b) for a, b in zip(ids[:3], ids[3:6]) if rng.random() < 0.7]
    df = spark.createDataFrame(units, "s long, id long, container string, at long, foreign boolean, eligible boolean").repartition(3)
    links = spark.createDataFrame(pairs, "s long, a long, b long")
    assert sorted(map(tuple, A.anchored_pairs(df, links, ["s"]).collect())) == anchored_by_hand(units, pairs)


def test_gaps_between_a_rising_chain(spark):
    # left: 0..5, right: 10..16; 1-11 and 4-15 rise together, 3-10 crosses them; between: [2] and [12, 13], before: [0] and none, after: [5] and [16]
    units = [(1, i, "l", i, False, True) for i in range(6)] + [(1, i, "r", i, True, True) for i in range(10, 17)]
    df = spark.createDataFrame(units, "s long, id long, container string, at long, foreign boolean, eligible boolean")
    links = spark.createDataFrame([(1, 11, 1), (1, 15, 4), (1, 10, 3)], "s long, a long, b long")
    assert A.anchored_pairs(df, links, ["s"]).collect() == []
    assert [tuple(r) for r in A.anchored_pairs(df, links, ["s"], gaps=True).collect()] == [(1, 16, 5)]


KNOWN = "q_text string, origin string, target string, confidence double, exact boolean, words int"


def test_mediated_pairs_with_ties_and_conflicts(spark):
    known = [("Một", "approved", "One!", 0.9, True, 2), ("hai", "approved", "Two", 0.95, True, 2), ("hai", "approved", "Zwei", 0.95, True, 2), ("ba", "history", "Drei", 0.97, True, 2), ("ba", "approved", "Three", 0.93, True, 2), ("uno", "review", "one", 0.9, True, 2)]
    units = [(1, 1, 5, "một", "source"), (1, 2, 1, "MỘT.", "source"), (1, 3, 2, "uno", "source"), (1, 4, 9, "one", "target"), (1, 5, 8, "ONE", "target"), (1, 6, 3, "hai", "source"), (1, 7, 4, "two", "target"), (1, 8, 6, "ba", "source"), (1, 9, 7, "three", "target"), (1, 10, 0, "", "source"), (2, 1, 0, "một", "source"), (2, 2, 0, None, "target"), (1, 11, 10, "one", "other")]
    got = A.mediated_pairs(spark.createDataFrame(units, "s long, id long, at long, text string, side string"), spark.createDataFrame(known, KNOWN), ["s"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, 5), (1, 3, 4), (1, 8, 9)]  # two wanted by three, in order


def test_stitched_partners(spark):
    known = [("hình dạng vòng cổ", "approved", "Collar shape", 0.95, True, 3), ("một hai", "approved", "one two", 0.9, True, 2)]
    units = [
        (1, 1, 1, "2. Hình dạng", "source", False), (1, 2, 2, "vòng cổ", "source", False), (1, 3, 3, "1. Collar shape", "target", False), (1, 4, 4, "2. Check collar shape now", "target", False), (1, 5, 5, "2. Collar shape", "other", False),
        (2, 1, 1, "1. một", "source", False), (2, 2, 2, "2. hai", "source", False), (2, 3, 3, "one two", "target", False),
        (3, 1, 1, "một", "source", True), (3, 2, 2, "hai", "source", True), (3, 3, 3, "one two", "target", False), (3, 4, 4, "một", "source", True), (3, 5, 5, "hai", "source", False), (3, 6, 6, "x" * 61, "source", False),
    ]
    df = spark.createDataFrame(units, "s long, id long, at long, text string, side string, paired boolean").repartition(3)
    got = A.stitched_pairs(df, spark.createDataFrame(known, KNOWN), ["s"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 4, "Hình dạng vòng cổ"), (3, 4, 5, 3, "một hai")]


def test_inherited_partners(spark):
    units = [(1, 1, 1, "a", "source"), (1, 2, 2, "b", "source"), (1, 3, 3, "c", "source"), (1, 4, 4, "T", "target"), (2, 1, 1, "a", "source"), (2, 2, 2, "b", "source")]
    df = spark.createDataFrame(units, "s long, id long, at long, text string, side string")
    pairs = spark.createDataFrame([(1, 2, 4, "T"), (2, 1, 9, "no")], "s long, a long, b long, target string")
    got = A.inherited_pairs(df, pairs, F.col("target") == "T", ["s"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 4), (1, 3, 4)]


def test_queries_over_the_tables(spark):
    """Every line that memory knows without conflict is found again, once."""
    sf = "/root/testdata/sf0.001"
    stitched = Q.QUERIES["j25_stitched_partners"](spark, sf).collect()
    assert sum(r.a2 == r.a + 1 and r.b == r.a + 2 for r in stitched) > 50
    pairs = Q.QUERIES["j26_mediated_pairs"](spark, sf).collect()
    assert len(pairs) > 50 and len({(r.doc_id, r.a) for r in pairs}) == len({(r.doc_id, r.b) for r in pairs}) == len(pairs)
    text = {(r.doc_id, r.id): r.text for r in Q.mediated(spark, sf).collect()}
    assert all(text[r.doc_id, r.a].upper() == text[r.doc_id, r.b] for r in pairs if text[r.doc_id, r.a].isascii())


def merkle(rows):
    """By the definition, with the library's digests."""
    level = sorted((r[0], hashlib.sha256("".join("-" if v is None else f"{len(str(v))}:{v}" for v in r).encode()).hexdigest()) for r in rows)
    level = [h for _, h in level]
    if not level:
        return hashlib.sha256(b"").hexdigest()[:16]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fingerprint.FANOUT]).encode()).hexdigest() for i in range(0, len(level), fingerprint.FANOUT)]
        if len(level) == 1:
            return level[0][:16]


@pytest.mark.parametrize("fanout", [2, 3, 1024])
def test_fingerprints_tell_every_change(spark, monkeypatch, fanout):
    monkeypatch.setattr(fingerprint, "FANOUT", fanout)
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(5, None), (5, "t5")]
    frame = lambda x, n=3: spark.createDataFrame(x, "id long, t string").repartition(n)
    root = lambda x, n=3: fingerprint.snapshot(frame(x, n), ["id"], ["id", "t"]).first().fingerprint
    base = root(rows)
    assert base == root(rows[::-1], 7) == merkle(rows)  # neither the order of rows nor partitions count
    swapped = [(i, "t1" if i == 3 else "t3" if i == 1 else t) for i, t in rows]
    assert len({base, root(swapped), root(rows[:-1]), root([*rows, rows[0]]), root([(9, None)]), root([(9, "-")]), root([])}) == 7
    assert root([]) == merkle([])


def test_differing_ranks(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "FANOUT", 3)
    rows = [(i, f"t{i}") for i in range(60)]
    tree = lambda x: fingerprint.levels(spark.createDataFrame(x, "id long, t string").repartition(2), ["id"], ["id", "t"])
    base = tree(rows)
    found = lambda x: sorted(r.rank for r in fingerprint.differing(base, tree(x)).collect())
    assert found(rows) == [] and found([(i, "x" if i in (4, 50) else t) for i, t in rows]) == [4, 50]
    assert found(rows + [(99, "new")]) == [60] and found(rows[:5]) == list(range(5, 60))
