import random
import re

from termloom.llm import jaccard
from termloom.llm.components import connected_components

from .cases import AWKWARD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and part[i] != part[j]:
                old = part[i]
                part = [part[j] if x == old else x for x in part]
    least = {}
    for p, (i, _) in zip(part, rows):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    return sorted(((i, len(s), least.get(p) if s else i) for (i, _), s, p in zip(rows, sets, part)), key=str)


def got(df):
    return sorted((tuple(r) for r in jaccard.components(df).drop("text_key").collect()), key=str)


def near_copies(rng, n, base_words, sizes, change):
    """Texts around base_words: some words of each replaced, so that many similarities lie close to the threshold."""
    out = []
    for _ in range(n):
        w = base_words[: rng.choice(sizes)]
        for _ in range(rng.randrange(change)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_brute_force(spark):
    rng = random.Random(2)
    texts = [*AWKWARD, "A b C d", "a B c D", "a b c e", "one two three four five", "one two three four five six"]
    for k in range(10):
        size = rng.choice([5, 6, 7, 9, 12, 20, 45, 100, 300])
        texts += near_copies(rng, 12, [f"w{k}x{i}" for i in range(size)], [size, size, max(1, size - 1), max(1, size * 9 // 10), max(1, size * 4 // 5)], max(2, size // 12))
    common = [f"shared{i}" for i in range(60)]
    texts += [" ".join([f"own{k}y{i}" for i in range(40)] + common) for k in range(40)]
    df = documents(spark, [t if isinstance(t, tuple) else (100 + i, t) for i, t in enumerate(texts)], extra=True)
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_frequent_signatures(spark, monkeypatch):
    """Groups beyond FREQUENT, and partitions read in many batches."""
    rng = random.Random(4)
    monkeypatch.setattr(jaccard, "FREQUENT", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = near_copies(rng, 60, [f"w{i}" for i in range(80)], [80], 6) + near_copies(rng, 30, [f"v{i}" for i in range(25)], [25, 24, 23], 2)
        df = documents(spark, texts)
        assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tiles_pair_all_rows_of_a_group_once(spark, monkeypatch):
    """Groups larger than a tile: the pairs are those of a plain self-join."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    rows = [(sig, i, i % 7) for sig, n in ((1, 23), (2, 4), (3, 1), (4, 9)) for i in range(n)]
    facts = spark.createDataFrame([(i, 10, [0] * 8) for i in range(23)], "id long, n long, p array<long>")
    pairs = jaccard.distinct_pairs(spark.createDataFrame(rows, "sig long, id long, part long"), facts)
    expected = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]}
    assert sorted(map(tuple, pairs.collect())) == sorted(expected)
    texts = near_copies(random.Random(8), 40, [f"w{i}" for i in range(60)], [60, 59], 5)
    df = documents(spark, texts)
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(spark):
    assert got(documents(spark, [])) == []
    assert got(documents(spark, [None, ""])) == [(0, 0, 0), (1, 0, 1)]


def test_keep_one(spark):
    text = " ".join(f"k{i}" for i in range(50))
    df = documents(spark, [(3, text), (3, text), (2, text + " z"), (9, "else where it is quite new"), (5, None), (5, None), (6, "")], extra=True)
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 5, 5, 6, 9]
    out = jaccard.keep_one(df.where("doc_id = 3"))
    assert [r.doc_id for r in out.collect()] == [3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7), (200, 150), (150, 200), (None, 1), (2, None)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(51)} | {100: 90, 90: 90, 95: 90, 200: 150, 150: 150}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
