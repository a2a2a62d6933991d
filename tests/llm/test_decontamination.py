import hashlib
import re

from termloom.llm import decontamination as D

from .cases import AWKWARD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        if i is not None:
            for s in range(max(1, len(w) - 12) if w else 0):
                windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    sizes, out = {len(x) for x in windows}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= x
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df, benchmark):
    return sorted((tuple(r) for r in D.contamination(df, benchmark).drop("text_key").collect()), key=str)


P = " ".join(f"q{i}" for i in range(20))


def fixture(spark, extra=True):
    items = [(1, P), (2, "Short item"), (3, None), (4, "..."), (5, P + " tail"), (None, "no id at all"), (10, "a a a a a a a a a a a a a a"), (2, "short item"), (11, "single")]
    texts = [*AWKWARD, P, "x " + P.upper() + " y", "short ITEM, short-item", " ".join(["a"] * 40), P[:-4], "é " * 600 + P, "short", "q3 " + P, "single", f"{P} {P}"]
    return documents(spark, texts, extra), spark.createDataFrame(items, "item_id long, text string")


def test_brute_force(spark):
    docs, benchmark = fixture(spark)
    assert got(docs, benchmark) == brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in benchmark.collect()])


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, benchmark = fixture(spark)
    one = got(docs, benchmark)
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert got(docs, benchmark) == one


def test_empty_tables(spark):
    docs, benchmark = fixture(spark)
    assert got(docs.limit(0), benchmark) == []
    assert all(r[2] == 0 and not r[5] for r in got(docs, benchmark.limit(0)))


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    docs, benchmark = fixture(spark)
    out = D.decontaminate(docs, benchmark)
    assert out.columns == docs.columns
    assert out.count() == sum(not r[5] for r in got(docs, benchmark))


def test_proximity(spark):
    docs = documents(spark, ["rare1 x x x rare2", "rare1 " + "x " * 9 + "rare2", "rare2 rare1"])
    windows = D.item_windows(spark.createDataFrame([(1, "rare1 x rare2")], "item_id long, text string"))
    index = D.positional_index(docs, windows.selectExpr("explode(win) as term").distinct())
    queries = D.query_windows(windows, D.term_frequencies(index))
    assert {(r.doc_id, r.distance) for r in D.proximity_matches(index, queries, 5).collect()} == {(0, 4), (2, 1)}


def test_proximity_brute_force(spark):
    docs, benchmark = fixture(spark)
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    cf = {}
    for _, w in rows:
        for x in w:
            cf[x] = cf.get(x, 0) + 1
    pairs = set()
    for i, text in [tuple(r) for r in benchmark.collect()]:
        w = words(text)
        for s in range(max(1, len(w) - 12) if w and i is not None else 0):
            win = w[s : s + 13]
            by = sorted((cf.get(x, 0), k, x) for k, x in enumerate(win))
            if by[0][0] and len(by) > 1:
                pairs.add((i, by[0][2], by[1][2]))
    expected = []
    for doc, w in rows:
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        expected.append((doc, len({i for i, a, b in pairs if any(0 < abs(p - q) <= 13 for p in at.get(a, ()) for q in at.get(b, ()))})))
    got = [(r.doc_id, r.n_near) for r in D.contamination(docs, benchmark, near=13).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(n for _, n in got) > 0
