import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from termloom.llm import language_model as LM

from .cases import AWKWARD, documents


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


TEXTS = [*AWKWARD, *(f"the cat {w} on the mat and the dog {w[::-1]} near the mat" for w in ("sat", "lay", "stood", "slept", "ate")), "The THE the İ"]


@pytest.fixture(scope="module")
def trained(spark):
    df = documents(spark, TEXTS, extra=True)
    return df, *LM.train(df.where("doc_id % 3 <> 0 or doc_id is null"))


def test_base_scores(trained):
    df, model, counts = trained
    rows = [(r.doc_id, r.text) for r in df.collect()]
    c = Counter(w for i, t in rows if i is None or i % 3 for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    expected = []
    for i, t in rows:
        t = [*words(t), b""]
        expected.append((i, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)))
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in LM.scores(df, model, counts).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_rare_words_are_counted_by_the_join(spark, monkeypatch):
    df = documents(spark, TEXTS)
    whole = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in LM.scores(df, *LM.train(df)).collect())
    monkeypatch.setattr(LM, "KNOWN", 3)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in LM.scores(df, *LM.train(df)).collect()) == whole


def unpacked(model, k, slot):
    """Logit and level of a context's slot."""
    cell = int(model.cells[k][slot])
    return ((cell >> 2) - 8192) / 256, cell & 3


def naive(model, text):
    """One document, one decision at a time."""
    s = LM.stream(LM.tokens([text]), model.code, LM.Lookup(model.code.words))
    added, seen, cost, begin = np.zeros(3), np.full(3, float(LM.TRUST)), 0.0, 0
    assert s.owner.tolist() == [0] * len(s.runs) and s.steps.tolist() == list(range(1, len(s.runs) + 1))
    for n in s.runs.tolist():
        fall, bend = np.zeros(3), np.zeros(3)
        for i in range(begin, begin + n):
            (one, level), (two, level2) = unpacked(model, 0, s.slots[0][i]), unpacked(model, 1, s.slots[1][i])
            x = np.array([model.code.logits[s.node[i]], one, two])
            g = level + 4 * level2 + 16 * bool(s.spelled[i])
            p = 1 / (1 + math.exp(-min(20, max(-20, float((model.weights[g] + added) @ x)))))
            cost -= math.log(p if s.bit[i] else 1 - p)
            fall += (p - int(s.bit[i])) * x
            bend += p * (1 - p) * x * x
        seen += float(LM.CAUTION) * bend
        added -= fall / seen
        begin += n
    return cost


def test_steps_grow_with_the_text():
    at = LM.STEPS[LM.STEPS < 1_000_000]
    assert at[:5].tolist() == [0, 4, 8, 12, 16] and len(at) < 250 and (np.diff(at) <= np.maximum(4, at[:-1] // 16)).all()


def test_tree_slots_and_tables_by_hand(spark):
    """Codes by a plain Huffman construction; contexts, slots and counts decision by decision."""
    import heapq
    import itertools

    df = documents(spark, ["b a b a c", "a b", None, "zz a"])
    counts = LM.word_counts(df)
    found = {(r.kind, r.h): r.n for r in counts.collect()}
    hashes = {w: int(LM.tokens([w]).hash[0].view(np.int64)) for w in (b"a", b"b", b"c", b"zz")} | {b"": int(LM.tokens([b""]).hash[0].view(np.int64))}
    assert {w: found[0, h] for w, h in hashes.items()} == {b"a": 4, b"b": 3, b"c": 1, b"zz": 1, b"": 4}
    assert [found[1, b] for b in b"abcz"] == [4, 3, 1, 2] and found[1, 256] == 13
    octets = np.array([found.get((1, b), 0) for b in range(257)])
    known = [b"a", b"", b"b"]
    order = sorted(known, key=lambda w: (-found[0, hashes[w]], np.int64(hashes[w]).view(np.uint64)))
    c = LM.code(np.array([hashes[w] for w in order], np.int64).view(np.uint64), np.array([found[0, hashes[w]] for w in order]), 2, octets)

    def plain(weights):
        tick = itertools.count()
        heap = [(w, i, (i,)) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        paths = [""] * len(weights)
        for k in itertools.count(len(weights)):
            if len(heap) == 1:
                return paths
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for side, symbols in (("0", left), ("1", right)):
                for i in symbols:
                    paths[i] = side + paths[i]
            heapq.heappush(heap, (a + b, k, left + right))
            next(tick)

    paths = plain([found[0, hashes[w]] for w in order] + [2]) + plain((octets + 1).tolist())
    for i, path in enumerate(paths):
        assert "".join(str(v & 1) for v in c.decisions[c.starts[i] : c.starts[i] + c.lengths[i]].tolist()) == path

    u32 = 1 << 32
    mixed = lambda a, b: ((x := (a * 0x9E3779B1 % u32) ^ (b + 0x7F4A7C15) % u32) ^ x >> 16) * 0x85EBCA6B % u32

    def slot(context, node):
        x = (context ^ node * 2654435761 % u32) * 2246822519 % u32
        return ((x ^ x >> 15) * 3266489917 % u32) >> (32 - LM.TABLE_BITS)

    tables = Counter()
    for text in (b"b a b a c", b"a b", b"", b"zz a"):
        toks, kinds = [*text.split(), b""], []
        t = LM.tokens([text])
        for j, w in enumerate(toks):
            symbol = order.index(w) if w in order else c.escape
            kinds.append(symbol + 256 if symbol < 256 else int(t.kind[j]))
            before, before2 = (kinds[j - 1] if j else 999), (kinds[j - 2] if j > 1 else 999)
            units = [(symbol, mixed(before, 7), mixed(before & 63, before2 & 63))]
            if symbol == c.escape:
                for i, value in enumerate([*w, 256]):
                    past = [w[i - k] + 1 if i >= k else 0 for k in range(1, 5)]
                    near = past[0] | past[1] << 9
                    units.append((c.escape + 1 + value, mixed(near, 11), mixed(mixed(near, past[2] | past[3] << 9), 13)))
            for symbol, one, two in units:
                for at in range(c.starts[symbol], c.starts[symbol] + c.lengths[symbol]):
                    for k, context in enumerate((one, two)):
                        tables[k, slot(context, int(c.decisions[at]) >> 1), int(c.decisions[at]) & 1] += 1
    out = LM.context_counts(df, spark.sparkContext.broadcast(tuple(c)))
    assert {(int(k), int(i), int(b)): int(out[k, i, b]) for k, i, b in zip(*np.nonzero(out))} == dict(tables)


def test_scores_are_those_of_a_plain_loop_and_of_the_text_alone(trained):
    _, model, _ = trained
    docs = [t.encode() for t in ("the cat sat on unseen grounds", "", "the " * 700, "é漢 mat", "x" * 600)]
    together = LM.costs(model, LM.stream(LM.tokens(docs), model.code, LM.Lookup(model.code.words)), len(docs))
    for doc, cost in zip(docs, together):
        alone = LM.costs(model, LM.stream(LM.tokens([doc]), model.code, LM.Lookup(model.code.words)), 1)[0]
        assert abs(alone - cost) < 1e-9 * max(1, cost) and abs(cost - naive(model, doc)) < 1e-3 * max(1, cost)


def test_probabilities_of_a_symbol_sum_to_one(trained):
    """Words and escape; then bytes and the end of a word."""
    _, model, _ = trained
    c = model.code
    for symbols in (range(c.escape + 1), range(c.escape + 1, c.escape + 258)):
        total = 0.0
        for symbol in symbols:
            a, n = c.starts[symbol], c.lengths[symbol]
            nodes, bits = c.decisions[a : a + n] >> np.uint32(1), (c.decisions[a : a + n] & np.uint32(1)).astype(np.uint8)
            slots = tuple(LM._slot(np.full(n, k, np.uint32), nodes * np.uint32(2654435761)) for k in (3, 4))
            s = LM.Stream(nodes, bits, slots, np.zeros(n, bool), np.array([n]), np.array([0]), np.array([1]))
            total += math.exp(-LM.costs(model, s, 1)[0])
        assert abs(total - 1) < 1e-3


def test_lookup():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        asked = np.concatenate([keys, rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        at, there = LM.Lookup(keys).find(asked)
        assert there.tolist() == np.isin(asked, keys).tolist() and (keys[at[there]] == asked[there]).all()


def test_tokens_and_hashes():
    rng = np.random.default_rng(1)
    parts = [b"a", b"Ab", b" ", b"\n", b"\x0b\x0c", b"\x00", b"\xc3\xa9", b"longer", b"\x1c", b"\t"]
    texts = [b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(300)] + [b"", None, b" ", b"a"]
    t = LM.tokens(texts)
    assert t.count.tolist() == [len((x or b"").lower().split()) + 1 for x in texts]
    flat = [w for x in texts for w in [*(x or b"").lower().split(), b""]]
    assert [t.raw[a:b].tobytes() for a, b in zip(t.start, t.end)] == flat
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(flat, t.hash.tolist()))
    assert len(set(by_word.values())) == len(by_word)


def test_untrained_and_empty(spark):
    df = documents(spark, TEXTS)
    rows = LM.scores(df, *LM.train(df.limit(0))).collect()
    assert len(rows) == len(TEXTS) and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)
    assert LM.scores(df.limit(0), *LM.train(df)).collect() == []


def test_held_out_texts_gain_from_training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = LM.scores(docs.where(held), *LM.train(docs.where(~held))).agg(F.sum("score"), F.sum("bits_per_byte"), F.count("*")).first()
    assert out[1] / out[2] < 2.6


def test_every_branching_is_mixed():
    """Rare words' decisions, too, are made in contexts: the decisions of a symbol are its whole path from the root."""
    counts = 1 + 5000 // (1 + np.arange(999))
    c = LM.code(np.arange(999, dtype=np.uint64), counts, 7, np.arange(257))
    for first, last in ((0, c.escape + 1), (c.escape + 1, c.escape + 258)):
        assert (2.0 ** -c.lengths[first:last]).sum() == 1
        nodes = [c.decisions[a : a + n] >> np.uint32(1) for a, n in zip(c.starts[first:last], c.lengths[first:last])]
        assert len(np.unique(np.concatenate(nodes))) == last - first - 1


def test_weights_are_learned_and_refined_in_short_texts(spark):
    """Training moves the starting weights to where held-out texts cost less, and a short text moves them on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model, _ = LM.train(docs.where(~held))
    constants = np.array([[1.0, 0.5 * (g & 3), 0.7 * (g >> 2 & 3)] for g in range(LM.GATES)])
    plain = model._replace(weights=(constants / constants.sum(axis=1, keepdims=True)).astype(np.float32))
    texts = [r.text.encode() for r in docs.where(held & F.col("text").isNotNull()).collect()]
    s = LM.stream(LM.tokens(texts), model.code, LM.Lookup(model.code.words))
    assert LM.costs(model, s, len(texts)).sum() < 0.99 * LM.costs(plain, s, len(texts)).sum()
    short = LM.stream(LM.tokens([b"the " * 40]), model.code, LM.Lookup(model.code.words))
    whole = short._replace(runs=short.runs.sum(keepdims=True), owner=short.owner[:1], steps=np.array([1]))  # without any refinement
    assert len(short.steps) > 5 and LM.costs(model, short, 1)[0] < LM.costs(model, whole, 1)[0]
