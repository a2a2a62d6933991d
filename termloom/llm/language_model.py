"""LM scoring by logistic context mixing.

A text is a sequence of words and an end token. Frequent words are symbols of a Huffman code made from the
training counts; other words are an escape symbol, their bytes (a second Huffman code) and an end of word.
Every branching of a code is a binary decision, predicted in three ways: by the branching alone, and by two
hashed contexts (the class of the word before, of the two words before; inside spelled words the two and the
four bytes before), each a slot of a table of counts. The predictions' logits are combined with weights that
a gate selects by how often both contexts were seen; the gates' weights are learned over the training texts, and
each document refines them as it is read, by what it adds to each prediction's weight: online Newton steps, at
first after every 4 symbols, later whenever a sixteenth more is read (``STEPS``). Costs of all decisions add up to
the text's probability, hence bits per byte.

Learning: word counts and context tables are counted over all training texts, by task, and summed in
shuffles whose volume follows the input. The starting weights are a Newton step from constants on the costs of
all training decisions, each predicted by tables from which it is taken out itself. What is broadcast is bounded by parameters: the vocabulary, the
``KNOWN`` most frequent words' counts, and the tables. Rarer words of each text get their counts by a join.
Numpy handles chunks of documents step by step side by side; a score depends on the model and the text only.

Words are told apart by 64-bit hashes that numpy computes for a chunk of texts at once: N distinct words make
about N^2 / 2^65 clashes, so ten billion words some two or three.

Edge cases: null text is empty (one end token); without training texts all counts are zero; repeated rows
each get a row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions, slices, stored
from .words import Lookup, Words, chunks, mix, words_of


def _steps(least: int, share: int) -> np.ndarray:
    at = [0]
    while at[-1] < 1 << 40:
        at.append(at[-1] + max(least, at[-1] // share))
    return np.array(at)


VOCABULARY = 1 << 18
KNOWN = 1 << 20
TABLE_BITS = 20
#: Symbols of a document after which its weights are refined: every 4 at first, then whenever a sixteenth more is read.
STEPS = _steps(4, 16)
FLUSH_WORDS = 4_000_000
PIECE = 1 << 15
#: Sums of the tables are first made apart for so many groups of tasks.
SALTS = 16
#: A document moves its weights by the gradient over CAUTION times the curvature it has seen, plus TRUST decisions' worth.
CAUTION, TRUST = np.float32(1), np.float32(50)
GATES = 32
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
PRIOR = 100.0  # decisions' worth of trust in the constants that learning starts from
LEVELS = np.array([0, 2, 8, 40], np.int64)  # counts at which a context is trusted more


class Tokens(NamedTuple):
    """Tokens of a chunk of texts: words and, last of each text, the end token, which is empty."""

    raw: np.ndarray  # bytes, lower case
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    kind: np.ndarray  # class of the last two bytes, below 256
    count: np.ndarray  # by text


def tokens(texts: list[bytes | None]) -> Tokens:
    w: Words = words_of(texts)
    count = np.bincount(w.owner, minlength=len(texts)) + 1
    place = np.arange(len(w.start)) + w.owner  # an end token for each text before
    total = int(count.sum())
    start, end = np.zeros(total, np.int64), np.zeros(total, np.int64)
    start[place], end[place] = w.start, w.end
    hashed = np.full(total, mix(np.zeros(1, np.uint64) + np.uint64(1))[0], np.uint64)
    hashed[place] = w.hash
    last = np.zeros(total, np.uint64)
    last[place] = w.raw[w.end - 1] * np.uint64(131) + np.where(w.end - w.start > 1, w.raw[np.maximum(w.end - 2, 0)], 0)
    return Tokens(w.raw, start, end, hashed, (mix(last) & np.uint64(255)).astype(np.uint32), count)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def word_counts(documents: DataFrame) -> DataFrame:
    """(kind, h, n): kind 0: tokens by hash; kind 1: bytes of words, 256 for their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, octets = [], 0, np.zeros(257, np.int64)

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), _signed(h), pa.array(n)], ["kind", "h", "n"])

        for batch in slices(batches):
            for _, texts in chunks(_texts(batch)):
                t = tokens(texts)
                held.append(t.hash)
                size += len(t.hash)
                octets[:256] += np.bincount(t.raw, minlength=256)
                octets[[9, 10, 11, 12, 13, 32]] = 0
                octets[256] += len(t.hash)
                if size > FLUSH_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        if octets[256]:
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(257, np.int32)), pa.array(np.arange(257)), pa.array(octets)], ["kind", "h", "n"])

    return mapped(documents.select("text"), run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


class Tree(NamedTuple):
    """Of each symbol the decisions (node, bit), one after another; logits of bit 1 by node."""

    lengths: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    logits: np.ndarray


def huffman(weights: np.ndarray) -> Tree:
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.uint8)
    logits = np.zeros(n - 1, np.float32)
    for k in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = k
        side[j], logits[k - n] = 1, np.log(b / a)
        heapq.heappush(heap, (a + b, k))
    at, paths = np.arange(n), []
    while (up := np.where(parent[at] >= 0, parent[at], at)).max() != at.min() or (up != at).any():
        paths.append((up != at, up - n, side[at]))
        at = up
    lengths = np.sum([m for m, _, _ in paths], axis=0, dtype=np.int64) if paths else np.zeros(n, np.int64)
    starts = np.cumsum(lengths) - lengths
    nodes, bits, seen = np.zeros(int(lengths.sum()), np.uint32), np.zeros(int(lengths.sum()), np.uint8), np.zeros(n, np.int64)
    for met, node, bit in reversed(paths):  # from the root
        where = starts[met] + seen[met]
        nodes[where], bits[where] = node[met], bit[met]
        seen[met] += 1
    return Tree(lengths, nodes, bits, logits)


class Code(NamedTuple):
    """Symbols: vocabulary words by rank, then escape, 256 bytes, end of word."""

    words: np.ndarray  # hashes, sorted
    ranks: np.ndarray  # their symbols
    lengths: np.ndarray
    starts: np.ndarray
    decisions: np.ndarray  # 2 x node + bit
    logits: np.ndarray
    escape: int


def code(words: np.ndarray, counts: np.ndarray, outside: int, octets: np.ndarray) -> Code:
    """words by falling count; outside: training tokens that are none of them."""
    first, second = huffman(np.append(counts, max(1, outside))), huffman(octets + 1)
    lengths = np.concatenate([first.lengths, second.lengths])
    order = np.argsort(words)
    both = lambda name: np.concatenate([getattr(first, name), getattr(second, name)])
    nodes = np.concatenate([first.nodes, second.nodes + np.uint32(len(first.logits))])
    return Code(words[order], order, lengths, np.cumsum(lengths) - lengths, nodes << np.uint32(1) | both("bits"), both("logits"), len(words))


class Stream(NamedTuple):
    """Decisions of a chunk of documents, in reading order or step by step: node, bit and both slots."""

    node: np.ndarray
    bit: np.ndarray
    slots: tuple[np.ndarray, np.ndarray]
    spelled: np.ndarray
    runs: np.ndarray  # how many decisions each document has in each step, by step and document; none left out
    owner: np.ndarray  # a run's document
    steps: np.ndarray  # the number of runs up to each step's end


def _slot(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = context ^ node
    x *= np.uint32(2246822519)
    x ^= x >> np.uint32(15)
    x *= np.uint32(3266489917)
    x >>= np.uint32(32 - TABLE_BITS)
    return x


def _mix(a, b) -> np.ndarray:
    x = (a * np.uint32(0x9E3779B1)) ^ (b + np.uint32(0x7F4A7C15))
    return (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)


def stream(t: Tokens, c: Code, find: Lookup, stepwise: bool = True) -> Stream:
    """stepwise: every document's first symbols before any document's next ones."""
    n = len(t.count)
    doc = np.repeat(np.arange(n), t.count)
    at, known = find.find(t.hash)
    symbol = np.where(known, np.append(c.ranks, c.escape)[at], c.escape)
    # a word's context: its rank among the most frequent, else the class of its end
    kind = np.where(symbol < 256, (symbol + 256).astype(np.uint32), t.kind)
    begin = np.cumsum(t.count) - t.count
    before, before2 = np.roll(kind, 1), np.roll(kind, 2)
    before[begin] = 999
    before2[begin] = 999
    before2[begin[t.count > 1] + 1] = 999

    out = ~known
    length = (t.end - t.start + 1)[out]  # bytes and the end of the word
    sizes = np.ones(len(symbol), np.int64)
    sizes[out] += length
    total = int(sizes.sum())
    place = np.cumsum(sizes) - sizes
    symbols = np.empty(total, np.int64)
    contexts = [np.empty(total, np.uint32), np.empty(total, np.uint32)]
    spelled = np.ones(total, bool)
    spelled[place] = False
    symbols[place] = symbol
    contexts[0][place] = _mix(before, np.uint32(7))
    contexts[1][place] = _mix(before & np.uint32(63), before2 & np.uint32(63))
    if len(length):
        ends = np.cumsum(length)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
        value = t.raw[np.minimum(np.repeat(t.start[out], length) + inside, len(t.raw) - 1)].astype(np.int64)
        value[ends - 1] = 256
        symbols[spelled] = c.escape + 1 + value
        past = []
        for k in range(1, 5):
            p = np.zeros(len(value), np.uint32)
            p[k:] = value[:-k] + 1
            p[inside < k] = 0
            past.append(p)
        near = past[0] | past[1] << np.uint32(9)
        contexts[0][spelled] = _mix(near, np.uint32(11))
        contexts[1][spelled] = _mix(_mix(near, past[2] | past[3] << np.uint32(9)), np.uint32(13))
    runs, owner, steps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if stepwise:
        doc = np.repeat(doc, sizes)
        per_doc = np.bincount(doc, minlength=n)
        step = np.searchsorted(STEPS, np.arange(total) - (np.cumsum(per_doc) - per_doc)[doc], "right").astype(np.uint16)
        order = np.argsort(step, kind="stable")  # of 16 bits: a radix sort
        symbols, spelled, doc, step = symbols[order], spelled[order], doc[order], step[order]
        contexts = [x[order] for x in contexts]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (step[1:] != step[:-1])]))
        runs, owner = np.add.reduceat(c.lengths[symbols], first), doc[first]
        steps = np.cumsum(np.bincount(step[first])[1:])
    length = c.lengths[symbols]
    index = np.repeat((c.starts[symbols] - (np.cumsum(length) - length)).astype(np.int32), length)
    index += np.arange(len(index), dtype=np.int32)
    node = np.take(c.decisions, index)
    bit = (node & np.uint32(1)).astype(np.uint8)
    node >>= np.uint32(1)
    scattered = node * np.uint32(2654435761)
    slots = tuple(_slot(np.repeat(x, length), scattered) for x in contexts)
    return Stream(node, bit, slots, np.repeat(spelled, length), runs, owner, steps)


def context_counts(documents: DataFrame, shared: Broadcast) -> np.ndarray:
    """(2, slots, 2): how often each decision fell either way, for both contexts, over all training texts."""
    spark = documents.sparkSession
    cells = 2 << TABLE_BITS

    def run(batches):
        tables, find, c = np.zeros((2, cells), np.int64), Lookup(shared.value[0]), Code(*shared.value)
        seen = False
        for batch in slices(batches):
            for _, texts in chunks(_texts(batch)):
                s, seen = stream(tokens(texts), c, find, stepwise=False), True
                for k in range(2):
                    np.add.at(tables[k], s.slots[k] << np.uint32(1) | s.bit, 1)
        salt = TaskContext.get().partitionId() % SALTS
        for i, part in enumerate(tables.reshape(-1, PIECE) if seen else ()):
            yield piece_of(i, salt, part)

    def piece_of(i, salt, part):
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["piece", "salt", "data"])

    def add(batches):
        key, total = None, None
        for batch in batches:
            for *at, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "salt", "data"))):
                part = np.frombuffer(zlib.decompress(data), np.int64)
                if at == key:
                    total += part
                    continue
                if key is not None:
                    yield piece_of(*key, total)
                key, total = at, part.copy()
        if key is not None:
            yield piece_of(*key, total)

    form, n = "piece int, salt int, data binary", shuffle_partitions(spark)
    parts = mapped(documents.select("text"), run, form)
    parts = parts.repartition(n, "piece", "salt").sortWithinPartitions("piece", "salt").mapInArrow(add, form)  # so a piece's parts are never all in one task
    parts = parts.withColumn("salt", F.lit(0)).repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(add, form)
    out = np.zeros(2 * cells, np.int64)
    for r in parts.collect():  # as many pieces as the tables have
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(r["data"]), np.int64)
    return out.reshape(2, -1, 2)


class Model(NamedTuple):
    code: Code
    cells: np.ndarray  # by context and slot, see ``packed``
    weights: np.ndarray  # by gate, at a document's start; learned
    known: np.ndarray  # hashes of frequent words, sorted
    counts: np.ndarray
    total: int  # tokens
    distinct: int


def trust(seen: np.ndarray) -> np.ndarray:
    """Levels of contexts seen so often."""
    return (np.searchsorted(LEVELS, seen, "left") - 1).clip(0).astype(np.uint8)


def packed(logits: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """16 bits: a logit (a multiple of 1/256, 32 at most) and a level: one look-up in a small table finds both."""
    return ((np.rint(logits * 256).clip(-8191, 8191).astype(np.int32) + 8192) << 2 | levels).astype(np.uint16)


def mixing(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells by context and slot; the weights that learning starts from."""
    logits = np.log((tables[:, :, 1] + 0.4) / (tables[:, :, 0] + 0.4))
    weights = np.zeros((GATES, 3), np.float32)
    for g in range(GATES):
        raw = np.array([1.0, 0.5 * (g & 3), 0.7 * (g >> 2 & 3)])
        weights[g] = raw / raw.sum()
    return packed(logits, trust(tables.sum(axis=2))), weights


def without(tables: np.ndarray) -> np.ndarray:
    """Cells by context and 2 x slot + bit, each without one decision that fell so."""
    ones = (tables[:, :, 1, None] - np.array([0, 1])).clip(0)
    zeros = (tables[:, :, 0, None] - np.array([1, 0])).clip(0)
    return packed(np.log((ones + 0.4) / (zeros + 0.4)), trust(ones + zeros)).reshape(2, -1)


def _inputs(c: Code, cells: tuple[np.ndarray, np.ndarray], s: Stream) -> tuple[np.ndarray, np.ndarray]:
    """(3, decisions) logits of bit 1, and gates."""
    x = np.empty((3, len(s.node)), np.float32)
    np.take(c.logits, s.node, out=x[0])
    for k in range(2):
        np.multiply((cells[k] >> np.uint16(2)).astype(np.float32) - np.float32(8192), np.float32(1 / 256), out=x[k + 1])
    gate = (cells[0] & np.uint16(3)).astype(np.uint8)
    gate |= ((cells[1] & np.uint16(3)) << np.uint16(2)).astype(np.uint8)
    gate |= s.spelled.view(np.uint8) << np.uint8(4)
    return x, gate


def slopes(c: Code, cells: np.ndarray, weights: np.ndarray, s: Stream) -> np.ndarray:
    """(9, GATES): the cost's gradient (3) and second derivatives (6) in each gate's weights, summed over a stream's decisions."""
    x, gate = _inputs(c, tuple(np.take(cells[k], s.slots[k] << np.uint32(1) | s.bit) for k in range(2)), s)
    order = np.argsort(gate, kind="stable")  # of 8 bits: a radix sort
    x, bit, out = np.take(x, order, axis=1), s.bit[order], np.zeros((9, GATES))
    ends = np.cumsum(np.bincount(gate, minlength=GATES))
    for g, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if a < b:
            own = x[:, a:b]
            p = 1 / (1 + np.exp(-np.clip(weights[g] @ own, -20, 20)))
            bent = own * (p * (1 - p))
            out[:3, g] = own @ (p - bit[a:b])
            out[3:, g] = [bent[i] @ own[j] for i, j in PAIRS]
    return out


def learned(documents: DataFrame, code: Broadcast, tables: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights a Newton step on, over all training texts; a gate that met few decisions stays near where it was."""
    shared = documents.sparkSession.sparkContext.broadcast((without(tables), weights))

    def run(batches):
        c = Code(*code.value)
        total, find = np.zeros((9, GATES)), Lookup(c.words)
        for batch in slices(batches):
            for _, texts in chunks(_texts(batch)):
                total += slopes(c, *shared.value, stream(tokens(texts), c, find, stepwise=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = mapped(documents.select("text"), run, "sums array<double>").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros(9 * GATES)
    for r in sums.collect():
        total[r["i"]] = r["v"]
    shared.destroy()  # its copies take disk on every executor
    total, bends = total.reshape(9, GATES), np.zeros((GATES, 3, 3))
    for v, (i, j) in zip(total[3:], PAIRS):
        bends[:, i, j] = bends[:, j, i] = v
    step = np.linalg.solve(bends + PRIOR * np.eye(3), total[:3].T[:, :, None])[:, :, 0]
    return np.round(weights - step, 4).astype(np.float32)  # free of the order in which tasks were summed


def costs(m: Model, s: Stream, n: int) -> np.ndarray:
    """Natural log of each document's probability, negated."""
    if not len(s.node):
        return np.zeros(n)
    x, gate = _inputs(m.code, tuple(np.take(m.cells[k], s.slots[k]) for k in range(2)), s)
    x *= 1 - 2 * s.bit.astype(np.float32)  # from here on, logits of the bit that did not come
    z, more = np.zeros(len(gate), np.float32), np.empty(len(gate), np.float32)
    for k in range(3):
        np.take(m.weights[:, k].copy(), gate, out=more)
        more *= x[k]
        z += more
    added, seen = np.zeros((3, n), np.float32), np.full((3, n), TRUST)  # to the weights, and curvature, by document
    stops, a = np.concatenate([[0], np.cumsum(s.runs)]), 0
    for b in s.steps.tolist():
        start, stop, docs, runs = stops[a], stops[b], s.owner[a:b], s.runs[a:b]
        here, e, first = z[start:stop], more[: stop - start], stops[a:b] - start
        if a:
            for k in range(3):
                np.multiply(np.repeat(added[k].take(docs), runs), x[k, start:stop], out=e)
                here += e
        np.clip(here, -20, 20, out=here)
        if b < len(s.owner):  # what the last step teaches is of no use
            np.exp(here, out=e)
            e /= 1 + e
            bend = e * (1 - e)
            for k in range(3):
                own = x[k, start:stop]
                seen[k][docs] += CAUTION * np.add.reduceat(bend * own * own, first)
                added[k][docs] -= np.add.reduceat(e * own, first) / seen[k][docs]
        a = b
    return np.bincount(s.owner, weights=np.add.reduceat(np.log(1 + np.exp(z)), stops[:-1], dtype=np.float64), minlength=n)


def train(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the counts (h, n) of all training tokens."""
    counts = stored(word_counts(documents), "words")
    octets = np.zeros(257, np.int64)
    for r in counts.where("kind = 1").collect():
        octets[r["h"]] = r["n"]
    counts = counts.where("kind = 0").select("h", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count at which at most KNOWN words remain; counts are grouped by size, few of them differ
    seen, least = 0, 1 << 62
    sizes = counts.groupBy(F.when(F.col("n") < 1_000_000, F.col("n")).otherwise(F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n"))
    for r in sizes.collect():
        if seen + r["k"] > KNOWN:
            break
        seen, least = seen + r["k"], r["n"]
    top = counts.where(F.col("n") >= least).toArrow()
    known, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((known, -n))
    known, n = known[order], n[order]
    size = min(int((n > 1).sum()), VOCABULARY - 1)  # words seen once tell how often new ones come
    c = code(known[:size], n[:size], int(total - n[:size].sum()), octets)
    shared = documents.sparkSession.sparkContext.broadcast(tuple(c))  # plain values: workers need no copy of this package
    tables = context_counts(documents, shared)
    cells, weights = mixing(tables)
    weights = learned(documents, shared, tables, weights)
    shared.destroy()
    order = np.argsort(known)
    return Model(c, cells, weights, known[order], n[order], total, distinct), counts


def scores(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast((tuple(model.code), *model[1:]))
    below = model.total + model.distinct + 1
    tail = pa.list_(pa.struct([("h", pa.int64()), ("m", pa.int64())]))

    def run(batches):
        m = Model(Code(*shared.value[0]), *shared.value[1:])
        find, known = Lookup(m.code.words), Lookup(m.known)
        logs = np.log10((m.counts + 1) / below)
        for batch in slices(batches):
            out, texts = {k: [] for k in ("n_tokens", "n_known", "base", "score", "bytes", "tail")}, _texts(batch)
            by_size = sorted(range(len(texts)), key=lambda i: len(texts[i] or b""))  # texts of like length are read side by side
            texts = [texts[i] for i in by_size]
            batch = batch.take(pa.array(by_size, pa.int64()))
            for _, part in chunks(texts):
                t = tokens(part)
                docs, h = part, t.hash
                cost = costs(m, stream(t, m.code, find), len(part))
                out["score"] += (-cost / np.log(10)).tolist()
                doc = np.repeat(np.arange(len(part)), t.count)
                out["n_tokens"] += t.count.tolist()
                at, hit = known.find(h)
                out["n_known"] += np.bincount(doc[hit], minlength=len(docs)).tolist()
                out["base"] += np.bincount(doc[hit], weights=logs[at[hit]], minlength=len(docs)).tolist()
                rest, owner = h[~hit], doc[~hit]
                order = np.lexsort((rest, owner))
                rest, owner = rest[order], owner[order]
                new = np.ones(len(rest), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])
                (first,) = np.nonzero(new)
                many = np.diff(np.append(first, len(rest)))
                lists = [[] for _ in docs]
                for d, x, k in zip(owner[first].tolist(), rest[first].view(np.int64).tolist(), many.tolist()):
                    lists[d].append({"h": x, "m": k})
                out["tail"] += lists
            out["bytes"] = [len(t or b"") for t in texts]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), tail]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["doc_id", *out])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = mapped(narrow, run, "doc_id long, n_tokens long, n_known long, base double, score double, bytes long, tail array<struct<h:long,m:long>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.m").join(counts, "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + 1) / below)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"))
    return scored.drop("tail").join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("bytes")).alias("bits_per_byte"),
    )
