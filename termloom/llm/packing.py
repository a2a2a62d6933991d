"""Best-fit packing of token sequences by swap-based local search.

The plan for all documents is made on the histogram of piece lengths, which has at most ``capacity``
entries whatever the corpus. Bins with equal contents form one group with a multiplicity: ``fill`` opens
groups by best-fit decreasing, and ``improve`` then searches locally - it moves a piece, swaps one for one,
or swaps two for one between underfull bins, for as many equal bins at once as there are, whenever the sum
of squared fills grows, until bins empty and no exchange helps. Pieces find their place by their rank among
pieces of equal length: ranks are counted per (length, salt), so no length, however common, meets in one task.

Edge cases: null text is empty (its one token is the end token); repeated rows are packed each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions, slices, stored
from .words import M2, mix, powers

CAPACITY = 4096
#: Bytes that a worker spends on remembering the tokens of words, about: WORD_BYTES and both texts for each.
CACHE_BYTES = 72 << 20
WORD_BYTES = 190
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level models write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def _classes() -> np.ndarray:
    """Of 16-bit code points: 0 white space, 1 letters, 2 numbers, 3 others; for texts that ``OTHER`` lets pass."""
    kinds = [0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in map(chr, range(0x370))]
    return np.array(kinds + [3] * (0x10000 - 0x370), np.uint8)


def _same(codes: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each stretch of codes equals the one of number like."""
    length = end - start
    if (length != length[like]).any():
        return False
    inside = np.arange(int(length.sum()), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
    return bool((codes[np.repeat(start.astype(np.int32), length) + inside] == codes[np.repeat(start[like].astype(np.int32), length) + inside]).all())


class WordCache(dict):
    """Little-endian ids of pre-tokens, which this tokenizer encodes each by itself.

    Texts of Latin letters (all code points below U+0250, which are in normal form C) are split here, many at
    once: pre-tokens are runs of letters, runs of other marks, and single numbers. They are grouped by 64-bit
    hashes, each occurrence is compared with the first one of its group, and new ones go to the BPE model. Texts
    with apostrophes, which may begin contractions, are split by a pattern; texts of other scripts at white space,
    and each new part goes through the whole tokenizer.
    """

    #: The tokenizer's pre-tokens for Latin texts, in lower case.
    SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")
    #: Beyond Latin letters; control characters on which the libraries' white space differs; perhaps special tokens.
    OTHER = re.compile(r"[^\x00-\u024f]|[\x1c-\x1f]|<\|")
    LETTERS = _byte_letters()
    CLASSES = _classes()
    CHUNK = 1 << 17

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key: str | tuple[str]) -> bytes:
        word = key[0] if isinstance(key, tuple) else key
        out = self.whole(word) if isinstance(key, tuple) else self.encoded(word)
        if self.bytes >= CACHE_BYTES:
            self.clear()
            self.bytes = 0
        self[key] = out
        self.bytes += WORD_BYTES + len(word) + len(out)
        return out

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out, plain, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if "'" in text or self.OTHER.search(text):
                out[i] = self.text_ids(text)
                continue
            plain.append(i)
            size += len(text)
            if size > self.CHUNK:
                self._latin(texts, plain, out)
                plain, size = [], 0
        if plain:
            self._latin(texts, plain, out)
        return out

    def _latin(self, texts: list[str], which: list[int], out: list[bytes]) -> None:
        low = [texts[i].lower() for i in which]
        joined = " ".join([*low, ""])
        codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        kind = self.CLASSES[codes]
        change = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
        edge = np.append(np.flatnonzero(change), len(codes))
        begins = kind[edge[:-1]] != 0
        start, end = edge[:-1][begins], edge[1:][begins]
        up, down = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        _, first, which_one = np.unique(mix((sums[end] - sums[start]) * down[start] + M2), return_index=True, return_inverse=True)
        if not _same(codes, start, end, first[which_one]):  # two words of one hash
            for i in which:
                out[i] = self.text_ids(texts[i])
            return
        ids = [self[joined[a:b]] for a, b in zip(start[first].tolist(), end[first].tolist())]
        pool = np.frombuffer(b"".join(ids), "<u4")
        length = np.array([len(x) // 4 for x in ids], np.int64)
        place = np.cumsum(length) - length
        n = length[which_one]
        flat = pool[np.repeat(place[which_one] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        stops = np.cumsum([len(t) + 1 for t in low])
        per_text = np.bincount(np.searchsorted(stops, start, "right"), weights=n, minlength=len(low)).astype(np.int64)
        stop = np.cumsum(per_text)
        for i, a, b in zip(which, (stop - per_text).tolist(), stop.tolist()):
            out[i] = flat[a:b].tobytes()

    def encoded(self, word: str) -> bytes:
        """Ids of a pre-token, by the model."""
        written = word.encode().decode("latin-1").translate(self.LETTERS)
        return np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()

    def text_ids(self, text: str) -> bytes:
        if not self.OTHER.search(text):
            return b"".join([self[w] for w in self.SPLIT.findall(text.lower())])
        # str.split() also cuts at four control characters that the tokenizer keeps
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join([self[(w,)] for w in text.split()])


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Every document's tokens and the end token, cut only where they exceed capacity; with_ids adds them as little-endian bytes."""
    path = tokenizer or default_tokenizer()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema, stop = pa.schema(fields), np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(path)
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), cache.many([t or "" for t in batch.column(1).to_pylist()])):
                ids += stop
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(fields)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECE + ", ids binary" * with_ids)


def fill(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing: {contents, longest first: number of such bins}."""
    left = {k: n for k, n in histogram.items() if n}
    below = np.zeros(capacity + 1, np.int64)  # the longest length left that is at most i
    below[sorted(left)] = sorted(left)
    below = np.maximum.accumulate(below)
    bins: Counter = Counter()
    while top := int(below[capacity]):
        uses: Counter = Counter()
        free, k = capacity, top
        while k:
            n = min(free // k, left[k])
            uses[k] += n
            free -= n * k
            k = int(below[min(free, k - 1)])
        many = min(left[k] // n for k, n in uses.items())
        bins[tuple(sorted(uses.elements(), reverse=True))] += many
        for k, n in uses.items():
            left[k] -= n * many
            if not left[k]:
                last = int(below[k - 1])
                i = k
                while i <= capacity and below[i] == k:
                    j = min(capacity + 1, i + 256)
                    block = below[i:j]
                    block[block == k] = last
                    i = j
    return bins


def _sums(source: tuple, pairs: bool) -> tuple[np.ndarray, list[tuple]]:
    """Sorted totals of single pieces, or of two, that a bin can give, and such pieces."""
    have = Counter(source)
    values = np.array(sorted(have), np.int64)
    if not pairs:
        return values, [(int(v),) for v in values]
    i, j = np.triu_indices(len(values))
    twice = np.array([have[int(v)] > 1 for v in values], bool)
    there = (i != j) | twice[i]
    totals, first = np.unique((values[i] + values[j])[there], return_index=True)
    return totals, [(int(a), int(b)) for a, b in zip(values[i[there][first]], values[j[there][first]])]


def _exchange(source: tuple, items: np.ndarray, fills: np.ndarray, many: np.ndarray, capacity: int):
    """The best exchange for one bin: (given pieces, row of items: the target and the piece it gives back, 0 for none).

    many: how many bins of a row's group take part, 0 for none.

    A target gains the most from the largest total that it can take, so one binary search for each row finds it.
    """
    have, best = sum(source), (0, None, None)
    for pairs in (False, True):
        totals, given = _sums(source, pairs)
        place = np.searchsorted(totals, items + capacity - fills, "right") - 1
        delta = np.where(place >= 0, totals[place] if len(totals) else 0, 0) - items
        fits = (many > 0) & (place >= 0) & (delta > 0) & (fills + delta > have)
        if pairs:
            fits &= items > 0
        gain = np.where(fits, 2 * delta * (fills - have + delta), 0)
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > best[0]:
            best = (int(gain[at]), given[place[at]], at)
    return best[1], best[2]


def _without(contents: tuple, out: tuple, add: tuple) -> tuple:
    have = Counter(contents)
    have.subtract(out)
    have.update(add)
    return tuple(sorted(have.elements(), reverse=True))


class _Open:
    """Groups of equal underfull bins, with a row for each piece that one may give back (0: none)."""

    def __init__(self, bins: Counter, capacity: int):
        self.capacity, self.groups, self.number = capacity, [], {}
        self.which = self.items = self.fills = np.zeros(0, np.int64)
        self.many = np.zeros(0, np.int64)  # by group
        self.set({b: n for b, n in bins.items() if n})

    def set(self, new: dict[tuple, int]) -> None:
        """Groups now have so many bins."""
        rows, count = [], []
        for b, n in new.items():
            if b in self.number:
                self.many[self.number[b]] = n
            elif (fill := sum(b)) < self.capacity and n:
                self.number[b] = len(self.groups)
                rows += [(len(self.groups), y, fill) for y in (0, *sorted(set(b)))]
                self.groups.append(b)
                count.append(n)
        if rows:
            which, items, fills = np.array(rows, np.int64).T
            self.which, self.items, self.fills = np.append(self.which, which), np.append(self.items, items), np.append(self.fills, fills)
            self.many = np.append(self.many, np.array(count, np.int64))


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search over groups of equal bins, emptiest first, until bins are as few as can be or no exchange helps."""
    bins = Counter({k: n for k, n in bins.items() if n})
    tokens = sum(sum(b) * n for b, n in bins.items())
    fewest, changed = -(-tokens // capacity), True
    while changed:
        changed, open_, total = False, _Open(bins, capacity), sum(bins.values())
        heap = [(sum(b), b) for b in open_.groups]
        heapq.heapify(heap)
        while heap and total > fewest:
            source = heapq.heappop(heap)[1]
            if not bins[source]:
                continue
            many = np.minimum(open_.many, bins[source])
            many[open_.number[source]] = bins[source] // 2  # two of a kind
            given, at = _exchange(source, open_.items, open_.fills, many[open_.which], capacity)
            if given is None:
                continue
            changed = True
            target, back = open_.groups[open_.which[at]], (int(open_.items[at]),) if open_.items[at] else ()
            times, touched = bins[source] // 2 if source == target else min(bins[source], bins[target]), {source, target}
            for old, new in ((source, _without(source, given, back)), (target, _without(target, back, given))):
                bins[old] -= times
                if new:
                    bins[new] += times
                    touched.add(new)
                    if sum(new) < capacity:
                        heapq.heappush(heap, (sum(new), new))
                else:
                    total -= times
            open_.set({b: bins[b] for b in touched})
            if bins[source]:
                heapq.heappush(heap, (sum(source), source))
    return +bins


def placement(bins: Counter) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where pieces of a length go, by rank."""
    used: Counter = Counter()
    rows, first = [], 0
    for contents, many in sorted(bins.items(), reverse=True):
        offset = 0
        for length in contents:
            rows.append((length, used[length], first, offset))
            used[length] += many
            offset += length
        first += many
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (pieces, with any further columns) with sequence_id and offset."""
    spark = cut.sparkSession
    salts = shuffle_partitions(spark)
    row = F.monotonically_increasing_id()
    table = stored(cut.withColumn("_row", row).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int")), "pieces")
    counts = table.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(placement(improve(fill(histogram, capacity), capacity)))

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = table.withColumn("_rank", rank).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    kept = [c for c in cut.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = plan.value.T
        keys = (length << 42) + first
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            key = (batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64) << 42) + rank
            at = np.searchsorted(keys, key, "right") - 1
            new = [pa.array(sequence[at] + rank - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*kept, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
