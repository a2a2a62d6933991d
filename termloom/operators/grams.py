"""Word n-grams of several documents, counted level by level.

Words are hashed once; an n-gram is a 64-bit hash made of its words' hashes. The lines of a document are read together: where they
stand, if every document is found to stand in one place, else brought together first. So a task counts each n-gram of a document
once and merges its documents before anything is shuffled; counts are shuffled as sorted hashes of a range, by the bytes of their
differences. Longer n-grams are only counted where every pair of neighbouring words in them is frequent itself (a Bloom bitmap of
fixed size: what it lets through too much is counted and dropped). Words are read again for frequent n-grams only, those of some
documents first, and of further ones for n-grams that were not among these.

Memory of a task: ``TOKENS`` words, 8 bytes for each distinct n-gram of a document that has more words than that, and the counts
of a range of hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut

#: Words that a task merges at once.
TOKENS = 1 << 20
#: Bits of a bitmap, characters of a partition.
BITS = 1 << 27
CHARACTERS = 16 << 20
#: Sixteenths of the documents whose words are read one after the other.
ROUNDS = [(0, 1), (1, 4), (4, 16)]


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bits of the hashes in column h: of fixed size, so it may pass through the driver."""
    k = F.shiftrightunsigned("h", 65 - BITS.bit_length()) + 1
    found = frequent.groupBy(F.bitmap_bucket_number(k).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"))
    out = np.zeros(BITS >> 3, np.uint8)
    for r in found.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["b"] - 1) * 4096 :][: len(part)] = part
    return out


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then their next ones, as many as the greatest has: what is alike stands together."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, rows).T
    out[:, : planes.shape[1]] = planes
    return out.view("<u8").ravel()


def _summed(bits: int, least: int):
    """Merges packed counts of ranges of hashes: n-grams of at least ``least`` documents, and documents that stand in several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), rows in itertools.groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2]):
            rows = list(rows)
            h = np.concatenate([np.cumsum(_unpacked(r[3], r[2])) for r in rows])
            order = np.argsort(h, kind="stable")
            h = h[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            documents, n = (np.add.reduceat(np.concatenate([_unpacked(r[c], r[2]) for r in rows])[order], starts).astype(np.int64) for c in (4, 5))
            kept = documents >= (least if kind else 2)
            h = h[starts][kept] + (np.uint64(part) << np.uint64(64 - bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(documents[kept]), pa.array(n[kept])], ["kind", "h", "documents", "n"])

    return run


def grams(units: DataFrame, most: int = 4, least: int = 3) -> DataFrame:
    """(gram, documents, n): word n-grams of one to ``most`` words in at least ``least`` documents, with counts."""
    spark = units.sparkSession
    size = units.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // CHARACTERS)
    tokens, bits = TOKENS, parts.bit_length() + 1
    in_place = units.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

    def split(df: DataFrame) -> DataFrame:
        return df.select("doc_id", F.array_remove(F.split(T.word_key(F.col("text")), " "), "").alias("w")).select(F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("doc"), F.col("doc_id").isNotNull().alias("named"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("x"))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    def levels(x: np.ndarray, left: np.ndarray, top: int, pairs: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, starts, hashes) of the n-grams; left: words up to the line's end; pairs: bits of frequent pairs."""
        x = x.view(np.uint64)
        at, h = np.arange(len(x)), x
        yield 1, at, h
        for n in range(2, top + 1):
            keep = left[at] >= n
            at, h = at[keep], mixed(h[keep] * np.uint64(0x9E3779B97F4A7C15) + x[at[keep] + n - 1])
            if n == 2 and pairs is not None:
                good = np.zeros(len(x) + 1, bool)
                good[at] = has(pairs, h)
            if n > 2 and pairs is not None:
                keep = good[at] & good[at + n - 2] if n == 3 else good[at + n - 2]
                at, h = at[keep], h[keep]
            yield n, at, h

    def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        k = h >> np.uint64(65 - BITS.bit_length())
        return ((bitmap[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Values of a list column one after the other, and how many of its list are left from each on."""
        n = np.diff(column.offsets.to_numpy())
        return column.flatten(), np.repeat(np.cumsum(n), n) - np.arange(n.sum())

    def counted(df: DataFrame, low: int, top: int, shared=None) -> DataFrame:
        """(h, documents, n) of n-grams of low to top words."""
        nonlocal in_place
        whole = in_place
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

        def ranges(kind: int, h: np.ndarray, documents: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            """Counts of sorted hashes, a row for each range that has some."""
            edges = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
            rows = [(kind, part, j - i, _packed(np.diff(h[i:j] & np.uint64((1 << (64 - bits)) - 1), prepend=np.uint64(0))), _packed(documents[i:j]), _packed(n[i:j])) for part, (i, j) in enumerate(itertools.pairwise(edges.tolist())) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "part", "rows", "h", "documents", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = shared.value if shared is not None else None
            held: list[tuple] = []
            seen: dict[int, np.ndarray] = {}  # of the document whose lines were counted in part
            count, part = 0, None

            def count_held(until: int):
                nonlocal seen, part
                doc, named, x, left = (np.concatenate(c) for c in zip(*held))
                now, rest = slice(0, until), slice(until, len(x))
                held[:] = [tuple(c[rest] for c in (doc, named, x, left))] if until < len(x) else []
                doc, named, x, left = doc[now], named[now], x[now], left[now]
                ordinal = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
                again, last = (seen if doc[0] == part else {}), ordinal[-1]
                if whole:  # documents that begin here; one that does twice is not all in one place
                    begun = np.concatenate([[doc[0] != part], doc[1:] != doc[:-1]]) & named
                    if begun.any():
                        one, times = np.unique(doc[begun].view(np.uint64), return_counts=True)
                        yield ranges(0, one, times, times)
                seen, part = dict(again) if last == 0 else {}, doc[-1]
                for n, at, h in levels(x, left, top, pairs):
                    if n < low or not len(h):
                        continue
                    order = np.argsort(h, kind="stable")
                    hs, ds, at = h[order], ordinal[at[order]], at[order]
                    new = np.concatenate([[True], hs[1:] != hs[:-1]])
                    first = new | np.concatenate([[True], ds[1:] != ds[:-1]])
                    counts = first & named[at]
                    if n in again:
                        counts &= ~((ds == 0) & np.isin(hs, again[n]))
                    own = hs[first & (ds == last)]
                    seen[n] = np.union1d(own, again[n]) if n in again and last == 0 else own
                    starts = np.flatnonzero(new)
                    total = np.diff(np.append(starts, len(hs)))
                    yield ranges(1, hs[starts], np.add.reduceat(counts.astype(np.int64), starts), total)

            for b in batches:
                x, left = flat(b.column("x"))
                n = np.diff(b.column("x").offsets.to_numpy())
                doc, named = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in ("doc", "named"))
                held.append((doc, named, x.to_numpy(), left))
                count += len(doc)
                if count >= tokens:
                    # whole documents, if there are any beside the last
                    doc = np.concatenate([c[0] for c in held])
                    change = np.flatnonzero(doc[1:] != doc[:-1])
                    until = int(change[-1]) + 1 if len(change) else len(doc)
                    yield from count_held(until)
                    count -= until
            if count:
                yield from count_held(count)

        rows = df.select("doc_id", "text")
        rows = rows if in_place else rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
        found = split(rows).select("doc", "named", "x").mapInArrow(run, "kind int, part int, rows int, h binary, documents binary, n binary")
        found = cut(found.repartition(parts, "part").sortWithinPartitions("kind", "part").mapInArrow(_summed(bits, least), "kind int, h long, documents long, n long"))
        if in_place and not found.where("kind = 0").isEmpty():
            in_place = False
            return counted(df, low, top, shared)
        return found.where("kind = 1").drop("kind")

    frequent = counted(units, 1, min(most, 2))
    if most > 2:
        frequent_pairs = spark.sparkContext.broadcast(_bitmap(frequent))
        frequent = frequent.unionByName(counted(units, 3, most, frequent_pairs))

    def reader(shared):
        """Reads (h, gram) of the n-grams that the bitmap has."""
        return lambda batches: read(batches, shared.value)

    def read(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
        def told(xs, lefts, words):
            x, left, w = np.concatenate(xs), np.concatenate(lefts), pa.chunked_array(words).to_pylist()
            for n, at, h in levels(x, left, most, None if most < 3 else frequent_pairs.value):
                keep = has(bitmap, h)
                one, first = np.unique(h[keep], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array([" ".join(w[i : i + n]) for i in at[keep][first].tolist()], pa.string())], ["h", "gram"])

        xs, lefts, words, count = [], [], [], 0
        for b in batches:
            x, left = flat(b.column("x"))
            xs.append(x.to_numpy())
            lefts.append(left)
            words.append(b.column("w").flatten())
            count += len(left)
            if count >= tokens:
                yield from told(xs, lefts, words)
                xs, lefts, words, count = [], [], [], 0
        if count:
            yield from told(xs, lefts, words)

    out, left = None, frequent
    for begin, end in ROUNDS:
        share = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(16))
        texts = split(units.where((share >= begin) & (share < end))).select("w", "x").mapInArrow(reader(spark.sparkContext.broadcast(_bitmap(left))), "h long, gram string")
        found = texts.repartition(parts, "h").distinct().join(left, "h")
        if end < 16:
            found = cut(found)
            left = cut(left.join(found.select("h"), "h", "left_anti"))
        found = found.select("gram", "documents", "n")
        out = found if out is None else out.unionByName(found)
    return out
