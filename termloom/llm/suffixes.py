"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A window (``length`` bytes of one text) is repeated if the same bytes start anywhere else; bytes of repeated windows
are removed. Sorting a suffix for every byte would multiply the corpus, so suffixes start at anchors: in each window
the least of its hashed grams, the first one of ties. Equal windows have their anchor at the same place, whatever stands around
them. Hashes only prune: windows whose anchor's gram occurs once are unique, and go before anything is sorted.

Then each task sorts the suffixes at its anchors, puts equal ones together with the number of their places, and sends
them front-coded, each with what follows the prefix that it shares with the one before, to ranges of the sorted order.
A range merges its runs in a loser tree that knows the common prefix of every candidate and the last winner and compares
bytes beyond it only. The merged order with its common prefixes tells which suffixes agree in how many bytes, the
sorted reversed texts before the anchors which agree there; two windows are equal if both do, far enough.

Anchors whose gram stands in more than ``CROWD`` different contexts (a passage common to a large part of the corpus)
do not meet: their windows get anchors of longer grams, so that such a crowd parts by what surrounds the passage, up to
grams as long as windows, which meet with equal ones only. Ranges are cut between grams, at a bounded sample of them;
beyond ``MOST_RANGES`` ranges are parted by a hash of the gram, too. Texts are told apart by their MD5. They are
shuffled twice, compressed: to meet their anchors, and to meet what was found.

Edge cases: null text is empty; texts shorter than ``length`` keep all; repeated rows repeat each other; a null doc_id
stays; extra columns are ignored; an empty table gives an empty result; what is kept of a text need not be UTF-8.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, shuffle_partitions, slices, stored
from .words import M2, mix, powers

LENGTH = 400
#: Lengths of grams, as shares of a window, tried one after another where many contexts share one.
GRAMS = (0.2, 0.5, 0.8, 0.97, 1.0)
CROWD = 20_000
#: Suffixes of a range, ranges that are told apart by samples, sampled grams of a range.
RANGE_ROWS, MOST_RANGES, SAMPLES = 20_000, 4096, 12
#: Windows that are hashed at once, and bytes of text whose suffixes make a run.
CHUNK, RUN_BYTES = 1 << 20, 1 << 24


def grams_for(length: int) -> list[int]:
    return sorted({max(1, round(length * share)) for share in GRAMS})


# Anchors -------------------------------------------------------------------------------------------------------------


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each width neighbours: of running minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def anchors(raw: np.ndarray, ends: np.ndarray, gram: int, length: int, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """(text, anchor, first window, last window, hash of the gram, hash of all that the windows cover) of texts that end at ends.

    Windows of one anchor stand together. wanted: which bytes' windows count; none cross a text's end.
    """
    found = []
    owner = np.searchsorted(ends, np.arange(len(raw)), "right").astype(np.int32) if len(ends) > 1 else np.zeros(len(raw), np.int32)
    for start in range(0, len(raw) - length + 1, CHUNK):
        part = raw[start : start + CHUNK + length - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        n = len(part) - gram + 1
        hashes = mix((sums[gram:] - sums[:n]) * down[:n] + M2)
        first = least((hashes & np.uint64(0xFFFFFFFF << 32)) | np.arange(n, dtype=np.uint64), length - gram + 1)
        at = (first & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = owner[start : start + len(at)]
        ok = np.arange(start + length, start + length + len(at)) <= ends[own]
        if wanted is not None:
            ok &= wanted[start : start + len(at)]
        p = np.flatnonzero(ok)
        if not len(p):
            continue
        new = np.append(True, (np.diff(p) != 1) | (np.diff(at[p]) != 0) | (np.diff(own[p]) != 0))
        lo, hi = p[new], p[np.append(new[1:], True)]
        a = at[lo]
        cover = mix((sums[hi + length] - sums[lo]) * down[lo]) ^ mix((a - lo).astype(np.uint64) * M2 + (hi - lo).astype(np.uint64))
        found.append([own[lo], a + start, lo + start, hi + start, hashes[a], cover])
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2


_ANCHOR = "hash long, at int, lo int, hi int, gram long, cover long, sample binary"


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def anchored(texts: DataFrame, gram: int, length: int) -> DataFrame:
    """Anchors of all windows of texts (hash, text), or of those that a column ``open`` of ranges names.

    A text that a task meets again and again gives its anchors twice, which tells that they are not alone."""
    names = [c.split()[0] for c in _ANCHOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for b in slices(batches):
            for h in (hashes := b.column("hash").to_pylist()):
                met[h] = met.get(h, 0) + 1
            count = Counter(hashes)
            fresh = []
            for h in hashes:  # the first two rows of a text in this task
                fresh.append(met[h] - count[h] < 2)
                count[h] -= 1
            b = b.filter(pa.array(fresh, pa.bool_()))
            raw, ends = _joined(b)
            starts, wanted = np.append(0, ends[:-1]), None
            if "open" in b.schema.names:
                wanted = np.zeros(len(raw), bool)
                for s, ranges in zip(starts.tolist(), b.column("open").to_pylist()):
                    for r in ranges:
                        wanted[s + r["lo"] : s + r["hi"] + 1] = True
            own, at, lo, hi, hashes, cover = anchors(raw, ends, gram, length, wanted)
            shift = starts[own]
            sample = [raw[a : a + gram].tobytes() if h % 64 == 0 else None for a, h in zip(at.tolist(), hashes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("hash").take(pa.array(own)), *(pa.array((x - shift).astype(np.int32)) for x in (at, lo, hi)), *(pa.array(x.view(np.int64)) for x in (hashes, cover)), pa.array(sample, pa.binary())],
                names,
            )

    return mapped(texts, run, _ANCHOR)


# Sorted runs ---------------------------------------------------------------------------------------------------------


def common_prefixes(strings: list[bytes]) -> np.ndarray:
    """Bytes that each string shares with the one before, 0 for the first; 32 at a time, for all at once."""
    n, step = len(strings), 32
    if n < 2:
        return np.zeros(n, np.int64)
    sizes = np.array([len(s) for s in strings], np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join([*strings, bytes(step)]), np.uint8), step)
    first, most = np.cumsum(sizes) - sizes, np.minimum(sizes[1:], sizes[:-1])
    at, live = np.zeros(n - 1, np.int64), np.flatnonzero(most)
    while len(live):
        differ = view[first[live] + at[live]] != view[first[live + 1] + at[live]]
        end = differ.any(axis=1)
        at[live] += np.where(end, differ.argmax(axis=1), step)
        live = live[~end & (at[live] < most[live])]
    return np.append(0, np.minimum(at, most))


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Bytes that a and b share; as many as known are not looked at again."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + n - (differ.bit_length() + 7) // 8
        known += 64
    return end


def merged(runs: list[list[tuple]], shared=_shared) -> Iterator[tuple]:
    """Merges sorted runs of (bytes shared with the one before, string, ...): the same rows, in order, with what each shares with the one before it now.

    A loser tree in which every run's head knows how many bytes it shares with the last winner: of two heads, the one that
    shares more is less; only where both share as many are they compared, from there on, and the loser keeps what was found.
    """
    width = 1 << max(0, len(runs) - 1).bit_length()
    rows = [iter(r) for r in runs] + [iter(())] * (width - len(runs))
    head = [next(r, None) for r in rows]
    known = [0] * width

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        if head[i] is None or head[j] is None:
            return (j, i) if head[i] is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        a, b = head[i][1], head[j][1]
        n = shared(a, b, known[i])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    losers, winners = [0] * width, [*[0] * width, *range(width)]
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if width > 1 else 0
    while head[best] is not None:
        yield (known[best], *head[best][1:])
        head[best] = following = next(rows[best], None)
        known[best] = following[0] if following else 0
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


_RUN = "range long, run long, seq int, shares int, rest binary, before binary, near int, n long, keys array<binary>, at array<int>"


def sorted_runs(texts: DataFrame, gram: int, length: int, bounds: list[bytes], parts: int) -> DataFrame:
    """Front-coded runs of the suffixes at anchors (a column of their places) of texts, by range.

    A row is a suffix, up to the end of its anchor's last window, with the reversed bytes before it (``before``), the
    distance of the nearest window (``near``), the number of its places, and the distinct ones."""
    names = [c.split()[0] for c in _RUN.split(", ")]
    shared = texts.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for b in unpacked(batches):
            places: dict[tuple[bytes, bytes, int], list] = {}
            for text, anchors in zip(b.column("text").to_pylist(), b.column("anchors").to_pylist()):
                key = hashlib.md5(text).digest()
                for r in anchors:
                    at, lo, hi = r["at"], r["lo"], r["hi"]
                    if hi + length > len(text):  # of another text with the same hash
                        continue
                    got = places.setdefault((text[at : hi + length], text[lo:at][::-1], at - hi), [0, set()])
                    got[0] += 1
                    got[1].add((key, at))
            order = sorted(places)
            ranges = [bisect_right(shared.value, s[0][:gram]) * parts + (int.from_bytes(hashlib.blake2b(s[0][:gram], digest_size=4).digest()) % parts if parts > 1 else 0) for s in order]
            if parts > 1:
                order = [order[i] for i in sorted(range(len(order)), key=lambda i: (ranges[i], i))]
                ranges.sort()
            shares = common_prefixes([s[0] for s in order])
            shares[np.flatnonzero(np.append(True, np.diff(ranges) != 0))[: len(order)]] = 0
            for k in range(0, len(order), 4096):
                s, c, r = order[k : k + 4096], shares[k : k + 4096].tolist(), ranges[k : k + 4096]
                refs = [sorted(places[x][1]) for x in s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r, pa.int64()), pa.array([number] * len(s), pa.int64()), pa.array(range(k, k + len(s)), pa.int32()), pa.array(c, pa.int32()), pa.array([x[0][n:] for x, n in zip(s, c)], pa.binary()), pa.array([x[1] for x in s], pa.binary()),
                        pa.array([x[2] for x in s], pa.int32()), pa.array([places[x][0] for x in s], pa.int64()), pa.array([[q[0] for q in x] for x in refs], pa.list_(pa.binary())), pa.array([[q[1] for q in x] for x in refs], pa.list_(pa.int32())),
                    ],
                    names,
                )
            number += 1

    return mapped(texts, run, _RUN)


# Equal windows -------------------------------------------------------------------------------------------------------


def equal_windows(shares: np.ndarray, before: list[bytes], near: np.ndarray, repeated: np.ndarray, gram: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(suffix, nearest, farthest) distances of windows from their anchors that are repeated, for different suffixes in order.

    shares: what each shares with the one before; before: reversed bytes before the anchor, as many as the farthest
    window's distance; near: the nearest window's distance; repeated: suffixes of several places, all of whose windows are."""
    far = np.array([len(x) for x in before])
    for i in np.flatnonzero(repeated).tolist():
        yield i, int(near[i]), int(far[i])
    group = np.cumsum(shares < gram)
    if not len(group) or (live := np.flatnonzero(np.bincount(group)[group] > 1)).size == 0:
        return
    right = np.where(np.append(True, np.diff(live) != 1), 0, shares[live])  # those left out stand between groups
    order = np.array(sorted(range(len(live)), key=lambda i: before[live[i]]))
    left, place = common_prefixes([before[live[i]] for i in order]), np.argsort(order)
    lo, hi, alone = near[live], far[live], ~repeated[live]
    hits_i, hits_l = [], []
    for distance in range(int(lo.min()), int(hi.max()) + 1):
        part = np.flatnonzero((lo <= distance) & (hi >= distance))
        if len(part) < 2:
            continue
        same = np.cumsum(right < length - distance)[part] * len(live) + np.cumsum(left < distance)[place[part]]
        _, back, times = np.unique(same, return_inverse=True, return_counts=True)
        hit = part[(times[back] > 1) & alone[part]]
        hits_i.append(hit)
        hits_l.append(np.full(len(hit), distance))
    if hits_i and (i := np.concatenate(hits_i)).size:
        d = np.concatenate(hits_l)
        o = np.lexsort((d, i))
        i, d = i[o], d[o]
        new = np.append(True, (np.diff(i) != 0) | (np.diff(d) != 1))
        yield from zip(live[i[new]].tolist(), d[new].tolist(), d[np.append(new[1:], True)].tolist())


def repeats_of(runs: DataFrame, gram: int, length: int) -> DataFrame:
    """(key, lo, hi): ranges of repeated windows' starts, some more than once."""
    rows = runs.repartition(shuffle_partitions(runs.sparkSession), "range").sortWithinPartitions("range", "run", "seq")

    def found(block: list[list]) -> pa.RecordBatch:
        """block: [shares, suffix, before, near, n, places], whole groups of a gram."""
        keys, lo, hi = [], [], []
        for i, nearest, farthest in equal_windows(np.array([r[0] for r in block], np.int64), [r[2] for r in block], np.array([r[3] for r in block], np.int64), np.array([r[4] > 1 for r in block]), gram, length):
            for key, at in block[i][5]:
                keys.append(key)
                lo.append(at - farthest)
                hi.append(at - nearest)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "lo", "hi"])

    def finish(runs: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        block: list[list] = []
        equal: dict = {}  # of one suffix: by what stands before it
        for shares, suffix, before, near, n, places in merged(runs):
            if shares < gram and len(block) >= RANGE_ROWS:
                yield found(block)
                block = []
            if not block or shares < len(suffix) or len(suffix) != len(block[-1][1]):
                equal = {}
            if (same := equal.get((before, near))) is not None:
                same[4] += n
                same[5].update(places)
                continue
            block.append([shares, suffix, before, near, n, set(places)])
            equal[before, near] = block[-1]
        yield found(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, suffix, runs = None, None, b"", []
        for b in batches:
            for where, number, shares, rest, before, near, n, keys, at in zip(*(b.column(c).to_pylist() for c in ("range", "run", "shares", "rest", "before", "near", "n", "keys", "at"))):
                if where != now:
                    if runs:
                        yield from finish(runs)
                    now, last, runs = where, None, []
                if number != last:
                    last = number
                    runs.append([])
                suffix = suffix[:shares] + rest
                runs[-1].append((shares, suffix, before, near, n, list(zip(keys, at))))
        if runs:
            yield from finish(runs)

    return rows.mapInArrow(run, "key binary, lo int, hi int")


def _bounds(anchors: DataFrame, total: int) -> tuple[list[bytes], int]:
    """Grams that cut the sorted order into ranges, from a bounded sample, and parts by hash of each range."""
    ranges = -(-total // RANGE_ROWS)
    told = min(ranges, MOST_RANGES)
    if told < 2:
        return [], ranges
    sample = anchors.where("sample is not null").select("sample")
    share = min(1.0, SAMPLES * told * 64 / total)
    grams = sorted(bytes(r[0]) for r in sample.sample(share, seed=1).limit(4 * SAMPLES * told).collect())
    return [grams[i * len(grams) // told] for i in range(1, told)] if grams else [], -(-ranges // told)


def packed(documents: DataFrame, *columns: str) -> DataFrame:
    """documents' columns with their texts compressed, to be shuffled (null: empty), and their hashes and MD5."""
    rows = documents.select(*columns, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("key", F.unhex(F.md5("text"))).withColumn("size", F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for b in slices(batches):
            texts = pa.array([codec.compress(t, asbytes=True) for t in b.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield b.set_column(b.schema.names.index("text"), "text", texts)

    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields])
    return mapped(rows, run, schema)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts as they were (binary), few at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        sizes = np.cumsum(batch.column("size").to_numpy())
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + RUN_BYTES, "right")))
            b = batch.slice(start, stop - start)
            texts = [codec.decompress(t, n, asbytes=True) if n else b"" for t, n in zip(b.column("text").to_pylist(), b.column("size").to_pylist())]
            yield b.set_column(b.schema.names.index("text"), "text", pa.array(texts, pa.binary()))
            start = stop


def repeats(documents: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(key, ranges): repeated windows' starts, as ranges (lo, hi), of each text that has any; key: MD5 of the text."""
    long = documents.where(F.octet_length("text") >= length)
    now, out = long.select(F.xxhash64("text").alias("hash"), "text"), None
    for gram in grams_for(length):
        anchors = anchored(now, gram, length)  # made twice rather than stored
        grams = anchors.groupBy("gram", "cover").agg(F.count("*").alias("n")).groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
        grams = stored(grams.where("n > 1").select("gram", ((F.col("contexts") > crowd) & F.lit(gram < length)).alias("crowded")), "grams")
        rows = stored(anchors.join(grams, "gram").select("hash", "at", "lo", "hi", "sample", "crowded"), "candidates")
        counts = {r.crowded: r["count"] for r in rows.groupBy("crowded").count().collect()}
        if counts.get(False):
            calm = rows.where("not crowded")
            bounds, parts = _bounds(calm, counts[False])
            # stored, so that the join with many copies of one text can be split
            each = stored(calm.groupBy("hash").agg(F.collect_set(F.struct("at", "lo", "hi")).alias("anchors")), "places")
            found = stored(repeats_of(sorted_runs(packed(long).join(each, "hash"), gram, length, bounds, parts), gram, length), "repeats")
            out = found if out is None else out.union(found)
        if not counts.get(True):
            break
        crowds = rows.where("crowded").groupBy("hash").agg(F.collect_set(F.struct("lo", "hi")).alias("open"))
        now = long.select(F.xxhash64("text").alias("hash"), "text").join(crowds, "hash")
    if out is None:
        out = documents.sparkSession.createDataFrame([], "key binary, lo int, hi int")
    return stored(out.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")


def removed_runs(ranges: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows cover."""
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + length) for r in ranges or []):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
        else:
            runs.append((lo, hi))
    return runs


def without_repeats(documents: DataFrame, length: int = LENGTH, crowd: int = CROWD, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: removed runs of bytes (start, end) and what is left; digest: the
    number of removed bytes and runs and the SHA-256 of what is left, in place of them."""
    own = packed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    rows = own.join(repeats(documents, length, crowd), "key", "left").select("doc_id", "text", "size", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "n_bytes", "removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in unpacked(batches):
            texts = b.column("text").to_pylist()
            runs = [removed_runs(r, length) for r in b.column("ranges").to_pylist()]
            kept = [b"".join([t[a:z] for a, z in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(t)])]) for t, r in zip(texts, runs)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            if digest:
                more = [pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            else:
                more = [pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, *more], names)

    return mapped(rows, run, "doc_id long, n_bytes long, " + ("n_removed long, n_spans long, kept_sha256 string" if digest else "removed array<struct<start: long, end: long>>, kept binary"))
