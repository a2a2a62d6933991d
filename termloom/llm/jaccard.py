"""N-gram Jaccard join through parity sketches.

A document is the set of its 5-word shingles, as 64-bit hashes. Equal sets are one class. For sets of
sizes a <= b a Jaccard similarity of 0.8 needs b <= 1.25 a and a symmetric difference of at most (a + b) / 9.

*Sketch.* In each size band, tokens are dealt by hash into k buckets and each bucket XORs its tokens'
hashes. A token in one set only changes one bucket, so the number of differing buckets bounds the symmetric
difference from below; with k above the largest difference d of the band, two similar sets agree in at
least k - d buckets (pigeonhole). Empty buckets carry nothing: a set with e empty ones still shares
k - d - e full ones with any similar set. A set for which that is not positive ("poor") is dealt again with
further seeds until it is rich; two similar sets meet under the first seed under which either is rich.

*Candidates.* Signatures that only one class has are dropped after one sort. Of the others a class keeps
its rarest, at most d + 1 less its number of unique ones (the prefix filter: anything else it shares is not
needed to meet a similar class), which also removes passages and lines that many documents share.

*Verification.* In a few rounds (``LEADERS``) each class of a signature's group is compared with one leader of
the group, so large groups of near copies cost a comparison or a few for each member, and verified links are
contracted. Then all pairs of a group that are still in different components are compared. Pairs must be
allowed by their sizes and 512-bit parity sketches; all steps compare exact shingle sets. Links within a component that contraction makes superfluous are not
listed: the result is components, not all pairs.

Class ids and shingles are 64-bit hashes: among N sets, N^2 / 2^65 clashes are expected.

Edge cases: null or empty text has no shingles and is linked with nothing; repeated rows each get a row; a
null doc_id is never the least; extra columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped, shuffle_partitions, slices, stored, text_key
from .components import connected_components
from .words import M1, M2, chunks, mix, words_of

WORDS = 5
#: Similarity: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A band's sets are up to so many times its least size (and partners beyond it).
RATIO = 1.8
#: Buckets for each difference that has to be survived.
SLACK = 1.2
#: From this many classes on, signatures count as equally frequent.
FREQUENT = 64
#: Rows (two longs) that may be broadcast to find the candidates' texts.
BROADCAST_ROWS = 1_000_000
SEEN = 1_000_000
SKETCH = 512
#: Rows of a signature's group that are compared in one tile with as many others.
TILE_ROWS = 512
#: Orders of leaders in each round before all pairs that are left.
LEADERS = (1, 4, 16)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its 5-word sequences; of the whole sequence if it is shorter."""
    for _, part in chunks(texts):
        w = words_of(part)  # A-Z in lower case, ASCII white space
        total = len(w.hash)
        padded = np.concatenate([w.hash, np.zeros(WORDS, np.uint64)])
        whole = np.full(total, WORDS, np.uint64)
        for j in range(WORDS):
            whole = whole * M1 + padded[j : j + total]
        whole = mix(whole)
        at = 0
        for n in np.bincount(w.owner, minlength=len(part)).tolist():
            if n >= WORDS:
                yield np.unique(whole[at : at + n - WORDS + 1])
            elif n:
                short = np.full(1, n, np.uint64)
                for x in w.hash[at : at + n]:
                    short = short * M1 + x
                yield mix(short)
            else:
                yield np.empty(0, np.uint64)
            at += n


def _bands() -> tuple[tuple[int, int, int], ...]:
    out, low = [], 4
    while low < 1 << 31:
        high = max(low + 1, int(low * RATIO))
        last = high - 1
        out.append((low, high, (last + last * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)))
        low = high
    return tuple(out)


#: (least size, next band's least size, d) for sizes up to 2^31. A plain value: cached functions do not travel to workers.
BANDS = _bands()


def deals(h: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band and seed, d, least number of shared full buckets, signatures of the full buckets) of a set."""
    n = len(h)
    for j, (low, high, d) in enumerate(BANDS):
        if not d or not low <= n <= (high - 1) * 100 // PERCENT:
            continue
        k = max(d + 2, int(d * SLACK) + 1)
        own = min(d, n * (100 - PERCENT) // PERCENT)
        for seed in range(1 << 30):
            x = h if not seed else np.sort(mix(h + np.uint64(seed * int(M2) % (1 << 64))))
            # x is sorted and uniform: its upper bits deal it into buckets that are runs
            bucket = ((x >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            starts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1])
            parity = np.bitwise_xor.reduceat(mix(x ^ M2), starts)
            code = (j << 3) | min(seed, 7)
            sig = mix(parity ^ mix(bucket[starts] * np.uint64(1 << 40) + np.uint64((j << 32) + seed)))
            yield code, own, k - own - (k - len(starts)), (sig & ~np.uint64(255)) | np.uint64(code)
            if k - own - (k - len(starts)) > 0:
                break


def class_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64))


def parity_sketch(h: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def document_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, id, deals): id is the class, null of an empty set; deals: (code, full buckets, d, shared at least)."""
    kind = pa.list_(pa.struct([("code", pa.int32()), ("full", pa.int32()), ("d", pa.int32()), ("least", pa.int32())]))

    def run(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(_texts(batch)))
            dealt = [[{"code": c, "full": len(s), "d": d, "least": t} for c, d, t, s in deals(h)] for h in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(h) for h in sets], pa.int64()), pa.array([class_id(h) if len(h) else None for h in sets], pa.int64()), pa.array(dealt, kind)],
                ["doc_id", "text_key", "n_shingles", "id", "deals"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return mapped(rows, run, "doc_id long, text_key long, n_shingles long, id long, deals array<struct<code:int,full:int,d:int,least:int>>")


def signatures(documents: DataFrame) -> DataFrame:
    """(sig, id) of every class; a class that a task has just seen is not repeated."""

    def run(batches):
        seen = set()
        for batch in slices(batches):
            sigs, ids = [], []
            for h in shingle_sets(_texts(batch)):
                if not len(h) or (c := class_id(h)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                for _, _, _, s in deals(h):
                    sigs.append(s.view(np.int64))
                    ids.append(np.full(len(s), c, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "id"])

    return mapped(documents.select("text"), run, "sig long, id long")


def shared_signatures(sigs: DataFrame) -> DataFrame:
    """(sig, id, df): distinct rows whose signature several classes have; df counts them, up to FREQUENT."""

    def run(batches):
        sig, ids, hot = np.empty(0, np.int64), np.empty(0, np.int64), None  # what may still grow; the signature found frequent

        def groups(sig, ids):
            """Whole groups, sorted: those of several rows."""
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            starts = np.nonzero(new)[0]
            size = np.diff(np.append(starts, len(sig)))
            df = np.repeat(size, size)
            keep = df > 1
            return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(ids[keep]), pa.array(np.minimum(df[keep], FREQUENT).astype(np.int32))], ["sig", "id", "df"])

        last = None
        for batch in batches:
            s, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(s):
                continue
            fresh = np.concatenate([[last != (s[0], i[0])], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
            last = (s[-1], i[-1])
            sig, ids = np.concatenate([sig, s[fresh]]), np.concatenate([ids, i[fresh]])
            if hot is not None and len(sig):  # the rest of a group whose first rows are out
                n = int(np.searchsorted(sig, hot, "right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(sig[:n]), pa.array(ids[:n]), pa.array(np.full(n, FREQUENT, np.int32))], ["sig", "id", "df"])
                    sig, ids = sig[n:], ids[n:]
                if len(sig):
                    hot = None
            if not len(sig):
                continue
            at = int(np.searchsorted(sig, sig[-1], "left"))  # the last group is not known to be whole
            if at:
                yield groups(sig[:at], ids[:at])
                sig, ids = sig[at:], ids[at:]
            if len(sig) >= FREQUENT:
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids), pa.array(np.full(len(sig), FREQUENT, np.int32))], ["sig", "id", "df"])
                hot, sig, ids = sig[-1], sig[:0], ids[:0]
        if len(sig):
            yield groups(sig, ids)

    n = shuffle_partitions(sigs.sparkSession)
    return sigs.repartition(n, "sig").sortWithinPartitions("sig", "id").mapInArrow(run, "sig long, id long, df int")


def candidate_rows(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, id) that pass the prefix filter and whose signature several classes keep."""
    rules = classes.select("id", F.explode("deals").alias("x")).select("id", "x.*")
    of = Window.partitionBy("id", "code")
    rows = (
        shared.withColumn("code", F.col("sig").bitwiseAND(255).cast("int"))
        .withColumn("have", F.count("*").over(of))
        .withColumn("rank", F.row_number().over(of.orderBy("df", "sig")))
        .join(rules, ["id", "code"])
        .where("have >= least and rank <= d + 1 - (full - have)")
        .select("sig", "id")
    )
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1").select("sig", "id")


def class_shingles(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, p, h) of the wanted classes (id, doc_id, text_key): sketch words p and all hashes h."""

    def run(batches):
        for batch in slices(batches):
            sets = list(shingle_sets(_texts(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([parity_sketch(h).tolist() for h in sets], pa.list_(pa.int64())), pa.array([h.tobytes() for h in sets], pa.binary())],
                ["id", "n", "p", "h"],
            )

    small = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnRenamed("doc_id", "w_doc").withColumnRenamed("text_key", "w_key")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    on = docs.doc_id.eqNullSafe(wanted.w_doc) & (docs.text_key == wanted.w_key)
    rows = docs.join(F.broadcast(wanted) if small else wanted, on).select("id", "text")
    return mapped(rows, run, "id long, n long, p array<long>, h binary").dropDuplicates(["id"])


def _allowed(a: str, b: str) -> str:
    """Whether sizes and sketches of two classes leave them the chance to be similar."""
    differ = " + ".join(f"bit_count({a}.p[{i}] ^ {b}.p[{i}])" for i in range(SKETCH // 64))
    return f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and {100 + PERCENT} * ({differ}) <= {100 - PERCENT} * ({a}.n + {b}.n)"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of pairs whose shingle sets are similar."""

    def run(batches):
        for batch in batches:
            ok, last, x = [], None, None
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("a"), batch.column("b")):
                if u != last:
                    last, x = u, np.frombuffer(a.as_buffer(), np.uint64)
                ok.append(similar(x, np.frombuffer(b.as_buffer(), np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    one, other = sets.select(F.col("id").alias("u"), F.col("h").alias("a")), sets.select(F.col("id").alias("v"), F.col("h").alias("b"))
    return mapped(pairs.join(other, "v").join(one, "u").select("u", "v", "a", "b"), run, "u long, v long")


def class_components(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of every class that is linked with another; component is the least such class id."""
    shared = stored(shared_signatures(signatures(documents)), "shared")
    rows = stored(candidate_rows(shared, classes), "candidates")
    wanted = rows.select("id").distinct().join(classes.select("id", "doc_id", "text_key"), "id")
    sets = stored(class_shingles(documents, cut(wanted)), "shingles")
    facts = sets.select("id", "n", "p")
    labelled = rows.withColumn("part", F.col("id"))
    for leaders in (*LEADERS, None):
        open_ = still_open(labelled)
        pairs = distinct_pairs(open_, facts) if leaders is None else star_pairs(open_, facts, leaders)
        links = cut(verified(pairs, sets))
        parts = links.join(labels(labelled, "u", "pu"), "u").join(labels(labelled, "v", "pv"), "v")
        merged = cut(connected_components(parts.select(F.col("pu").alias("u"), F.col("pv").alias("v")))).withColumnRenamed("id", "part")
        labelled = cut(labelled.join(merged, "part", "left").select("sig", "id", F.coalesce("component", "part").alias("part")))
    return labelled.select("id", F.col("part").alias("component")).distinct()


def labels(labelled: DataFrame, name: str, part: str) -> DataFrame:
    return labelled.select(F.col("id").alias(name), F.col("part").alias(part)).distinct()


def still_open(labelled: DataFrame) -> DataFrame:
    """Rows of the signatures whose classes are in several components."""
    group = Window.partitionBy("sig")
    return labelled.withColumn("lo", F.min("part").over(group)).withColumn("hi", F.max("part").over(group)).where("lo < hi").select("sig", "id", "part")


def star_pairs(open_: DataFrame, facts: DataFrame, leaders: int) -> DataFrame:
    """(u, v): each class with one leader of its signature's group, if they are apart; groups choose between so many orders of leaders."""
    rank = F.xxhash64("id", F.shiftrightunsigned("sig", 8) % leaders)
    group = Window.partitionBy("sig")
    rows = open_.withColumn("top", F.min(F.struct(rank.alias("rank"), "id", "part")).over(group)).where("part <> top.part")
    pairs = rows.select(F.least("id", "top.id").alias("u"), F.greatest("id", "top.id").alias("v")).distinct()
    a, b = facts.select(F.struct("n", "p").alias("x"), F.col("id").alias("u")), facts.select(F.struct("n", "p").alias("y"), F.col("id").alias("v"))
    return pairs.join(a, "u").join(b, "v").where(_allowed("x", "y")).select("u", "v")


def distinct_pairs(open_: DataFrame, facts: DataFrame) -> DataFrame:
    """(u, v): all pairs of a group that are still apart and may be similar. Large groups are cut into tiles of two blocks, which are joined apart."""
    rows = cut(open_.join(facts, "id"))
    large = rows.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") > TILE_ROWS)
    blocks = F.coalesce(F.ceil(F.col("size") / TILE_ROWS), F.lit(1)).cast("int")
    dealt = rows.join(large, "sig", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    x, y = dealt.alias("x"), dealt.alias("y")
    tile = "x.sig = y.sig and x.i = y.i and x.j = y.j and x.part <> y.part"
    # a tile of two blocks pairs one with the other, a block's own tile each two rows once
    once = "case when x.i = x.j then x.id < y.id else x.block = x.i and y.block = y.j end"
    return x.join(y, F.expr(f"{tile} and {once} and {_allowed('x', 'y')}")).select(F.least("x.id", "y.id").alias("u"), F.greatest("x.id", "y.id").alias("v")).distinct()


def components(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for every row."""
    sets = stored(document_sets(documents), "sets")
    # equal sets have equal deals; the row with the least id stands for its class
    classes = stored(sets.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "deals")).alias("x")).select("id", "x.doc_id", "x.text_key", "x.deals"), "classes")
    parts = cut(class_components(documents, classes))
    least = parts.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = parts.join(least, "component").select("id", F.col("least").alias("component_id"))
    labels = classes.select("id", F.col("doc_id").alias("own")).join(linked, "id", "left").select("id", F.coalesce("component_id", "own").alias("component_id"))
    return sets.join(labels, "id", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents, with their columns: of each component the row with the least doc_id, of its repeats one; of documents without shingles all."""
    found = cut(components(documents).where("n_shingles > 0").groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n")))
    order = Window.partitionBy("component_id").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    ranked = cut(found.withColumn("r", F.row_number().over(order)).where("r > 1 or n > 1").select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_key"), "r"))
    # decisions are few against documents; texts are only shuffled if they are not
    small = (lambda df: F.broadcast(df)) if ranked.count() <= BROADCAST_ROWS else (lambda df: df)
    on = documents["doc_id"].eqNullSafe(ranked["k_doc"]) & (text_key(documents["text"]) == ranked["k_key"])
    kept = documents.join(small(ranked), on, "left_anti")
    repeated = ranked.where("r = 1")
    if not repeated.isEmpty():
        rows = documents.join(small(repeated), on).select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), ranked["k_doc"], ranked["k_key"])
        kept = kept.union(rows.dropDuplicates(["k_doc", "k_key"]).select("row.*"))
    return kept
