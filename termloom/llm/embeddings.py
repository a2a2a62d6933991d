"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are collapsed into one with a multiplicity before anything is compared. In each
pass vectors get a code of 64 random hyperplanes' signs and are ordered by (label, dimension, code, hash of
the id). The order is cut at sampled quantiles into blocks of bounded size; inside a block every vector is
compared with its ``WINDOW`` successors by exact cosine in double precision, and the ends of neighbouring
blocks are compared in a second, small step, so block borders lose nothing. Verified pairs of all passes are
united into components by a spanning forest of each block's links. ``passes_for`` gives the number of passes
that finds a pair at the threshold with probability ``RECALL`` for the largest label, if hyperplanes halve it.

The passes only find the components. An exact check follows: every label is closed by all its pairs, whatever its size,
which counts links and ties components that no pass brought together, so crowded labels lose nothing. A caller may bound
it (``exact_rows``): in labels of more distinct vectors only the pairs of a component are compared then.
Both are cut into tiles of two blocks of ``BLOCK_ROWS``, which run apart.

Per pass each vector crosses one shuffle and makes at most 2 x WINDOW comparisons; a label that holds most
rows is cut into blocks as any other. The check is quadratic in a label's or component's distinct vectors and
ships each of them once for every block of it.

Edge cases: null labels, null, empty or zero vectors, and vectors with null or non-finite components link
with nothing; vectors of different dimension are never compared; repeated rows are linked copies and each
get a row; a null vec_id is never the least; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_partitions, stored
from .components import connected_components

COSINE = 0.98
WINDOW = 256
BITS = 64
RECALL = 0.999
BLOCK_ROWS = 4096
MOST_BLOCKS = 20_000
SAMPLE = 20


def usable(vector: str, label: str):
    """Whether a vector may link at all."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def passes_for(largest: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes needed for a label of so many vectors: a pair is met if it agrees in the bits that isolate a window."""
    agree = (1 - math.acos(cosine) / math.pi) ** max(1.0, math.log2(max(1, largest) / window + 1))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def unit(raw: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, kind).astype(np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def vectors(embeddings: DataFrame) -> DataFrame:
    """(id, label, dim, n, least, x): distinct usable vectors, n copies each; x their bytes."""
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    rows = embeddings.where(usable("embedding", "label")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v + F.lit(0).cast("float" if kind == "<f4" else "double")).alias("x"))  # adding 0 makes -0 equal 0
    groups = rows.groupBy("label", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(v, kind) for v in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([len(v) for v in x], pa.int32()), b.column("n"), b.column("least"), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "label", "dim", "n", "least", "x"])

    kept = stored(groups, "vectors")
    kept = stored(kept.withColumn("id", F.monotonically_increasing_id()), "vectors")
    return kept.mapInArrow(pack, "id long, label string, dim int, n long, least long, x binary")


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([number, dim]).standard_normal((dim, BITS))


def codes(x: np.ndarray, number: int) -> np.ndarray:
    """The code of each row in one pass: its hyperplanes' signs, the first one highest."""
    return np.packbits(x @ _planes(x.shape[1], number) > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64) ^ np.int64(-(1 << 63))


def coded(table: DataFrame, passes: int, kind: str) -> DataFrame:
    """table with codes (array, one for each pass) and h, a hash of the id that parts equal codes."""

    def run(batches):
        for b in batches:
            dims, raw = b.column("dim").to_numpy(), b.column("x").to_pylist()
            out = np.zeros((len(raw), passes), np.int64)
            for dim in np.unique(dims):
                (at,) = np.nonzero(dims == dim)
                x = np.array([unit(raw[i], kind) for i in at])
                for p in range(passes):
                    out[at, p] = codes(x, p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], [*b.schema.names, "codes"])

    hashed = table.withColumn("h", F.xxhash64("id"))
    return hashed.mapInArrow(run, "id long, label string, dim int, n long, least long, x binary, h long, codes array<long>")


def _links(x, labels, ids, counts, window, first=None):
    """(row, linked rows) pairs among neighbours in order; first: only pairs across that border."""
    n, near = len(ids), [[] for _ in ids]
    for a in range(0, n if first is None else first, 512):
        b = min(a + 512, n if first is None else first)
        lo = a if first is None else first
        hi = min(n, b + window)
        if lo >= hi:
            continue
        s = x[a:b] @ x[lo:hi].T
        i, j = np.nonzero(s >= COSINE)
        i, j = i + a, j + lo
        ok = (j > i) & (j - i <= window) & (labels[i] == labels[j])
        for u, v in zip(i[ok].tolist(), j[ok].tolist()):
            near[u].append(v)
            near[v].append(u)
    return near


def _forest(near) -> list[list[int]]:
    """For each row, the rows it is tied to in a spanning forest of the links."""
    parent = list(range(len(near)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ties = [[] for _ in near]
    for u, vs in enumerate(near):
        for v in vs:
            if v > u and (a := root(u)) != (b := root(v)):
                parent[max(a, b)] = min(a, b)
                ties[u].append(v)
    return ties


def _found(near, ids) -> list[pa.Array]:
    ties = _forest(near)
    rows = [u for u, vs in enumerate(ties) if vs]
    return [pa.array([ids[u] for u in rows], pa.int64()), pa.array([[ids[v] for v in ties[u]] for u in rows], pa.list_(pa.int64()))]


def compared(table: DataFrame, passes: int, kind: str, window: int, block_rows: int) -> DataFrame:
    """(id, ties) found in any pass, several rows for an id."""
    spark = table.sparkSession
    total = table.count()
    blocks = min(MOST_BLOCKS, -(-total // block_rows))
    bounds: list[list[tuple]] = [[] for _ in range(passes)]
    if blocks > 1:
        sample = table.select("label", "dim", "codes", "h").sample(min(1.0, SAMPLE * blocks / total), seed=1).collect()
        for p in range(passes):
            keys = sorted((r["label"], r["dim"], r["codes"][p], r["h"]) for r in sample)
            bounds[p] = [keys[i * len(keys) // blocks] for i in range(1, blocks)] if keys else []
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches):
        for b in batches:
            labels, dims, hs = (b.column(c).to_pylist() for c in ("label", "dim", "h"))
            all_codes = np.array(b.column("codes").to_pylist(), np.int64).reshape(-1, passes)
            for p in range(passes):
                code = all_codes[:, p]
                block = [bisect.bisect_right(shared.value[p], k) for k in zip(labels, dims, code.tolist(), hs)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(block), pa.int32()), pa.array(block, pa.int32()), b.column("label"), b.column("dim"), pa.array(code), b.column("h"), b.column("id"), b.column("n"), b.column("x")], ["pass", "block", "label", "dim", "code", "h", "id", "n", "x"])

    dealt = table.select("id", "label", "dim", "n", "x", "h", "codes").mapInArrow(deal, "pass int, block int, label string, dim int, code long, h long, id long, n long, x binary")
    rows = dealt.repartition(shuffle_partitions(spark), "pass", "block").sortWithinPartitions("pass", "block", "label", "dim", "code", "h", "id")
    names = ["id", "ties", "pass", "border", "at", "label", "dim", "n", "x"]
    schema = "id long, ties array<long>, pass int, border int, at int, label string, dim int, n long, x binary"
    arrow = pa.schema([("id", pa.int64()), ("ties", pa.list_(pa.int64())), ("pass", pa.int32()), ("border", pa.int32()), ("at", pa.int32()), ("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("x", pa.binary())])

    def near_of(rows, first=None):
        """Links of rows (label, dim, id, n, x) in order, dimension by dimension."""
        labels = np.array([r[0] for r in rows], object)
        near = [[] for _ in rows]
        dims = np.array([r[1] for r in rows])
        for dim in np.unique(dims):  # of one label and dimension rows stand together
            (at,) = np.nonzero(dims == dim)
            x = np.array([unit(rows[i][4], kind) for i in at])
            cross = None if first is None else int(np.searchsorted(at, first))
            for u, vs in enumerate(_links(x, labels[at], at, None, window, cross)):
                near[at[u]] = [int(at[v]) for v in vs]
        return _found(near, [r[2] for r in rows])

    def inside(batches):
        def finish(key, rows):
            found = near_of(rows)
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(n, arrow.field(c).type) for c in names[2:])], schema=arrow)
            ends = [(key[1], i - len(rows), r) for i, r in enumerate(rows) if i >= len(rows) - window] + [(key[1] - 1, i, r) for i, r in enumerate(rows[:window])]
            yield pa.RecordBatch.from_pylist([{"id": r[2], "pass": key[0], "border": k, "at": i, "label": r[0], "dim": r[1], "n": r[3], "x": r[4]} for k, i, r in ends if 0 <= k < len(shared.value[key[0]])], arrow)

        key, rows = None, []
        for b in batches:
            for p, block, *r in zip(*(b.column(c).to_pylist() for c in ("pass", "block", "label", "dim", "id", "n", "x"))):
                if key != (p, block):
                    if rows:
                        yield from finish(key, rows)
                    key, rows = (p, block), []
                rows.append(tuple(r))
        if rows:
            yield from finish(key, rows)

    def across(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("at", "label", "dim", "id", "n", "x"))), key=lambda r: r[0])
        found = near_of([r[1:] for r in rows], sum(r[0] < 0 for r in rows))
        return pa.Table.from_arrays(found, ["id", "ties"])

    first = stored(rows.mapInArrow(inside, schema), "windows")
    borders = first.where("border is not null").select("pass", "border", "at", "label", "dim", "id", "n", "x")
    second = borders.groupBy("pass", "border").applyInArrow(across, "id long, ties array<long>")
    return first.where("border is null").select("id", "ties").union(second)


def counted(members: DataFrame, kind: str, block_rows: int) -> DataFrame:
    """(id, others, tie) of members (place, component, id, n, x), by all pairs of those of one place: how many rows a vector is
    linked with there, in parts, and rows (component, null, tie) of components that are linked there."""
    large = members.groupBy("place").agg(F.count("*").alias("size")).where(F.col("size") > block_rows)
    blocks = F.coalesce(F.ceil(F.col("size") / block_rows), F.lit(1)).cast("int")
    rows = members.join(large, "place", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a tile for every two blocks, and for a block with itself
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "id", "n", "x")
    rows = rows.repartition(shuffle_partitions(members.sparkSession), "place", "i", "j").sortWithinPartitions("place", "i", "j", "block")

    def tile(i, j, rows):
        n, ids, parts = (np.array([r[c] for r in rows], np.int64) for c in (1, 0, 4))
        dims = np.array([len(r[2]) for r in rows])
        others, second = np.zeros(len(rows), np.int64), np.array([r[3] == j and i != j for r in rows])
        parent: dict[int, int] = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        ties = []
        for dim in np.unique(dims):  # vectors of other lengths are never compared
            left = np.flatnonzero((dims == dim) & ~second)
            right = np.flatnonzero((dims == dim) & second) if i != j else left
            x = {k: unit(rows[k][2], kind) for k in {*left.tolist(), *right.tolist()}}
            if not len(left) or not len(right):
                continue
            y = np.array([x[k] for k in right.tolist()])
            for a in range(0, len(left), 512):
                at = left[a : a + 512]
                near = np.array([x[k] for k in at.tolist()]) @ y.T >= COSINE
                if i == j:
                    near[np.arange(len(at)), np.arange(a, a + len(at))] = False  # a vector with itself
                else:
                    others[right] += n[at] @ near
                others[at] += near @ n[right]
                p, q = np.nonzero(near & (parts[at][:, None] != parts[right][None, :]))
                for u, v in np.unique(np.sort(np.column_stack([parts[at][p], parts[right][q]]), axis=1), axis=0).tolist():
                    if (u0 := root(u)) != (v0 := root(v)):
                        parent[max(u0, v0)] = min(u0, v0)
                        ties.append((u, v))
        k = len(ties)
        return pa.RecordBatch.from_arrays(
            [pa.array([*ids.tolist(), *(t[0] for t in ties)], pa.int64()), pa.array([*others.tolist(), *[None] * k], pa.int64()), pa.array([*[None] * len(rows), *(t[1] for t in ties)], pa.int64())], ["id", "others", "tie"]
        )

    def run(batches):
        key, rows = None, []
        for b in batches:
            for place, i, j, *r in zip(*(b.column(c).to_pylist() for c in ("place", "i", "j", "id", "n", "x", "block", "component"))):
                if key != (place, i, j):
                    if rows:
                        yield tile(*key[1:], rows)
                    key, rows = (place, i, j), []
                rows.append(r)
        if rows:
            yield tile(*key[1:], rows)

    return rows.mapInArrow(run, "id long, others long, tie long")


def near_duplicates(embeddings: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS, passes: int | None = None, exact_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; exact_rows: distinct vectors of a label all of whose pairs are compared (all of them if null)."""
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    table = vectors(embeddings)
    if passes is None:
        passes = passes_for(table.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, window)
    table = stored(coded(table, passes, kind), "codes")
    found = stored(compared(table, passes, kind, window, block_rows), "links")
    parts = cut(connected_components(found.select(F.col("id").alias("u"), F.explode("ties").alias("v"))))
    # labels are closed by all their pairs; beyond a bound of the caller's, all pairs of a component
    closed = table.withColumn("closed", F.lit(True))
    if exact_rows is not None:
        sizes = table.groupBy("label").agg((F.count("*") <= exact_rows).alias("closed"))
        closed = table.join(sizes, "label")
    members = closed.join(parts, "id", "left").where("closed or component is not null")
    own = F.coalesce("component", "id")
    place = F.when(F.col("closed"), F.concat(F.lit("l"), "label")).otherwise(F.concat(F.lit("c"), own.cast("string")))
    counts = stored(counted(members.select(place.alias("place"), own.alias("component"), "id", "n", "x"), kind, block_rows), "counts")
    links = counts.where("others is not null").groupBy("id").agg(F.sum("others").alias("others"))
    both = parts.select("id", "component").union(counts.where("tie is not null").select(F.col("id").alias("id"), F.col("tie").alias("component")))
    parts = cut(connected_components(both.select(F.col("id").alias("u"), F.col("component").alias("v"))))
    least = parts.join(table.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"))
    facts = (
        table.select("id", "label", "x", "n", "least")
        .join(links, "id", "left")
        .join(parts.join(least, "component").select("id", "component_id"), "id", "left")
        .select("label", "x", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )

    zero = F.lit(0).cast("float" if kind == "<f4" else "double")
    plain = F.transform("embedding", lambda v: v + zero)

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if v is None else np.array(v, kind).tobytes() for v in b.column(2).to_pylist()], pa.binary())], ["vec_id", "label", "x"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(usable("embedding", "label"), plain).alias("x"))
    rows = rows.mapInArrow(pack, "vec_id long, label string, x binary")
    own = F.col("vec_id")
    component = F.when(F.col("n_links").isNull(), own).otherwise(F.col("component_id"))
    return rows.join(facts, ["label", "x"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))
