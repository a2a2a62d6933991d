"""Cross-tokenizer alignment: the tokens of two tokenizers grouped between the byte offsets where both end.

Texts are cut where both tokenizers certainly begin a new token (a single space between other characters), so a
unit's tokens do not depend on what stands around it and are remembered. New units of many texts are tokenized and
their token ends, as offsets into all of them, are merged at once: binary searches along the diagonals of the merge
path cut the two lists into pieces of equal work, however the tokens or long units lie; each piece gives the overlaps
of A and B tokens whose ends it holds, and neighbouring pieces are stitched where an end that both share was parted.
Overlaps chain into groups. A text's groups are those of its units in order.

Linked id pairs are counted by document from stored rows, first by batch, then by pair. The counts go to the tasks by
broadcast while there are at most ``MOST_PAIRS`` of them, else the rows' pairs meet the counts in a shuffled join,
whose common pairs adaptive execution splits. The links of one group are counted by distinct ids, so a group of many
tokens costs no more than its distinct pairs.

Edge cases: null and empty texts, and texts whose tokens do not spell a space and the text (unknown characters, a
text with U+2581), have no tokens: zeros and ''; special tokens' strings are plain text; repeated rows count as
documents each; a null doc_id stays; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, stored

#: Ends that a piece of the merge holds.
PIECE = 1 << 15
#: Counted pairs that are broadcast, 17 bytes each.
MOST_PAIRS = 4_000_000
#: What a worker spends on remembered units, about, and the longest unit remembered.
CACHE_BYTES, LONGEST_UNIT = 112 << 20, 200
#: Links of a unit that are written one by one.
MOST_REPEATS = 4096
#: Text handled at once.
SLICE = 1 << 20
#: Pair keys are a * WIDTH + b.
WIDTH = 1 << 20
_PARTED = re.compile(r"(?<=[^ ]) (?=\S)")


def default_tokenizers() -> tuple[str, str, str]:
    """A's vocabulary, the same as ranks of byte strings, and B's model."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


# Merging -------------------------------------------------------------------------------------------------------------


def merge_path(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted lists passes every size-th diagonal: as many of a and of b go before it; of equal ends, a's goes first."""
    d = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) // 2
        before = a[middle] <= b[d[todo] - middle - 1]
        low[todo] = np.where(before, middle + 1, low[todo])
        high[todo] = np.where(before, high[todo], middle)
    return low, d - low


def piece(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, ...]:
    """(end, a's token, b's token, whether both end there) of the overlaps that end in one piece; i, j: its first tokens."""
    ends, times = np.unique(np.concatenate([a, b]), return_counts=True)
    return ends, i + np.searchsorted(a, ends), j + np.searchsorted(b, ends), times == 2


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, ...]:
    """(end, a's token, b's token, whether both end there) of all overlaps, in order; a and b: ends of tokens."""
    i, j = merge_path(a, b, size)
    found = [piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k]) for k in range(len(i) - 1)]
    for left, right in zip(found, found[1:]):
        if left[0][-1] == right[0][0]:  # an end of both that the border parts: the token of a is the one before
            right[1][0] -= 1
            right[3][0] = True
    kept = [slice(None, -1) if k + 1 < len(found) and f[0][-1] == found[k + 1][0][0] else slice(None) for k, f in enumerate(found)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([f[c][s] for f, s in zip(found, kept)]) for c in range(4))


def groups_of(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of a and of b."""
    _, i, j, both = overlaps(a, b, size)
    group = np.cumsum(both) - both
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    of_a[i], of_b[j] = group, group  # all overlaps of a token lie in one group
    return of_a, of_b


# Units ---------------------------------------------------------------------------------------------------------------


class Unit(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes  # int64; distinct in each group, or one for each link
    links: bytes | None  # of each pair, int64; None: one


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links): the distinct id pairs of each group and how many token pairs have them."""

    def distinct(group, ids):
        keys, n = np.unique(group * WIDTH + ids, return_counts=True)
        return keys // WIDTH, keys % WIDTH, n

    ga, a, na = distinct(group_a, a)
    gb, b, nb = distinct(group_b, b)
    first, last = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
    times = last - first
    i = np.repeat(np.arange(len(ga)), times)
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return ga[i], a[i] * WIDTH + b[j], na[i] * nb[j]


class Aligner(dict):
    """Aligned units by text: None for those that are not spelled by their tokens."""

    def __init__(self, vocabulary: str, ranks: str, model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        super().__init__()
        self.vocabulary, self.size = vocabulary, 0
        table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(ranks, "rb"))}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for x, i in table.items():
            self.a_bytes[i] = x
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]

        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))

    def a_ids(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except BaseException as e:  # the pattern's engine gives up on very long white space: an error of its own, not an Exception
            if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                raise
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.vocabulary)
            slow.encode_special_tokens = True
            return slow.encode(text, add_special_tokens=False).ids

    def learn(self, units: list[str]) -> dict[str, Unit | None]:
        """Aligns units, many at once."""
        out: dict[str, Unit | None] = {}
        good, ids_a, ids_b = [], [], []
        for unit, b in zip(units, self.b.encode(units, num_threads=1)):
            a, raw = self.a_ids(" " + unit), (" " + unit).encode()
            if b"".join([self.b_bytes[i] for i in b]) == raw == b"".join([self.a_bytes[i] for i in a]):
                good.append(unit)
                ids_a.append(a)
                ids_b.append(b)
            else:
                out[unit] = None
        if not good:
            return out
        na, nb = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, na), (ids_b, nb)))
        group_a, group_b = groups_of(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        n = int(group_a[-1]) + 1
        last_group = group_a[np.cumsum(na) - 1]  # a unit's end is an end of both
        cut_groups = np.append(0, last_group + 1)
        group, pair, links = linked(a, b, group_a, group_b)
        cut = np.searchsorted(group, cut_groups)
        total = np.add.reduceat(links, cut[:-1])
        # tokens of both in the order of the written groups, with what stands behind each
        first_a, first_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
        order = np.concatenate([np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + first_a[group_b + 1]])
        tokens, behind = np.empty(len(order), np.int64), np.full(len(order), ",", "U1")
        tokens[order] = np.concatenate([a, b])
        behind[order[first_a[1:] - 1]] = "|"
        behind[order[len(a) + first_b[1:] - 1]] = ";"
        written = [str(t) + c for t, c in zip(tokens.tolist(), behind.tolist())]
        ends = np.append(0, np.cumsum(na + nb)).tolist()
        counts = np.diff(cut_groups).tolist()
        cut, na, nb = cut.tolist(), na.tolist(), nb.tolist()
        for k, unit in enumerate(good):
            p, m = pair[cut[k] : cut[k + 1]], links[cut[k] : cut[k + 1]]
            if total[k] == len(p):  # as nearly always
                p, m = p.tobytes(), None
            elif total[k] <= MOST_REPEATS:
                p, m = np.repeat(p, m).tobytes(), None
            else:
                p, m = p.tobytes(), m.tobytes()
            out[unit] = Unit(na[k], nb[k], counts[k], "".join(written[ends[k] : ends[k + 1]])[:-1], p, m)
        return out

    def units(self, texts: list[list[str]]) -> dict[str, Unit | None]:
        """What is known of the units of some texts, once they are learned."""
        new = [u for u in set(chain.from_iterable(texts)) if u not in self]
        got = self.learn(new) if new else {}
        long = {u: v for u, v in got.items() if len(u) > LONGEST_UNIT}
        for u, v in got.items():
            if u not in long:
                self[u] = v
                self.size += 400 + len(u) + (len(v.groups) + len(v.pairs) if v else 0)
        return long

    def forget(self) -> None:
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0


# Documents -----------------------------------------------------------------------------------------------------------

_ROW = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, links array<long>"


def _text(units: list[Unit]) -> tuple:
    """Of one text: its numbers of tokens and groups, its groups, distinct pairs and links of each."""
    pairs = np.frombuffer(b"".join([u.pairs for u in units]), np.int64)
    if any(u.links for u in units):
        links = np.concatenate([np.frombuffer(u.links, np.int64) if u.links else np.ones(len(u.pairs) // 8, np.int64) for u in units])
        order = np.argsort(pairs, kind="stable")
        pairs, links = pairs[order], links[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        links = np.add.reduceat(links, first)
    else:
        pairs = np.sort(pairs)
        first = np.flatnonzero(np.append(len(pairs) > 0, pairs[1:] != pairs[:-1]))
        links = np.diff(np.append(first, len(pairs)))
    return sum([u.n_a for u in units]), sum([u.n_b for u in units]), sum([u.n_groups for u in units]), ";".join([u.groups for u in units]), pairs[first], links


def aligned(documents: DataFrame, tokenizers: tuple[str, str, str] | None = None, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, pairs, links) of every row; groups adds them as text, ``a1,a2|b1;a3|b2``."""
    paths = tokenizers or default_tokenizers()
    names = [c.split()[0] for c in _ROW.split(", ")] + ["groups"] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner(*paths)
        for b in slices(batches, size=SLICE):
            texts = [_PARTED.split(t) if t else [] for t in b.column("text").to_pylist()]
            known.forget()
            long = known.units(texts)
            rows = []
            for units in texts:
                found = [known[u] if u in known else long[u] for u in units]
                rows.append(_text([] if None in found else found))
            digests = [hashlib.sha256(r[3].encode()).hexdigest() if r[0] else "" for r in rows]
            arrays = [b.column("doc_id"), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array(digests), *(pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in (4, 5))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array([r[3] for r in rows])] * groups, names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, run, _ROW + ", groups string" * groups)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold each linked pair, and whether no pair of its A id has more."""

    def run(batches):
        for b in batches:
            pairs, n = np.unique(b.column("pairs").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    counts = mapped(rows.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = stored(counts, "pairs").withColumn("a", F.floor(F.col("pair") / WIDTH))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """rows of ``aligned`` with n_links, n_best and count_sum in place of their pairs."""
    spark, kept = rows.sparkSession, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    counts = stored(counts, "counts")
    if counts.count() > most_pairs:
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum("links").alias("n_links"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
        return rows.select("row", *kept).join(sums, "row", "left").select(*kept, *zero)
    table = counts.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "count", "best")))

    def run(batches):
        pair, count, best = shared.value
        for b in batches:
            lists = b.column("pairs")
            first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            at, links = np.searchsorted(pair, lists.flatten().to_numpy()), b.column("links").flatten().to_numpy()
            sums = [np.append(0, np.cumsum(x)) for x in (links, links * best[at], links * count[at])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(s[first[1:]] - s[first[:-1]]) for s in sums)], [*kept, "n_links", "n_best", "count_sum"])

    return mapped(rows.drop("row"), run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")


def summary(documents: DataFrame, tokenizers: tuple[str, str, str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    rows = stored(aligned(documents, tokenizers).withColumn("row", F.monotonically_increasing_id()), "aligned")
    return with_counts(rows, pair_counts(rows), most_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
