"""Secret scans through a trigram inverted index.

Each rule's regex is analysed into a Boolean query over trigrams that every match must hold
(``trigram_query``). Texts are indexed in shards, one per Arrow batch: postings of the trigrams that some
query names, as rows of a documents x trigrams bit matrix. Queries intersect and unite postings; only
candidates are verified by the regex. A rule without mandatory trigrams (plain hexadecimal runs) scans
every text. Shards are independent: nothing is shuffled, memory is bounded by a batch, and a lost task is
redone alone.

The contract's three kinds have no bounds. Two of the added formats have some in their patterns, as the formats do: a
private key's header names at most three words of at most 20 letters, and user name and password in an address are
at most 256 characters each.

Matches are leftmost and non-overlapping per rule; a match whose measured group is too short is dropped
after it was consumed. Offsets are code points, end exclusive.

Edge cases: null text is empty and has no spans; empty tables give empty results; repeated rows each get
a row; extra columns are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

SPANS = "array<struct<kind:string,start:long,end:long>>"
REDACTED = "[REDACTED]"


class Rule(NamedTuple):
    kind: str
    pattern: str
    flags: int = re.ASCII
    #: The group that is measured, and its least length.
    group: int = 0
    least: int = 0


BASE = ("assign", "access", "hex")
#: The contract's three kinds, then public formats of credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"),
    Rule("url", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s/:@]{1,256}:[^\s/@]{1,256}@"),
)

#: Strings that are followed at once, at most; a longer list counts as unknown.
_MOST = 64
#: Trigrams of texts are looked up in a table of so many bits before they are compared.
HASH_BITS = 16
#: Bytes of texts whose trigrams are looked up at once.
BLOCK = 1 << 18


def _slot(gram: np.ndarray) -> np.ndarray:
    return gram * np.uint32(0x9E3779B1) >> np.uint32(32 - HASH_BITS)


def _of_strings(strings) -> tuple | None:
    """A query that holds for any text with one of the strings; None: no constraint."""
    if any(len(s) < 3 for s in strings):
        return None
    return ("or", tuple(("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)))


def _both(parts) -> tuple | None:
    parts = tuple(p for p in parts if p is not None)
    return ("and", parts) if parts else None


def _either(parts) -> tuple | None:
    parts = tuple(parts)
    return None if any(p is None for p in parts) else ("or", parts)


def _item(op, arg) -> tuple[set | None, tuple | None]:
    """What one element of a parsed regex may be: all its strings if they are few, else None and a query."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "IN":
        chars = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, None
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        found = [_sequence(x) for x in arg[1]]
        strings = set().union(*(s or () for s, _ in found))
        if all(s is not None for s, _ in found) and len(strings) <= _MOST:
            return strings, None
        return None, _either(q if s is None else _of_strings(s) for s, q in found)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, None
        if low == 0:
            return None, None
        return None, query if strings is None else _of_strings(strings)
    return None, None


def _sequence(items) -> tuple[set | None, tuple | None]:
    run, queries, broken = {""}, [], False
    for op, arg in items:
        strings, query = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a, b in itertools.product(run, strings)}
            continue
        queries += [_of_strings(run), query]
        run, broken = strings if strings is not None else {""}, True
    if not broken:
        return run, None
    return None, _both([*queries, _of_strings(run)])


def trigram_query(pattern: str, flags: int = 0) -> tuple | None:
    """Over lower-cased trigrams: ("and"|"or", parts) nested, leaves are trigrams; None: all texts are candidates."""
    strings, query = _sequence(re._parser.parse(pattern, flags))
    return query if strings is None else _of_strings(strings)


def _leaves(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_leaves(x) for x in query[1]))


class Scanner:
    """Compiled rules with their queries; ``spans`` answers for a shard of texts."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        grams = sorted(g for g in set().union(*(_leaves(q) for _, _, q in self.rules)) if g.isascii())
        self.column = {g: i for i, g in enumerate(grams)}
        self.grams = np.array([int.from_bytes(g.encode()) for g in grams], np.uint32)
        self.maybe = np.zeros(1 << HASH_BITS, bool)
        self.maybe[_slot(self.grams)] = True

    def postings(self, texts: list[bytes]) -> np.ndarray:
        """A row of bits for each text, a column for each trigram of the queries."""
        bits = np.zeros((len(texts), len(self.column)), bool)
        ends = np.cumsum([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts).lower(), np.uint8)
        for at in range(0, max(0, len(raw) - 2) if len(self.grams) else 0, BLOCK):
            x = raw[at : at + BLOCK + 2].astype(np.uint32)
            gram = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
            where = np.flatnonzero(self.maybe[_slot(gram)])
            column = np.searchsorted(self.grams, gram[where]).clip(max=len(self.grams) - 1)
            real = self.grams[column] == gram[where]
            bits[np.searchsorted(ends, where[real] + at, "right"), column[real]] = True
        return bits

    def candidates(self, query, bits: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(len(bits), bool)
        if isinstance(query, str):
            return bits[:, self.column[query]] if query in self.column else np.ones(len(bits), bool)
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.candidates(x, bits) for x in query[1]])

    def spans(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Of each text, by start, then by the rules' order."""
        found: list[list] = [[] for _ in texts]
        bits, decoded = self.postings(texts), {}
        for order, (rule, regex, query) in enumerate(self.rules):
            plain = re.compile(rule.pattern.encode(), rule.flags) if query is None and rule.flags & re.ASCII and rule.pattern.isascii() else None
            for i in np.nonzero(self.candidates(query, bits))[0].tolist():
                if plain is not None and not plain.search(texts[i]):
                    continue
                if i not in decoded:
                    decoded[i] = texts[i].decode("utf-8", "replace")
                for m in regex.finditer(decoded[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), order, m.end()))
        return [[(self.rules[o][0].kind, s, e) for s, o, e in sorted(x)] for x in found]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def find_secrets(documents: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, spans): every secret of every whole text."""
    rules = tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scanner.spans(_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(narrow, scan, f"doc_id long, spans {SPANS}")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their hash, and all spans as a string."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact_text(text: str, spans) -> str:
    """text with each stretch of overlapping spans replaced."""
    out, done = [], 0
    for start, end in sorted((s, e) for _, s, e in spans):
        if start >= done or done == 0:
            out += [text[done:start], REDACTED]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, rules=RULES) -> DataFrame:
    """documents with every secret replaced, n_chars following; other columns and clean rows stay as they are."""
    rules, names = tuple(rules), documents.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices(batches):
            at = names.index("text")
            columns = list(batch.columns)
            raw = _bytes(columns[at])
            hit = {i: s for i, s in enumerate(scanner.spans(raw)) if s}
            if hit:
                texts = columns[at].to_pylist()
                lengths = columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
                for i, spans in hit.items():
                    texts[i] = redact_text(texts[i], spans)
                    if lengths:
                        lengths[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if lengths:
                    columns[names.index("n_chars")] = pa.array(lengths, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(documents, scan, documents.schema)
