"""Language ID: multinomial naive Bayes over hashed character n-grams.

``fit`` counts the labelled rows of every language, then the n-grams of a bounded sample of them
(``SAMPLE_ROWS``, of which each language has an equal share, so rare ones are learned, too), per language and
bucket, and makes a matrix of log probabilities whose size is set by the buckets and the number of languages
(the ``MOST_LANGUAGES`` most frequent); the matrix is broadcast. ``predict`` scores Arrow batches in numpy: the n-grams of a chunk of texts are
hashed at once and each language's log probabilities are gathered and summed per text. Nothing is shuffled.

Texts are lower-cased, runs of other characters than letters become one boundary. Every whole text is read.

Edge cases: null texts and texts without letters are ``und`` with score 0, and so is every text if no
labelled text was given; ties go to the first language in order; repeated rows each get a row; extra
columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

#: Labelled rows that are counted, about; chosen by a hash of the row.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 15
GRAMS = 3
CHUNK = 1 << 18
MOST_LANGUAGES = 1000
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    priors: np.ndarray
    #: languages x buckets
    logs: np.ndarray


class _Letters:
    """Which code points are letters, filled by pages of 256 as they are met."""

    def __init__(self):
        self.known = np.zeros(0x1100, bool)
        self.letter = np.zeros(0x110000, bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        for page in np.nonzero(np.bincount(codes >> 8, minlength=0x1100).astype(bool) & ~self.known)[0]:
            self.letter[page << 8 : (page + 1) << 8] = [chr(c).isalpha() for c in range(page << 8, (page + 1) << 8)]
            self.known[page] = True
        return self.letter[codes]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def hashed_grams(texts: list[str], letters: _Letters) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Where each text's n-grams begin, the buckets of the n-grams of each size, and each text's number of letters."""
    pad = " " * (GRAMS - 1)
    joined = "".join(pad + t.lower() for t in texts) + pad
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(pad) + len(t.lower()) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letter = letters(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of other characters after a letter
    edge = (starts[:, None] + np.arange(GRAMS - 1)).ravel()
    keep[edge] = True
    keep[-len(pad) :] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    count = np.concatenate([[0], np.cumsum(letter)])
    ends = np.append(starts[1:], len(codes) - len(pad))
    codes = np.where(letter, codes, 32)[keep].astype(np.uint32)
    n, mixed, out = len(codes) - len(pad), np.zeros(len(codes) - len(pad), np.uint32), []
    for k in range(GRAMS):
        mixed = (mixed ^ codes[k : k + n]) * np.uint32(2654435761) + np.uint32(k + 1)
        out.append((mixed ^ mixed >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return at[starts], out, count[ends] - count[starts]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows (doc_id, text, lang) with both; of about sample_rows of them the n-grams are counted."""
    labelled = labelled.where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not totals:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    share = -(-sample_rows // len(totals))
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, share / n)) for k, n in totals.items()], "lang string, part double")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("part") * 1_000_000
    labelled = labelled.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, letters = defaultdict(lambda: np.zeros(BUCKETS, np.int64)), _Letters()
        for batch in slices(batches):
            by = defaultdict(list)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[lang].append(text)
            for lang, texts in by.items():
                for a, b in _chunks(texts):
                    for h in hashed_grams(texts[a:b], letters)[1]:
                        found[lang] += np.bincount(h, minlength=BUCKETS)
        for lang, n in found.items():
            (where,) = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where.astype(np.int32)), pa.array(n[where])], ["lang", "bucket", "n"])

    counts = mapped(labelled.select("text", "lang"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()  # at most languages x buckets
    languages = sorted(totals)
    place = {lang: i for i, lang in enumerate(languages)}
    matrix = np.full((len(languages), BUCKETS), 0.5)
    np.add.at(matrix, (np.array([place[x] for x in rows["lang"].to_pylist()], np.int64), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    docs = np.array([totals[x] for x in languages], float)
    return Model(languages, np.log(docs / docs.sum()), np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32))


def score(model: Model, texts: list[str | None], letters: _Letters) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior probability."""
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    whole = [t or "" for t in texts]
    for a, b in _chunks(whole) if model.languages else ():
        starts, grams, n_letters = hashed_grams(whole[a:b], letters)
        sums = np.empty((len(model.languages), b - a))
        for k, logs in enumerate(model.logs):
            part = logs[grams[0]].astype(np.float64)
            for h in grams[1:]:
                part += logs[h]
            sums[k] = np.add.reduceat(part, starts) + model.priors[k]
        top = sums.argmax(axis=0)
        posterior = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
        for i in np.nonzero(n_letters)[0].tolist():
            names[a + i], best[a + i] = model.languages[top[i]], posterior[i]
    return names, best


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))  # plain values: workers need no copy of this package

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = _Letters(), Model(*shared.value)
        for batch in slices(batches):
            names, best = score(model, batch.column(1).to_pylist(), letters)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), label, "doc_id long, lang_pred string, score double")


def keep_known(documents: DataFrame, model: Model) -> DataFrame:
    """documents, with their columns, whose language is known."""
    shared, at = documents.sparkSession.sparkContext.broadcast(tuple(model)), documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = _Letters(), Model(*shared.value)
        for batch in slices(batches):
            names, _ = score(model, batch.column(at).to_pylist(), letters)
            yield batch.filter(pa.array([x != UNKNOWN for x in names], pa.bool_()))

    return mapped(documents, keep, documents.schema)


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor
