"""Batched model calls: distinct texts, bounded batches, halving on failure, a recovery pass, and the join back.

A provider is any object with ``translate(texts) -> texts``; it travels to the executors. Only the offline one is
built in; remote ones are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from .memory import first_of


class Provider(Protocol):
    """M01."""

    def translate(self, texts: list[str]) -> list[str]: ...


class Offline:
    """M02 as a provider: phrases first, longest first, then words; other words stay."""

    def __init__(self, phrases: dict[str, str], words: dict[str, str]):
        self.phrases = sorted(phrases.items(), key=lambda kv: (-len(kv[0]), kv[0]))
        self.words = words

    def translate(self, texts: list[str]) -> list[str]:
        out = []
        for text in texts:
            low = text.lower()
            for a, b in self.phrases:
                low = low.replace(a, b)
            done = " ".join(self.words.get(w, w) for w in low.split(" "))
            out.append(done[:1].upper() + done[1:])
        return out


def call(provider: Provider, texts: list[str], depth: int = 0) -> list[str | None]:
    """Answers in order; a failing batch is halved, a failing text has none."""
    try:
        answers = provider.translate(texts)
        if len(answers) == len(texts):
            return [a if a and a.strip() else None for a in answers]
    except Exception:  # any failure of a provider counts as no answer for the batch
        answers = []
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return call(provider, texts[:half], depth + 1) + call(provider, texts[half:], depth + 1)


def batches_of(texts: list[str], size: int, most_chars: int) -> Iterator[list[str]]:
    """ST09: at most so many texts and, from the second on, characters."""
    batch, chars = [], 0
    for t in texts:
        if batch and (len(batch) == size or chars + len(t) > most_chars):
            yield batch
            batch, chars = [], 0
        batch.append(t)
        chars += len(t)
    if batch:
        yield batch


def _answered(distinct: DataFrame, provider: Provider, size: int, most_chars: int) -> DataFrame:
    """distinct (key, source, target, origin) with answers as target where there is no origin yet; no answer leaves the target null."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in incoming:
            key, source, target, origin = b.columns
            targets, asked = target.to_pylist(), [i for i, o in enumerate(origin.to_pylist()) if o is None]
            texts = source.take(pa.array(asked, pa.int64())).to_pylist()
            for i, a in zip(asked, (a for part in batches_of(texts, size, most_chars) for a in call(provider, part))):
                targets[i] = a
            yield pa.RecordBatch.from_arrays([key, source, pa.array(targets, pa.string()), origin], b.schema.names)

    return distinct.mapInArrow(run, distinct.schema)


def translate(rows: DataFrame, text: str, provider: Provider, fallback: Provider | None = None, size: int = 25, most_chars: int = 4500) -> DataFrame:
    """DML11, M03, ST09: rows with target and origin (model, fallback or none); every distinct text is asked once, bad answers again of the fallback.

    Bad answers are asked again where they stand, and answers meet their rows by the texts' digests."""
    digest, none = F.unhex(F.md5(F.col(text))), F.lit(None).cast("string")
    distinct = rows.where(F.trim(text) != "").select(digest.alias("_key"), F.col(text).alias("source")).distinct()
    answers = _answered(distinct.select("_key", "source", none.alias("target"), none.alias("origin")), provider, size, most_chars)
    bad = F.coalesce(P.needs_recovery(F.col("source"), F.coalesce("target", F.lit(""))), F.lit(True))
    answers = answers.select("_key", "source", "target", F.when(~bad, "model").alias("origin"))
    if fallback is not None:
        answers = _answered(answers, fallback, size, most_chars)
        other = F.when(F.col("target").isNotNull(), "fallback").otherwise("none")
    else:
        other = F.lit("none")
        answers = answers.withColumn("target", F.when(F.col("origin").isNotNull(), F.col("target")))
    answers = answers.select("_key", "target", F.coalesce("origin", other).alias("origin"))
    return rows.withColumn("_key", digest).join(answers, "_key", "left").drop("_key")


def suggestions(candidates: DataFrame, term: str, glossary: DataFrame, domain: DataFrame, dictionary: DataFrame, most: int = 3) -> DataFrame:
    """For each term up to ``most`` distinct targets, by glossary, domain and dictionary (key, target) in that order; never ones with source letters."""
    keyed = candidates.withColumn("_k", T.word_key(F.col(term)))
    for name, table in (("_a", glossary), ("_b", domain), ("_c", dictionary)):
        targets = table.where(~P.has_marks(F.col("target"))).select(T.word_key(F.col("key")).alias("_k"), "target").distinct()
        one = first_of(targets, "_k", "target", most).groupBy("_k").agg(F.array_sort(F.collect_list("target")).alias(name))  # at most ``most``
        keyed = keyed.join(one, "_k", "left")
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(*(F.coalesce(c, none) for c in ("_a", "_b", "_c"))))
    return keyed.withColumn("suggestions", F.slice(found, 1, most)).drop("_k", "_a", "_b", "_c")
