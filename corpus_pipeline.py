"""Corpus preparation: a chain of stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept:

1. language: trains on the labelled texts it is given and drops texts in no known language;
2. near_duplicates: keeps one document of each group of near copies;
3. decontaminate: drops documents that hold benchmark passages by the contract's rule;
4. redact: replaces secrets in the texts;
5. pack: packs what is left into sequences.

Extra columns and repeated rows pass through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontamination, jaccard, language, packing, secrets
from termloom.llm.common import discard, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.fit(docs.where(language.remainder(F.col("doc_id"), 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("pack", pack),
]

#: No SQL: language ID and tokenization are beyond it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
