"""The offline translator over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import offline

QUERIES, ORACLES = {}, {}

#: A small dictionary of the words that the tables' English lines hold most.
WORDS = [("the", "cái"), ("of", "của"), ("and", "và"), ("to", "đến"), ("in", "trong"), ("is", "là"), ("that", "rằng"), ("for", "cho"), ("it", "nó"), ("on", "trên"), ("with", "với"), ("by", "bởi"), ("are", "là / thì"), ("from", "từ"), ("test", "thử"), ("policy", "chính sách"), ("strict", "nghiêm ngặt")]
PHRASES = [(1, "in the", "trong các"), (2, "of the", "thuộc"), (3, "to be", "được")]


def approved(s, d):
    """The first two words of every benchmark item, which passages of documents hold, with the third as target."""
    words = F.split("text", r"\s+")
    return catalog.table(s, d, "benchmark").select(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))).alias("source_term"), F.get(words, F.lit(2)).alias("target_term"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("vi").alias("source_lang"), F.lit(1).alias("priority")).where("target_term is not null")


def lexicon(s, d):
    return offline.lexicon(approved(s, d), s.createDataFrame(PHRASES, "position int, en string, vi string"), s.createDataFrame(WORDS, "en string, vi string"))


QUERIES["m02_translation"] = lambda s, d: offline.translated(catalog.units(s, d), lexicon(s, d)).select("doc_id", "line_no", "translated", "from_english")
QUERIES["m02_to_english"] = lambda s, d: offline.translated(catalog.units(s, d), lexicon(s, d), source="vi").groupBy("from_english").agg(F.count("*").alias("n"), F.count_if(F.col("translated") != F.col("text")).alias("changed"))
