"""Queries of terms that the glossary lacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import harvest as H

QUERIES, ORACLES = {}, {}

#: A map of domain terms: some that the tables' lines hold, some of the trade.
DOMAIN = [
    (0, "hở keo", H.DEFECT, ["Bond gap", "Delamination / Open glue", "Unbonded seam"]), (1, "lăn keo", H.PROCESS, ["Roll cementing", "Roller glue application", "Roll-coating cement"]), (2, "dập gân", H.PROCESS, ["Rib debossing", "Rib embossing"]),
    (3, "für", "Bộ vị (Component)", ["For", "Fort"]), (4, "élle", "Bộ vị (Component)", ["Elle"]), (5, "of the", H.GENERAL, ["Of this", "Of that", "Of them"]),
]
DICTIONARY = [(0, "heel", "gót"), (1, "tip", "mũi"), (2, "the of", "und")]


def domain(s):
    return s.createDataFrame(DOMAIN, "position int, term string, category string, options array<string>")


def dictionary(s):
    return s.createDataFrame(DICTIONARY, "position int, en string, vi string")


def glossary(s, d):
    """Terms, and the first words of every third benchmark item as if they were approved."""
    words = F.split(F.lower("text"), r"\s+")
    more = catalog.table(s, d, "benchmark").where("item_id % 3 = 0").select((F.col("item_id") + 1_000_000).alias("id"), F.get(words, F.lit(0)).alias("source_term"), F.get(words, F.lit(1)).alias("target_term"))
    return catalog.terms(s, d).select("id", "source_term", "target_term").unionByName(more)


def deck_units(s, d):
    """Lines as units of slides of ten lines: every fifth a heading, every seventh an inspection item; the translation is the line in capitals of ASCII."""
    n = F.col("doc_id") + F.col("line_no")
    text = F.when(n % 5 == 0, F.concat(F.lit("*"), F.substring("text", 1, 18), F.lit(": "), "text")).when(n % 7 == 0, F.concat(F.substring("text", 1, 18), F.lit(" - "), "text")).otherwise(F.col("text"))
    return catalog.units(s, d).select("doc_id", F.floor(F.col("line_no") / 10).alias("slide"), F.col("line_no").alias("at"), text.alias("text"), F.regexp_replace(F.upper(text), r"[^\x00-\x7F]", "x").alias("target"), (n % 7 == 0).alias("is_item"))


def pages(s, d):
    """Lines as pages of twenty lines; words of some lines as pairs."""
    words = F.split(F.trim("text"), r"\s+")
    pair = F.concat_ws(" : ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    return catalog.units(s, d).select("doc_id", F.floor(F.col("line_no") / 20).alias("page"), "line_no", F.when(F.col("line_no") % 4 == 1, pair).otherwise(F.col("text")).alias("text"))


QUERIES["p07_unmapped_terms"] = lambda s, d: H.unmapped(deck_units(s, d), glossary(s, d), domain(s), dictionary(s), ["doc_id", "slide"]).select("doc_id", "slide", "key", "pattern", "category", "at", "current", F.array_join("options", "|").alias("options"))
QUERIES["p08_document_feed"] = lambda s, d: H.fed(pages(s, d), glossary(s, d), domain(s), dictionary(s))
