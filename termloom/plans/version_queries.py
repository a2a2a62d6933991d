"""Queries of merges that check versions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import text as T
from ..sources import versioned as V
from . import base as B

QUERIES, ORACLES = {}, {}


def stored(s, d):
    """Sentences of benchmark items as the table: the last target of a key, version 1 to 3 by its item."""
    rows = catalog.memory(s, d).where("item_id % 4 <> 1").groupBy(T.exact_key(F.col("sentence")).alias("k")).agg(F.max(F.struct("item_id", "sentence_no")).alias("x"))
    return rows.select("k", F.concat(F.lit("t"), F.col("x.item_id").cast("string")).alias("target"), (F.col("x.item_id") % 3 + 1).alias("version"))


def edits(s, d):
    """Edits of sentences, several of some keys, from bases that are right, old, or none."""
    i = F.col("item_id")
    return catalog.memory(s, d).where("item_id % 2 = 1 or sentence_no % 2 = 0").select(T.exact_key(F.col("sentence")).alias("k"), F.concat(F.lit("e"), i.cast("string")).alias("target"), F.when(i % 5 == 0, None).when(i % 4 == 1, None).otherwise(F.when(i % 7 == 0, i % 3).otherwise(i % 3 + 1)).alias("base"), (i * 100 + F.col("sentence_no")).alias("rank"))


QUERIES["dml06_versioned_upsert"] = lambda s, d: V.merge(stored(s, d), edits(s, d), ["k"], ["target"]).select(F.md5("k").alias("k"), "target", "version", "outcome")
ORACLES["dml06_versioned_upsert"] = B.with_(B.MEMORY).rstrip() + f""", cur AS (SELECT k, 't' || i AS target, i % 3 + 1 AS version FROM (SELECT {B.exact('sentence')} AS k, max(item_id) AS i FROM memory WHERE item_id % 4 <> 1 GROUP BY 1)),
ed AS (SELECT * FROM (SELECT {B.exact('sentence')} AS k, 'e' || item_id AS target, CASE WHEN item_id % 5 = 0 OR item_id % 4 = 1 THEN NULL WHEN item_id % 7 = 0 THEN item_id % 3 ELSE item_id % 3 + 1 END AS base, row_number() OVER (PARTITION BY {B.exact('sentence')} ORDER BY item_id * 100 + sentence_no) AS r FROM memory WHERE item_id % 2 = 1 OR sentence_no % 2 = 0) WHERE r = 1)
SELECT md5(k) AS k, CASE WHEN outcome IN ('updated', 'inserted') THEN et ELSE ct END AS target, CASE outcome WHEN 'updated' THEN version + 1 WHEN 'inserted' THEN 1 ELSE version END AS version, outcome FROM (
  SELECT coalesce(cur.k, ed.k) AS k, cur.target AS ct, ed.target AS et, cur.version, CASE WHEN ed.k IS NULL THEN 'kept' WHEN cur.k IS NOT NULL AND (base IS NULL OR base <> version) THEN 'refused' WHEN cur.k IS NULL AND base IS NOT NULL THEN 'refused' WHEN cur.k IS NOT NULL THEN 'updated' ELSE 'inserted' END AS outcome FROM cur FULL JOIN ed ON cur.k = ed.k)"""


def requests(s, d):
    """Suggestions for every third line, some made for what the line no longer is, some of lines that are gone, some twice."""
    rows = catalog.units(s, d).where("line_no % 3 = 0")
    id = F.col("doc_id") * 100_000 + F.col("line_no")
    each = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = rows.select(F.when(F.col("doc_id") % 11 == 0, -id).otherwise(id).alias("id"), F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" before"))).otherwise(F.col("text")).alias("made_for"), "text", "doc_id", "line_no", each.alias("twice")).where("twice = 0 or line_no % 2 = 0")
    return rows.select("id", "made_for", F.when(F.col("doc_id") % 6 == 2, F.col("text")).otherwise(F.concat(F.col("twice").cast("string"), F.lit("> "), "text")).alias("suggestion"), (F.lit(1) - F.col("twice")).alias("rank"))


QUERIES["p04_revalidated_suggestions"] = lambda s, d: V.revalidated(catalog.units(s, d).select((F.col("doc_id") * 100_000 + F.col("line_no")).alias("id"), "text"), requests(s, d)).select("id", F.md5("text").alias("text"), "outcome")
ORACLES["p04_revalidated_suggestions"] = B.with_(B.UNITS) + """SELECT CASE WHEN doc_id % 11 = 0 THEN -(doc_id * 100000 + line_no) ELSE doc_id * 100000 + line_no END AS id,
  md5(CASE o WHEN 'applied' THEN (CASE WHEN line_no % 2 = 0 THEN '1> ' ELSE '0> ' END) || text WHEN 'gone' THEN NULL ELSE text END) AS text, o AS outcome
FROM (SELECT *, CASE WHEN doc_id % 11 = 0 AND NOT (doc_id = 0 AND line_no = 0) THEN 'gone' WHEN doc_id % 4 = 1 THEN 'stale' WHEN doc_id % 6 = 2 THEN 'same' ELSE 'applied' END AS o FROM units WHERE line_no % 3 = 0)"""
