"""Queries of sources, model calls and the remaining joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import language as L
from ..functions import predicates as P
from ..functions import text as T
from ..operators import activity as V
from ..operators import align as A
from ..operators import glossary as G
from ..operators import inference as I
from ..operators import memory as M
from ..operators import rules as R
from ..sources import files
from . import activity_queries as AQ
from ..operators import classify as C
from . import base as B
from . import language_queries as LQ
from . import glossary_queries as GQ
from . import memory_queries as MQ

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (B.with_(*ctes) if ctes else "") + sql


def uploads(s, d):
    n = F.col("s_suppkey")
    head = F.when(n % 4 == 0, F.lit("%PDF-1.7")).when(n % 4 == 1, F.lit("PK\x03\x04")).otherwise(F.lit("MZ"))
    extension = F.when(n % 3 == 0, "pdf").when(n % 3 == 1, "xlsx").otherwise("csv")
    return catalog.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("f"), n.cast("string"), F.lit("."), extension).alias("name"), F.concat(head, "s_name").cast("binary").alias("content"))


KIND = "CASE WHEN n % 3 = 2 THEN 'csv' WHEN n % 3 = 0 AND n % 4 = 0 THEN 'pdf' WHEN n % 3 = 1 AND n % 4 = 1 THEN 'xlsx' END"
add("src01_src02_signature", lambda s, d: uploads(s, d).select("s_suppkey", files.signature(F.col("content"), F.col("name")).alias("kind")), f"SELECT s_suppkey, {KIND} AS kind FROM (SELECT *, s_suppkey AS n FROM supplier)")
add("p09_upload_register", lambda s, d: uploads(s, d).groupBy(F.coalesce(files.signature(F.col("content"), F.col("name")), F.lit("refused")).alias("kind")).agg(F.count("*").alias("n")), f"SELECT coalesce({KIND}, 'refused') AS kind, count(*) AS n FROM (SELECT s_suppkey AS n FROM supplier) GROUP BY 1")
add("src10_paragraph_runs", lambda s, d: catalog.table(s, d, "pages").select("page_id", F.posexplode(files.text_runs(F.col("html"), "p")).alias("pos", "text")), r"SELECT page_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS text FROM (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<p(?:\s[^>]*)?>([^<]*)</p>', 1) AS l FROM pages))")
add("src11_parent_shape", lambda s, d: A.containing(MQ.points(s, d), MQ.spans(s, d), ["k"], 16).groupBy("k").agg(F.count("*").alias("held")), "SELECT k, count(*) AS held FROM (" + MQ.ORACLES["j18_interval_join"] + ") GROUP BY k")
add("src12_boxes", lambda s, d: catalog.table(s, d, "part").select("p_partkey", T.percent_box(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(2000.0))[0].alias("low"), T.percent_box(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(60.0))[1].alias("extent")), "SELECT p_partkey, floor(greatest(0.0, least(100.0, p_retailprice / 2000.0 * 100)) * 10 + 0.5) / 10 AS low, floor(greatest(0.0, least(100.0, p_size / 60.0 * 100)) * 10 + 0.5) / 10 AS extent FROM part")
_seeds = lambda s, d, n: catalog.terms(s, d).where(n).select("id", "source_term")
add("src15_seed_when_empty", lambda s, d: G.seeded(_seeds(s, d, "id < 0"), _seeds(s, d, "true")).withColumn("existing", F.lit("none")).unionByName(G.seeded(_seeds(s, d, "id % 50 = 7"), _seeds(s, d, "true")).withColumn("existing", F.lit("some"))), "SELECT id, source_term, 'none' AS existing FROM terms UNION ALL SELECT id, source_term, 'some' FROM terms WHERE id % 50 = 7", B.TERMS)
add("src19_catalog_pairs", lambda s, d: M.history(("catalog", catalog.terms(s, d).select(F.col("source_term").alias("source"), F.col("target_term").alias("target"))), ("coded", catalog.terms(s, d).select(F.concat_ws(" ", "category", "source_term").alias("source"), F.col("target_term").alias("target")))), "SELECT DISTINCT source_term AS source, target_term AS target, 'catalog' AS origin FROM terms UNION ALL SELECT DISTINCT category || ' ' || source_term, target_term, 'coded' FROM terms", B.TERMS)
add("src22_live_errors", lambda s, d: V.newest(catalog.log(s, d).where("operation = 'error'"), 20, [F.desc("ts"), F.desc("id")]).select("id", "user_id"), "SELECT id, user_id FROM log WHERE operation = 'error' ORDER BY ts DESC, id DESC LIMIT 20", B.LOG)
add("src23_batch_upsert", lambda s, d: G.upsert(GQ.old(s, d), GQ.new(s, d)).groupBy("op").agg(F.count("*").alias("n")), "SELECT op, count(*) AS n FROM (" + GQ.ORACLES["dml01_upsert"] + ") GROUP BY op")


def _f03(s, d):
    decomposed = F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301"))
    return catalog.units(s, d).select("doc_id", "line_no", T.nfc_key(decomposed).alias("key"))


add("f03_nfc_key", _f03, r"SELECT doc_id, line_no, lower(trim(regexp_replace(nfc_normalize(replace(text, 'é', 'e' || chr(769))), '\s+', ' ', 'g'))) AS key FROM units", B.UNITS)
add("f15_acronyms", lambda s, d: GQ.cases(s).select("id", R.rewritten(F.col("target_term"), [(r"(?i)\bok\b", "OK"), (r"(?i)\bfine\b", "OK")]).alias("target")), r"SELECT CAST(id AS BIGINT) AS id, regexp_replace(regexp_replace(target_term, '(?i)\bok\b', 'OK', 'g'), '(?i)\bfine\b', 'OK', 'g') AS target FROM cases", GQ.CASES_CTE)
STAGES = [("cutting", "cold|hot"), ("stitching", "bolt|nut"), ("assembly", "gear|ring")]
add("f22_stage_classifier", lambda s, d: catalog.terms(s, d).select("id", P.stage(F.col("source_term"), STAGES).alias("stage")), "SELECT id, CASE WHEN regexp_matches(source_term, '(?i)(^|[^A-Za-z0-9_])(?:cold|hot)([^A-Za-z0-9_]|$)') THEN 'cutting' WHEN regexp_matches(source_term, '(?i)(^|[^A-Za-z0-9_])(?:bolt|nut)([^A-Za-z0-9_]|$)') THEN 'stitching' WHEN regexp_matches(source_term, '(?i)(^|[^A-Za-z0-9_])(?:gear|ring)([^A-Za-z0-9_]|$)') THEN 'assembly' ELSE 'general' END AS stage FROM terms", B.TERMS)
pairs_of = lambda s, d, n: catalog.terms(s, d).where(f"id % 3 = {n}").select(F.col("source_term").alias("key"), F.col("target_term").alias("target"))
add("f28_m08_suggestions", lambda s, d: I.suggestions(catalog.terms(s, d).select("source_term").distinct(), "source_term", pairs_of(s, d, 0), pairs_of(s, d, 1), pairs_of(s, d, 2), 100).select("source_term", F.size("suggestions").alias("n")), "SELECT source_term, CAST(count(DISTINCT target_term) AS INTEGER) AS n FROM terms GROUP BY source_term", B.TERMS)
add("f38_elapsed", lambda s, d: catalog.log(s, d).groupBy("user_id").agg(F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).alias("ms")), "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM log GROUP BY user_id", B.LOG)
add("j22_reversed_terms", lambda s, d: GQ.both(s, d).groupBy("is_direct").agg(F.count("*").alias("n")), "SELECT is_direct, count(*) AS n FROM two_way GROUP BY is_direct", B.TERMS, GQ.BOTH)


def overlaps(s, d):
    m = A.matched_terms(catalog.units(s, d).select((F.col("doc_id") * 10_000 + F.col("line_no")).alias("unit_id"), "text"), MQ.GLOSSARY, "unit_id", "text")
    return m.withColumn("reach", F.max("end").over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))).agg(F.count_if(F.col("start") < F.col("reach")).alias("overlaps"))


add("w10_spans_do_not_overlap", overlaps, "SELECT CAST(0 AS BIGINT) AS overlaps")
add("dml10_memory_register", lambda s, d: M.resolve(MQ.recorded(s, d).where("status = 'LOCKED'")).agg(F.count("*").alias("entries"), F.sum("conflicts").alias("conflicts")), f"SELECT count(*) AS entries, CAST(sum(c) AS BIGINT) AS conflicts FROM (SELECT count(*) FILTER (n <> w) AS c FROM (SELECT k, n, first_value(n) OVER (PARTITION BY k ORDER BY seq) AS w FROM (SELECT seq, {B.exact('source')} AS k, {B.exact('target')} AS n FROM recorded WHERE status = 'LOCKED') WHERE k <> '' AND n <> '' AND k <> n) GROUP BY k)", B.UNITS, MQ.RECORDED)


def ladder(s, d):
    lines = LQ.lines(s, d)
    mates = A.adjacent_pairs(MQ.sided(s, d)).select("doc_id", F.explode(F.array("first", "second")).alias("line_no"))
    unit = F.struct("doc_id", "line_no")
    units = lines.select(unit.alias("unit_id"), "text", F.col("doc_id").alias("container"), F.lit(False).alias("reference"), F.lit(False).alias("to_duplicate"))
    memory = catalog.units(s, d).where("doc_id % 3 = 0").select(F.col("text").alias("source"), F.col("text").alias("target"))
    glossary = catalog.memory(s, d).select(F.col("sentence").alias("source"), F.col("sentence").alias("target"))
    out = C.presentation(units, mates.select(unit.alias("unit_id"), F.lit("there").alias("existing")), memory, glossary)
    return out.select("unit_id.doc_id", "unit_id.line_no", "status")


_ADJ = "adj AS (" + MQ.ORACLES["j07_adjacent_pairs"].split(MQ.SIDED + "\n")[-1] + ")"
_KNOWN = lambda table, column: f"({B.exact('w.text')} IN (SELECT {B.exact(column)} FROM {table}) OR {B.canonical('w.text')} IN (SELECT {B.canonical(column)} FROM {table}))"
add("prj02_presentation_ladder", ladder, rf"""
SELECT doc_id, line_no, CASE WHEN c.label OR c.code THEN 'NON_TRANSLATABLE'
  WHEN held.vi AND (regexp_matches(c.text, '(?i)^[-–—*•#]?\s*size\s*#?[\d.,\-]+') OR regexp_matches(c.text, '(?i)^[-–—*•#]?\s*#?\d+(?:[.,]\d+)?(?:\s*[-–—/]\s*#?\d+(?:[.,]\d+)?)?\s*[:：]?\s*[\d.,\-+±~]+\s*(?:kg/cm²|kg|g|cm|mm|℃|°c|sec|s|min|bar|psi|spi|%|m/s|v|w|a)?$')) THEN 'TM_REUSE'
  WHEN NOT (c.vietnamese OR c.hints) THEN 'ALREADY_TRANSLATED'
  WHEN EXISTS (SELECT 1 FROM adj WHERE adj.doc_id = c.doc_id AND (adj.first = c.line_no OR adj.second = c.line_no)) THEN 'ALREADY_TRANSLATED'
  WHEN bi.both_languages THEN 'ALREADY_TRANSLATED'
  WHEN regexp_matches(c.text, '(?i)^\s*\*?\s*(?:(?:đối\s*với|áp\s*dụng\s*cho|dành\s*cho)\s|(?:model|mẫu)\s*[:：\-])\s*[A-Z0-9\-/.()#:,][A-Z0-9\-/.\s()#:,]*$') THEN 'LOCKED_TERMINOLOGY'
  WHEN {_KNOWN("memory", "sentence")} THEN 'LOCKED_TERMINOLOGY' WHEN {_KNOWN("(SELECT text AS x FROM units WHERE doc_id % 3 = 0)", "x")} THEN 'TM_REUSE' ELSE 'NEEDS_TRANSLATION' END AS status
FROM c JOIN bi USING (doc_id, line_no) JOIN (SELECT doc_id, bool_or(regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]')) AS vi FROM whole_lines GROUP BY doc_id) held USING (doc_id) JOIN whole_lines w USING (doc_id, line_no) WHERE c.kind = 'whole'
""", B.UNITS, B.MEMORY, MQ.SIDED, _ADJ, LQ.PARTS, LQ.EVIDENCE, LQ.CODES, LQ.BILINGUAL)  # fmt: skip
offline = I.Offline({"of the": "du"}, AQ.WORDS)
add("m01_m02_provider", lambda s, d: I.translate(catalog.units(s, d), "text", offline).groupBy("origin").agg(F.count("*").alias("n")))
add("m06_scoped_repair", lambda s, d: I.translate(catalog.units(s, d), "text", offline, I.Offline({}, {})).groupBy("doc_id").agg(F.count("*").alias("units"), F.count("target").alias("done")))
add("m07_chunked_verdicts", lambda s, d: catalog.units(s, d).withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1) / 5)).groupBy("doc_id", "chunk").agg(F.count("*").alias("units")), "SELECT doc_id, (r - 1) // 5 AS chunk, count(*) AS units FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM units) GROUP BY 1, 2", B.UNITS)
