"""Queries of language detection, pairing and whole pipelines, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import language as L
from ..functions import predicates as P
from ..functions import terms as X
from ..functions import text as T
from ..functions.vocabulary import ACRONYMS
from ..operators import activity as V
from ..operators import align as A
from ..operators import glossary as G
from ..operators import memory as M
from ..operators import quality as Q
from ..operators import rules as R
from ..operators import salvage as S
from . import activity_queries as AQ
from . import base as B
from . import language_queries as LQ
from . import memory_queries as MQ
from .text_queries import CASES, IS_LABEL, literal_query
from .text_queries import ORACLES as TEXT

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (B.with_(*ctes) if ctes else "") + sql


LINES = [*CASES, "kiem tra may", "May 12, 2024", "Check the gap", "quet keo khuon giay", "May logo", "the khuon and the giay", "last step now", "tan color"]


def lines(name: str, columns: dict, sql: dict[str, str]) -> None:
    """A query over fixed lines and the first words of the tables' lines."""
    from . import text_queries

    literal_query(name, LINES, columns, sql)
    QUERIES[name], ORACLES[name] = text_queries.QUERIES.pop(name), text_queries.ORACLES.pop(name)


t = lambda: F.col("text")
lines("f12_term_casing", {"cased": lambda: L.cased(F.replace(t(), F.lit("ß"), F.lit("ss")), F.lit(True))}, {
    "cased": "array_to_string(list_transform(regexp_split_to_array(trim(replace(text, 'ß', 'ss')), '\\s+'), lambda w, i: CASE WHEN upper(w) IN (" + ", ".join(f"'{a}'" for a in ACRONYMS) + ") THEN upper(w) WHEN regexp_matches(w, '\\d') OR regexp_matches(w, '^[A-Z0-9]+-[A-Z0-9\\-]+$') THEN w WHEN i = 1 THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE lower(w) END), ' ')",
})
QUERIES["f09_punctuation"] = lambda s, d: catalog.units(s, d).select("doc_id", "line_no", F.md5(L.punctuated(t())).alias("text"))
FORMULAS = ["A1+B2", "SUM(B1:C3)", "$B$1", "Other!B1", "LOG10(B1)"]
add("f34_formula_shift", lambda s, d: S.shifted(s.createDataFrame(list(enumerate(FORMULAS)), "k long, formula string"), "k", 2), "SELECT CAST(k AS BIGINT) AS k, formula FROM (VALUES (0, 'A1+C2'), (1, 'SUM(C1:D3)'), (2, '$C$1'), (3, 'Other!B1'), (4, 'LOG10(C1)')) v(k, formula)")
answered = lambda s, d: catalog.table(s, d, "events").select((F.col("event_id") % 500).alias("batch"), F.concat(F.lit('[{"id":"'), F.col("user_id").cast("string"), F.lit('","text":" '), F.col("event_type"), F.lit('"},{"id":"x'), F.when(F.col("event_id") % 2 == 0, '"').otherwise('","text":"y"}]')).alias("raw"))
add("f41_answer_salvage", lambda s, d: S.answers(answered(s, d), catalog.table(s, d, "events").select((F.col("event_id") % 500).alias("batch"), F.col("user_id").cast("string").alias("id"))).select("batch", "id"), "SELECT DISTINCT event_id % 500 AS batch, CAST(user_id AS VARCHAR) AS id FROM events")
add("fil05_session_filter", lambda s, d: catalog.table(s, d, "conversations").where(F.lower("text").contains("than")).select("conv_id").distinct(), "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'than')")
add("dml06_sentence_upsert", lambda s, d: catalog.memory(s, d).withColumn("k", T.exact_key(F.col("sentence"))).groupBy("k").agg(F.max(F.struct("item_id", "sentence_no")).alias("last")).select("k", "last.item_id"), f"SELECT {B.exact('sentence')} AS k, max(item_id) AS item_id FROM memory GROUP BY 1", B.MEMORY)
add("dml08_reseed", lambda s, d: G.reseeded(catalog.terms(s, d).where("id % 3 = 0"), catalog.terms(s, d).where("id % 2 = 0").select("id", "source_term"), "id"), "SELECT id, source_term, id % 3 = 0 AS replaced FROM terms WHERE id % 2 = 0", B.TERMS)
add("dml09_capped_log", lambda s, d: V.newest(catalog.log(s, d).unionByName(catalog.log(s, d).where("id < 10").withColumn("id", F.col("id") + 1_000_000)), 1000, [F.desc("ts"), F.desc("id")]).select("id"), "SELECT id FROM (SELECT id, ts FROM log UNION ALL SELECT id + 1000000, ts FROM log WHERE id < 10) ORDER BY ts DESC, id DESC LIMIT 1000", B.LOG)
add("st08_batch_memory", lambda s, d: M.resolve(MQ.recorded(s, d).withColumn("seq", F.floor(F.col("seq") / 25))).agg(F.count("*").alias("keys"), F.sum("n").alias("events")), f"SELECT count(DISTINCT k) AS keys, count(*) AS events FROM (SELECT {B.exact('source')} AS k, {B.exact('target')} AS n FROM recorded) WHERE k <> '' AND n <> '' AND k <> n", B.UNITS, MQ.RECORDED)
add("j28_cross_slide_steps", lambda s, d: A.step_pairs(MQ.stepped(s, d).withColumn("slide", F.floor(F.col("doc_id") / 2)).withColumn("side", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")), ["slide"]), "SELECT slide, step, a.l AS a_line, b.l AS b_line FROM (SELECT doc_id // 2 AS slide, step, min(line_no) AS l FROM stepped WHERE doc_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1) a JOIN (SELECT doc_id // 2 AS slide, step, min(line_no) AS l FROM stepped WHERE doc_id % 2 = 1 GROUP BY 1, 2 HAVING count(*) = 1) b USING (slide, step)", B.UNITS, MQ.SIDED, MQ.STEPPED)
left = lambda s, d: MQ.sided(s, d).join(A.adjacent_pairs(MQ.sided(s, d)).select("doc_id", F.explode(F.array("first", "second")).alias("line_no")), ["doc_id", "line_no"], "left_anti")
add("j24_anchored_left_overs", lambda s, d: left(s, d).withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("line_no"))).groupBy("doc_id", "at").agg(F.min(F.when(F.col("side") == "a", F.col("line_no"))).alias("a_line"), F.min(F.when(F.col("side") == "b", F.col("line_no"))).alias("b_line")).where("a_line is not null and b_line is not null").select("doc_id", "a_line", "b_line"),
    'SELECT doc_id, min(line_no) FILTER (side = \'a\') AS a_line, min(line_no) FILTER (side = \'b\') AS b_line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY line_no) AS k FROM sided s WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.doc_id = s.doc_id AND (adj.first = s.line_no OR adj.second = s.line_no))) GROUP BY doc_id, k HAVING min(line_no) FILTER (side = \'a\') IS NOT NULL AND min(line_no) FILTER (side = \'b\') IS NOT NULL',
    B.UNITS, MQ.SIDED, "adj AS (" + MQ.ORACLES["j07_adjacent_pairs"].split(MQ.SIDED + "\n")[-1] + ")")
add("j26_memory_mediated", lambda s, d: MQ.bulleted(s, d).join(MQ.known(s, d).groupBy(T.compact(F.col("source")).alias("k")).agg(F.min("target").alias("target")), T.compact(F.col("text")) == F.col("k")).select("doc_id", "line_no", F.md5("target").alias("target")), f"SELECT doc_id, line_no, md5(t) AS target FROM bulleted JOIN (SELECT {B.compact('source')} AS k, min(target) AS t FROM known GROUP BY 1) ON k = {B.compact('text')}", B.UNITS, MQ.KNOWN, MQ.BULLETED)
add("j29_heading_notes", lambda s, d: catalog.units(s, d).groupBy("doc_id").agg(F.min("line_no").alias("heading"), F.max("line_no").alias("note")).where("note > heading"), "SELECT doc_id, min(line_no) AS heading, max(line_no) AS note FROM units GROUP BY doc_id HAVING max(line_no) > min(line_no)", B.UNITS)
add("snk01_seed", lambda s, d: catalog.terms(s, d).unionByName(catalog.terms(s, d).where("id % 4 = 0")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at")))).where("r = 1").select("id", "source_term", "target_term"), "SELECT id, source_term, target_term FROM terms", B.TERMS)
add("src17_glossary_import", lambda s, d: G.new_rows(catalog.terms(s, d).where("id % 2 = 1"), catalog.terms(s, d).where("id % 2 = 0")).agg(F.count("*").alias("added")), f"SELECT count(*) AS added FROM (SELECT DISTINCT lower(trim(source_term)) AS a, lower(trim(target_term)) AS b FROM terms WHERE id % 2 = 1) n WHERE (a, b) NOT IN (SELECT (lower(trim(source_term)), lower(trim(target_term))) FROM terms WHERE id % 2 = 0)", B.TERMS)
add("src18_cache_load", lambda s, d: catalog.log(s, d).where(F.to_date("ts") == F.to_date(F.lit("2024-01-10"))).select("id", "user_id"), "SELECT id, user_id FROM log WHERE CAST(ts AS DATE) = DATE '2024-01-10'", B.LOG)
add("src20_explicit_pairs", lambda s, d: catalog.table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="/([^"]+)"'), 1)).alias("pos", "link")), r"""SELECT page_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS link FROM (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS l FROM pages))""")
add("src09_deck_crawl", lambda s, d: catalog.runs(s, d).groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.substring(F.min_by("text", "run_no"), 1, 80).alias("title")), "SELECT page_id, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars, substr(arg_min(text, run_no), 1, 80) AS title FROM runs GROUP BY page_id", B.RUNS)
# --- whole pipelines, composed of the operators above
add("p01_text_translation", lambda s, d: LQ.classified(s, d).where("status in ('NEEDS_TRANSLATION', 'REVIEW_REQUIRED')").select("doc_id", "line_no", "text").withColumn("out", R.translated(F.col("text"), {"of the": "du"}, AQ.WORDS)).withColumns(Q.qa(F.col("text"), F.col("out"))).groupBy("passed").agg(F.count("*").alias("n"), F.min("score").alias("least")))
add("p03_deck_audit", lambda s, d: LQ.classified(s, d).groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if(F.col("status") == "NEEDS_TRANSLATION").alias("needs"), F.count_if(F.col("status") == "TM_REUSE").alias("reuse"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review")), "SELECT doc_id, count(*) AS units, count(*) FILTER (status = 'NEEDS_TRANSLATION') AS needs, count(*) FILTER (status = 'TM_REUSE') AS reuse, count(*) FILTER (status = 'REVIEW_REQUIRED') AS review FROM classified GROUP BY doc_id", B.UNITS, *LQ.CLASSIFIED)
add("p04_apply_suggestions", lambda s, d: A.overlay(catalog.units(s, d).select((F.col("doc_id") * 10_000 + F.col("line_no")).alias("unit_id"), "text"), MQ.edits(s, d).where("id is not null"), "unit_id", "text").agg(F.count_if("edited").alias("applied"), F.count("*").alias("units")), "SELECT count(*) FILTER (doc_id % 2 = 0 AND line_no % 7 = 1) AS applied, count(*) AS units FROM units", B.UNITS)
add("p05_workbook_audit", lambda s, d: catalog.units(s, d).withColumn("cell", P.is_cell_text(F.col("text"))).groupBy("doc_id").agg(F.count_if("cell").alias("cells"), F.count_if(~F.col("cell")).alias("other")), rf"SELECT doc_id, count(*) FILTER (c) AS cells, count(*) FILTER (NOT c) AS other FROM (SELECT doc_id, {TEXT['fil19_cell_text'].split('SELECT text, ')[-1].rsplit(' AS cell', 1)[0]} AS c FROM units) GROUP BY doc_id", B.UNITS)
add("p10_corrected_provenance", lambda s, d: QUERIES["j26_memory_mediated"](s, d).groupBy("doc_id").agg(F.count("*").alias("matched")), f"SELECT doc_id, count(*) AS matched FROM bulleted JOIN (SELECT {B.compact('source')} AS k FROM known GROUP BY 1) ON k = {B.compact('text')} GROUP BY doc_id", B.UNITS, MQ.KNOWN, MQ.BULLETED)


# --- term rewriting: fixed cases with their results, beside all lines of the tables, which hold none of the patterns
def rewriting(name: str, function, cases: dict[str, str]) -> None:
    values = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in cases.items())

    def run(s, d):
        fixed = s.createDataFrame([(k,) for k in cases], "text string").select("text", function(F.col("text")).alias("out"))
        rows = catalog.units(s, d).select("text", function(F.col("text")).alias("out")).groupBy().agg(F.count_if(F.col("text") != F.col("out")).cast("string").alias("out")).select(F.lit("changed lines").alias("text"), "out")
        return fixed.unionByName(rows)

    QUERIES[name], ORACLES[name] = run, f"SELECT * FROM (VALUES {values}, ('changed lines', '0')) v(text, out)"


rewriting("f10_stitch_density", X.stitch_density, {"9-10 mũi/inch": "SPI 9-10 stitches/inch", "10-12 SPI": "SPI 10-12 stitches/inch", "lại 2-3 mũi": "lại 2-3 mũi", "11-12 9-10 SPI": "SPI 11-12 stitches/inch"})
rewriting("f11_hyphens_and_order", lambda c: X.hyphenated(X.reordered(c)), {"1. Shape toe": "1. Toe shape", "Tipquarter NOSEW": "Tip-quarter NO-SEW"})
QUERIES["f13_clean_target"] = lambda s, d: catalog.terms(s, d).select("id", X.clean_target(F.concat_ws("/", "target_term", "source_term")).alias("target"))
ORACLES["f13_clean_target"] = B.with_(B.TERMS) + "SELECT id, CASE WHEN contains(target_term, ' ') THEN target_term WHEN contains(source_term, ' ') THEN source_term ELSE target_term END AS target FROM terms"
QUERIES["f24_spelling"] = lambda s, d: catalog.units(s, d).select("doc_id", "line_no", F.md5(X.spelling(F.col("text"), ["kiểm tra", "an toàn"])).alias("text"))
QUERIES["f16_enforcement"] = lambda s, d: X.enforced(catalog.pairs(s, d).withColumn("k", F.col("conv_id") * 100 + F.col("turn")), "k", [{"term": "the", "target": "this", "synonyms": ["that"]}]).select("k", "replaced")
add("prj09_report_projection", lambda s, d: catalog.log(s, d).select("id", "user_id", "operation", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time")), "SELECT id, user_id, operation, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_time FROM log", B.LOG)
add("p02_deck_translation", lambda s, d: M.plan(MQ.bulleted(s, d), MQ.known(s, d)).withColumn("target", F.coalesce("target", R.translated(F.col("text"), {"of the": "du"}, AQ.WORDS))).groupBy("how").agg(F.count("*").alias("n"), F.count_if(F.col("target").isNull()).alias("missing")), "SELECT how, count(*) AS n, CAST(0 AS BIGINT) AS missing FROM (" + MQ.ORACLES["j02_j03_memory_plan"] + ") GROUP BY how")
