"""Queries of memory, alignment and joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import predicates as P
from ..functions import text as T
from ..operators import align as A
from ..operators import classify as C
from ..operators import memory as M
from . import base as B

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (B.with_(*ctes) if ctes else "") + sql


#: Memory of the tests' tables: lines of every third document, marked, stand for their translations.
known = lambda s, d: catalog.units(s, d).where("doc_id % 3 = 0").select(F.col("text").alias("source"), F.concat(F.lit(">"), "text").alias("target"))
KNOWN = "known AS (SELECT text AS source, '>' || text AS target FROM units WHERE doc_id % 3 = 0)"
bulleted = lambda s, d: catalog.units(s, d).where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("• "), "text")).otherwise(F.col("text")))
BULLETED = "bulleted AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN '• ' || text ELSE text END AS text FROM units WHERE doc_id % 3 <> 0)"
add(
    "j02_j03_memory_plan",
    lambda s, d: M.plan(bulleted(s, d), known(s, d)).select("doc_id", "line_no", "how", F.md5(F.coalesce("target", F.lit(""))).alias("target_md5")),
    rf"""SELECT doc_id, line_no, CASE WHEN e.t IS NOT NULL THEN 'exact' WHEN c.t IS NOT NULL THEN 'canonical' ELSE 'pending' END AS how,
      md5(coalesce(e.t, regexp_extract(trim(text), '({B.BULLET})', 1) || c.t, '')) AS target_md5
    FROM bulleted b LEFT JOIN (SELECT {B.exact('source')} AS k, min(target) AS t FROM known GROUP BY 1) e ON e.k = {B.exact('b.text')}
    LEFT JOIN (SELECT {B.canonical('source')} AS k, min(target) AS t FROM known GROUP BY 1) c ON c.k = {B.canonical('b.text')}""",
    B.UNITS, KNOWN, BULLETED,
)
REUSE = f"reuse AS (SELECT *, {B.exact('text')} AS key, CASE WHEN row_number() OVER (PARTITION BY {B.exact('text')} ORDER BY doc_id, line_no) = 1 THEN 'NEEDS_TRANSLATION' ELSE 'TM_REUSE' END AS status FROM units)"
reuse = lambda s, d: M.reuse(catalog.units(s, d))
add("slice_reuse_audit", lambda s, d: reuse(s, d).groupBy("lang").agg(F.count("*").alias("units"), F.count_if(F.col("status") == "TM_REUSE").alias("reused"), F.countDistinct("key").alias("keys")), "SELECT lang, count(*) AS units, count(*) FILTER (status = 'TM_REUSE') AS reused, count(DISTINCT key) AS keys FROM reuse GROUP BY lang", B.UNITS, REUSE)

#: Competing targets: lines by their key, with the status that the document's number gives.
STATUS = ["LOCKED", "APPROVED", "ESTABLISHED", "SUGGESTED", "ESTABLISHED", "ESTABLISHED"]
recorded = lambda s, d: catalog.units(s, d).select((F.col("doc_id") * 10_000 + F.col("line_no")).alias("seq"), F.substring("text", 1, 4).alias("source"), F.substring("text", 5, 4).alias("target"), F.element_at(F.array(*map(F.lit, STATUS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("status"))
RECORDED = f"recorded AS (SELECT doc_id * 10000 + line_no AS seq, substr(text, 1, 4) AS source, substr(text, 5, 4) AS target, {STATUS!r}[doc_id % 6 + 1] AS status FROM units)"
add(
    "w03_conflict_resolution",
    lambda s, d: M.resolve(recorded(s, d)),
    f"""SELECT b.key, b.target, b.status, b.n, coalesce(l.c, 0) AS conflicts, CASE WHEN l.c > 0 THEN CASE b.status WHEN 'LOCKED' THEN 'LOCKED_GLOSSARY' WHEN 'APPROVED' THEN 'APPROVED_MEMORY' ELSE 'EARLIEST' END END AS resolved_by
    FROM (SELECT key, arg_min(target, (-rank, seq)) AS target, arg_min(norm, (-rank, seq)) AS norm, arg_min(status, (-rank, seq)) AS status, count(*) AS n FROM rows GROUP BY key) b
    LEFT JOIN (SELECT rows.key, count(*) AS c FROM rows JOIN (SELECT key, arg_min(norm, (-rank, seq)) AS norm FROM rows GROUP BY key) w ON w.key = rows.key AND w.norm <> rows.norm GROUP BY rows.key) l USING (key)""",
    B.UNITS, RECORDED, f"rows AS (SELECT * FROM (SELECT *, {B.exact('source')} AS key, {B.exact('target')} AS norm, CASE status WHEN 'LOCKED' THEN 5 WHEN 'APPROVED' THEN 4 WHEN 'ESTABLISHED' THEN 3 WHEN 'SUGGESTED' THEN 2 ELSE 1 END AS rank FROM recorded) WHERE key <> '' AND norm <> '' AND key <> norm)",
)
add("a06_memory_summary", lambda s, d: M.resolve(recorded(s, d)).groupBy("status").agg(F.count("*").alias("entries"), F.sum("conflicts").alias("conflicts")), "SELECT status, count(*) AS entries, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM (" + ORACLES["w03_conflict_resolution"] + ") GROUP BY status")
add("a03_consistency_groups", lambda s, d: M.consistency(recorded(s, d)), f"SELECT source_key, count(*) AS variants, CAST(sum(n) AS BIGINT) AS occurrences, arg_min(target_key, (-n, target_key)) AS preferred FROM (SELECT {B.normalised('source')} AS source_key, {B.normalised('target')} AS target_key, count(*) AS n FROM recorded GROUP BY 1, 2) GROUP BY source_key HAVING count(*) >= 2", B.UNITS, RECORDED)

pair_sample = lambda s, d: catalog.memory(s, d).select((F.col("item_id") * 100 + F.col("sentence_no")).alias("e"), F.col("sentence").alias("e_text"))
ENTRIES = "entries AS (SELECT item_id * 100 + sentence_no AS e, sentence AS e_text FROM memory)"
queries_of = lambda s, d: catalog.units(s, d).select(F.posexplode(F.split("text", r"\. ")).alias("p", "q_text"), "doc_id", "line_no").where("trim(q_text) <> ''").select((F.col("doc_id") * 1_000_000 + F.col("line_no") * 1000 + F.col("p")).alias("q"), "q_text")
QUESTIONS = "questions AS (SELECT doc_id * 1000000 + line_no * 1000 + i AS q, l[i + 1] AS q_text FROM (SELECT doc_id, line_no, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, line_no, string_split(text, '. ') AS l FROM units)) WHERE trim(l[i + 1]) <> '')"
QUERIES["j09_fuzzy_memory"] = lambda s, d: M.fuzzy_matches(queries_of(s, d), pair_sample(s, d)).select("q", "e", F.round("confidence", 6).alias("confidence"))
add("j09_exact_stage", lambda s, d: M.exact_matches(queries_of(s, d), pair_sample(s, d)),
    rf"""SELECT q, e, CASE WHEN {B.normalised('q_text')} = {B.normalised('e_text')} THEN 0.99 WHEN {B.folded('q_text')} = {B.folded('e_text')} THEN 0.97 WHEN length({B.compact('q_text')}) >= 8 THEN 0.96 ELSE 0.92 END AS confidence
    FROM questions JOIN entries ON {B.compact('q_text')} = {B.compact('e_text')} WHERE regexp_extract_all(q_text, '\d+(?:[.,]\d+)*') = regexp_extract_all(e_text, '\d+(?:[.,]\d+)*')""", B.UNITS, B.MEMORY, ENTRIES, QUESTIONS)  # fmt: skip
add("f08_trigrams", lambda s, d: M.grams_of(pair_sample(s, d), "e", "e_text").groupBy("gram").agg(F.count("*").alias("df")), f"SELECT gram, count(*) AS df FROM (SELECT DISTINCT e, substr(c, i, 3) AS gram FROM (SELECT e, c, unnest(range(1, length(c) - 1)) AS i FROM (SELECT e, {B.compact('e_text')} AS c FROM entries))) GROUP BY gram", B.MEMORY, ENTRIES)
add("l06_rarest_grams", lambda s, d: M.grams_of(pair_sample(s, d), "e", "e_text").withColumn("df", F.count("*").over(Window.partitionBy("gram"))).withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy("df", "gram"))).where("r <= 8").select("e", "gram", "df"), f"SELECT e, gram, df FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY df, gram) AS r FROM (SELECT *, count(*) OVER (PARTITION BY gram) AS df FROM (SELECT DISTINCT e, substr(c, i, 3) AS gram FROM (SELECT e, c, unnest(range(1, length(c) - 1)) AS i FROM (SELECT e, {B.compact('e_text')} AS c FROM entries))))) WHERE r <= 8", B.MEMORY, ENTRIES)
neighbours = lambda s, d: catalog.units(s, d).withColumn("next", F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("next is not null and length(text) < 400 and length(next) < 400").where(~F.concat("text", "next").rlike(r"[^\x00-\x7F]"))
NEIGHBOURS = "neighbours AS (SELECT * FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM units) WHERE next IS NOT NULL AND length(text) < 400 AND length(next) < 400 AND NOT regexp_matches(text || next, '[^\x00-\x7F]'))"
add("f06_edit_similarity", lambda s, d: neighbours(s, d).select("doc_id", "line_no", F.round(T.edit_similarity(T.compact(F.col("text")), T.compact(F.col("next"))), 6).alias("similarity")), f"SELECT doc_id, line_no, round(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS similarity FROM (SELECT doc_id, line_no, {B.compact('text')} AS a, {B.compact('next')} AS b FROM neighbours)", B.UNITS, NEIGHBOURS)
add("f07_guarded_similarity", lambda s, d: neighbours(s, d).select("doc_id", "line_no", F.round(T.guarded_similarity(F.col("text"), F.col("next")), 6).alias("similarity")),
    rf"""SELECT doc_id, line_no, round(CASE WHEN array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), '|') <> array_to_string(regexp_extract_all(next, '\d+(?:[.,]\d+)*'), '|') THEN 0
      WHEN array_to_string(list_sort(list_filter(x, lambda t: t IN ({', '.join(map(repr, T.CONTRAST))}))), '|') <> array_to_string(list_sort(list_filter(y, lambda t: t IN ({', '.join(map(repr, T.CONTRAST))}))), '|') THEN 0
      WHEN nx = ny THEN 0.99 WHEN fx = fy THEN 0.97 WHEN cx = cy AND length(cx) >= 8 THEN 0.96 WHEN greatest(length(cx), length(cy)) > 350 THEN 0 WHEN len(x) <> len(y) THEN 0
      ELSE least(0.92, CASE WHEN cx = cy THEN 1.0 WHEN cx = '' OR cy = '' THEN 0.0 ELSE 1 - levenshtein(cx, cy)::DOUBLE / greatest(length(cx), length(cy)) END * 0.8 + len(list_filter(x, lambda t: list_contains(y, t)))::DOUBLE / greatest(1, len(x)) * 0.2) END, 6) AS similarity
    FROM (SELECT *, {B.tokens('text')} AS x, {B.tokens('next')} AS y, {B.normalised('text')} AS nx, {B.normalised('next')} AS ny, {B.folded('text')} AS fx, {B.folded('next')} AS fy, {B.compact('text')} AS cx, {B.compact('next')} AS cy FROM neighbours)""", B.UNITS, NEIGHBOURS)  # fmt: skip

ORIGINS = ["approved", "review", "correction", "presentation", "history"]
matches = lambda s, d: catalog.table(s, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.element_at(F.array(*map(F.lit, ORIGINS)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("origin"), F.concat(F.lit("t"), (F.col("l_partkey") % 3).cast("string")).alias("target"), (0.9 + F.col("l_discount")).alias("confidence"), (F.col("l_linenumber") % 2 == 1).alias("exact"), (F.col("l_partkey") % 2 + 1).cast("int").alias("words"))
MATCHES = f"matches AS (SELECT l_orderkey AS q, {ORIGINS!r}[l_suppkey % 5 + 1] AS origin, 't' || (l_partkey % 3) AS target, 0.9 + l_discount AS confidence, l_linenumber % 2 = 1 AS exact, l_partkey % 2 + 1 AS words, CASE l_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS rank FROM lineitem)"
add("w11_margin_choice", lambda s, d: M.choose(matches(s, d)).select("q", "origin", F.round("confidence", 6).alias("confidence"), "conflict"),
    """SELECT q, arg_min(origin, (-rank, -confidence, target)) AS origin, round(arg_min(confidence, (-rank, -confidence, target)), 6) AS confidence, count(DISTINCT CASE WHEN rank >= best THEN target END) > 1 AS conflict
    FROM (SELECT *, max(rank) OVER (PARTITION BY q) AS best FROM (SELECT *, max(confidence) OVER (PARTITION BY q) AS top FROM matches) WHERE top - confidence < 0.06) GROUP BY q""", MATCHES)  # fmt: skip
add("l03_match_order", lambda s, d: matches(s, d).withColumn("rank", M.rank_of(F.col("origin"), M.ORIGIN_RANK)).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("confidence"), F.desc("rank"), "target", "words"))).where("r <= 2").select("q", F.col("r").cast("long").alias("r"), "target", "rank"), "SELECT q, r, target, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, rank DESC, target, words) AS r FROM matches) WHERE r <= 2", MATCHES)
SENT = "known_s AS (SELECT DISTINCT " + B.exact("sentence") + " AS k FROM memory)"
add("j19_sentence_memory", lambda s, d: M.sentences_known(catalog.units(s, d).select((F.col("doc_id") * 10_000 + F.col("line_no")).alias("unit_id"), "text"), catalog.memory(s, d)),
    f"""SELECT unit_id, count(*) AS sentences, count(k) AS found, count(k) = count(*) AS complete FROM (SELECT doc_id * 10000 + line_no AS unit_id, unnest(string_split(text, '. ')) AS x FROM units) LEFT JOIN known_s ON k = {B.exact('x')} WHERE trim(x) <> '' GROUP BY unit_id HAVING count(k) > 0""", B.UNITS, B.MEMORY, SENT)
TOPQ = "q AS (SELECT doc_id AS q, text AS q_text FROM units WHERE line_no = 0)"
add("j20_style_examples", lambda s, d: M.style_examples(catalog.units(s, d).where("line_no = 0").select(F.col("doc_id").alias("q"), F.col("text").alias("q_text")), pair_sample(s, d)).select("q", "e", F.round("overlap", 6).alias("overlap"), F.col("r").cast("long").alias("r")),
    f"""SELECT q, e, round(o, 6) AS overlap, r FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o DESC, e) AS r FROM (SELECT q, e, len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS o
      FROM (SELECT q, list_distinct({B.tokens('q_text')}) AS a FROM q), (SELECT e, list_distinct({B.tokens('e_text')}) AS b FROM entries) WHERE len(a) > 0 AND len(b) > 0) WHERE o >= 0.3) WHERE r <= 2""", B.UNITS, B.MEMORY, ENTRIES, TOPQ)  # fmt: skip
add("fil04_segment_search", lambda s, d: M.search_segments(catalog.pairs(s, d), "Than", 25).select("conv_id", "turn"), "SELECT conv_id, turn FROM pairs WHERE contains(lower(source), 'than') OR contains(lower(target), 'than') ORDER BY conv_id, turn LIMIT 25", B.PAIRS)
add("u03_u05_history_union", lambda s, d: M.history(("history", catalog.pairs(s, d)), ("approved", catalog.pairs(s, d).where("conv_id % 2 = 0")), ("memory", known(s, d))).groupBy("origin").agg(F.count("*").alias("n")), "SELECT origin, count(*) AS n FROM (SELECT DISTINCT source, target, 'history' AS origin FROM pairs UNION ALL SELECT DISTINCT source, target, 'approved' FROM pairs WHERE conv_id % 2 = 0 UNION ALL SELECT DISTINCT source, target, 'memory' FROM known) GROUP BY origin", B.PAIRS, B.UNITS, KNOWN)

#: Two language sides: lines of even and odd length.
sided = lambda s, d: catalog.units(s, d).withColumn("side", F.when(F.length("text") % 2 == 0, "a").otherwise("b"))
SIDED = "sided AS (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM units)"
add("w06_scopes", lambda s, d: A.scopes(catalog.units(s, d), F.when(F.length("text") % 2 == 0, "a").otherwise("b"), F.when(F.col("line_no") % 4 == 1, F.substring("text", 1, 1))).select("doc_id", "line_no", "side", "scope"),
    """SELECT doc_id, line_no, side, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, side ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'general') AS scope
    FROM (SELECT *, CASE WHEN model IS NOT NULL THEN model || '#' || count(*) OVER (PARTITION BY doc_id, side, model ORDER BY line_no) END AS mark FROM (SELECT *, CASE WHEN line_no % 4 = 1 THEN substr(text, 1, 1) END AS model FROM sided))""", B.UNITS, SIDED)  # fmt: skip
stepped = lambda s, d: sided(s, d).withColumn("text", F.concat(((F.col("line_no") / 2).cast("int") + 1).cast("string"), F.lit(". "), "text"))
STEPPED = "stepped AS (SELECT *, CAST(line_no // 2 + 1 AS VARCHAR) AS step FROM sided)"
add("j06_step_pairs", lambda s, d: A.step_pairs(stepped(s, d), ["doc_id"]), "SELECT doc_id, step, a.l AS a_line, b.l AS b_line FROM (SELECT doc_id, step, min(line_no) AS l FROM stepped WHERE side = 'a' GROUP BY 1, 2 HAVING count(*) = 1) a JOIN (SELECT doc_id, step, min(line_no) AS l FROM stepped WHERE side = 'b' GROUP BY 1, 2 HAVING count(*) = 1) b USING (doc_id, step)", B.UNITS, SIDED, STEPPED)
add("j07_adjacent_pairs", lambda s, d: A.adjacent_pairs(sided(s, d)),
    """SELECT doc_id, line_no AS first, mate AS second FROM (SELECT *, row_number() OVER w AS "at", lead(line_no) OVER w AS mate FROM (SELECT *, sum(CASE WHEN p <> side THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run
      FROM (SELECT *, lag(side) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM sided)) WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no)) WHERE "at" % 2 = 1 AND mate IS NOT NULL""", B.UNITS, SIDED)  # fmt: skip
add("j08_block_pairs", lambda s, d: A.block_pairs(sided(s, d)).withColumn("at", F.col("at").cast("long")),
    """SELECT doc_id, a."at" AS "at", a.line_no AS a_line, b.line_no AS b_line FROM (SELECT * FROM r WHERE side = 'a') a JOIN (SELECT * FROM r WHERE side = 'b') b USING (doc_id, "at")
    WHERE doc_id IN (SELECT doc_id FROM r GROUP BY doc_id HAVING sum(change) = 1 AND count(*) FILTER (side = 'a') = count(*) FILTER (side = 'b'))""",
    B.UNITS, SIDED, "r AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY doc_id ORDER BY line_no) <> side THEN 1 ELSE 0 END AS change, row_number() OVER (PARTITION BY doc_id, side ORDER BY line_no) AS \"at\" FROM sided)")
add("j27_left_over_pairs", lambda s, d: A.left_over_pairs(sided(s, d), ["doc_id"]), "SELECT doc_id, min(line_no) FILTER (side = 'a') AS a_line, min(line_no) FILTER (side = 'b') AS b_line FROM sided GROUP BY doc_id HAVING count(*) FILTER (side = 'a') = 1 AND count(*) FILTER (side = 'b') = 1", B.UNITS, SIDED)
add("j25_stitched", lambda s, d: A.stitched(sided(s, d)), "SELECT doc_id, line_no, trim(text) || ' ' || trim(nt) AS joined FROM (SELECT *, lead(text) OVER w AS nt, lead(side) OVER w AS ns FROM sided WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE ns = side AND length(text) <= 60 AND length(nt) <= 60", B.UNITS, SIDED)
points = lambda s, d: catalog.table(s, d, "events").select((F.col("event_id") % 50).alias("k"), (F.col("value") * 10).cast("int").alias("pos")).distinct()
spans = lambda s, d: catalog.table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("k"), (F.col("o_custkey") % 400).cast("int").alias("start"), (F.col("o_custkey") % 400 + F.col("o_orderkey") % 90 + 1).cast("int").alias("end"), F.col("o_orderkey").alias("name"))
add("j18_interval_join", lambda s, d: A.containing(points(s, d), spans(s, d), ["k"], 64),
    """SELECT k, pos, name FROM (SELECT p.k, p.pos, s.name, row_number() OVER (PARTITION BY p.k, p.pos ORDER BY s.e - s.b, s.b, s.name) AS r
    FROM (SELECT DISTINCT event_id % 50 AS k, CAST(trunc(value * 10) AS INTEGER) AS pos FROM events) p JOIN (SELECT o_orderkey % 50 AS k, o_custkey % 400 AS b, o_custkey % 400 + o_orderkey % 90 + 1 AS e, o_orderkey AS name FROM orders) s ON s.k = p.k AND p.pos >= s.b AND p.pos < s.e) WHERE r = 1""")  # fmt: skip
edits = lambda s, d: catalog.units(s, d).where("line_no % 7 = 1").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 10_000 + F.col("line_no")).alias("id"), F.when(F.col("doc_id") % 2 == 1, T.exact_key(F.col("text"))).alias("text_key"), F.concat(F.lit(">"), F.substring("text", 1, 9)).alias("edited"))
EDITS = f"edits AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id * 10000 + line_no END AS id, CASE WHEN doc_id % 2 = 1 THEN {B.exact('text')} END AS text_key, '>' || substr(text, 1, 9) AS edited FROM units WHERE line_no % 7 = 1)"
add("j14_edit_overlay", lambda s, d: A.overlay(catalog.units(s, d).select((F.col("doc_id") * 10_000 + F.col("line_no")).alias("unit_id"), "text"), edits(s, d), "unit_id", "text").select("unit_id", F.md5("final").alias("final"), "edited"),
    f"""SELECT unit_id, md5(coalesce(i.e, t.e, text)) AS final, i.e IS NOT NULL OR t.e IS NOT NULL AS edited FROM (SELECT doc_id * 10000 + line_no AS unit_id, text FROM units) u LEFT JOIN (SELECT id, max(edited) AS e FROM edits WHERE id IS NOT NULL GROUP BY id) i ON i.id = u.unit_id
    LEFT JOIN (SELECT text_key, max(edited) AS e FROM edits WHERE id IS NULL AND text_key IS NOT NULL GROUP BY text_key) t ON t.text_key = {B.exact('u.text')}""", B.UNITS, EDITS)  # fmt: skip
RANGES = ["1-5, 8", "10 - 12", "3", "9-7;2", "0-2", "abc", "", "99990-100020", "4, 4, 4-5"]
add("fil29_slide_range", lambda s, d: s.createDataFrame([(r,) for r in RANGES], "expression string").select("expression", F.explode_outer(A.slide_range(F.col("expression"), F.lit(9999))).alias("slide")).join(catalog.table(s, d, "documents").select(F.col("doc_id").cast("int").alias("slide")), "slide", "left_semi").select("expression", "slide"),
    "SELECT DISTINCT expression, CAST(doc_id AS INTEGER) AS slide FROM (VALUES ('1-5, 8', 1, 5), ('1-5, 8', 8, 8), ('10 - 12', 10, 12), ('3', 3, 3), ('9-7;2', 7, 9), ('9-7;2', 2, 2), ('0-2', 1, 2), ('4, 4, 4-5', 4, 5)) v(expression, a, b) JOIN documents ON doc_id BETWEEN a AND b")
GLOSSARY = [{"term": "that with", "priority": 2}, {"term": "that"}, {"term": "the"}, {"term": "thion"}, {"term": "la"}, {"term": "der"}, {"term": "an of"}]
QUERIES["j01_term_matches"] = lambda s, d: A.matched_terms(catalog.units(s, d).select((F.col("doc_id") * 10_000 + F.col("line_no")).alias("unit_id"), "text"), GLOSSARY, "unit_id", "text").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("key").alias("units"))
_MATCH = r"(?i)\b(?:that\s+with|an\s+of|thion|that|the|der|la)(?:es|s)?\b"
ORACLES["j01_term_matches"] = B.with_(B.UNITS) + rf"""
SELECT term, count(*) AS n, count(DISTINCT unit) AS units FROM (
  SELECT unit, CASE WHEN regexp_matches(m, '^that\s') THEN 'that with' WHEN regexp_matches(m, '^an\s') THEN 'an of' WHEN starts_with(m, 'thion') THEN 'thion' WHEN starts_with(m, 'that') THEN 'that' WHEN starts_with(m, 'the') THEN 'the' WHEN starts_with(m, 'der') THEN 'der' ELSE 'la' END AS term
  FROM (SELECT doc_id * 10000 + line_no AS unit, unnest(list_transform(regexp_extract_all(replace(regexp_replace(text, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', 'q', 'g'), '_', ' '), '{_MATCH}'), lambda x: lower(x))) AS m FROM units)) GROUP BY term"""
add("j01_candidates", lambda s, d: catalog.units(s, d).crossJoin(F.broadcast(s.createDataFrame([(g["term"],) for g in GLOSSARY], "term string"))).where(F.lower("text").contains(F.col("term"))).groupBy("term").agg(F.count("*").alias("units")), "SELECT term, count(*) AS units FROM units, (VALUES " + ", ".join(f"('{g['term']}')" for g in GLOSSARY) + ") v(term) WHERE contains(lower(text), term) GROUP BY term", B.UNITS)
add("j21_relevant_terms", lambda s, d: catalog.units(s, d).join(F.broadcast(s.createDataFrame([(g["term"],) for g in GLOSSARY], "term string")), F.lower("text").contains(F.col("term"))).select("doc_id", "term").distinct(), "SELECT DISTINCT doc_id, term FROM units JOIN (VALUES " + ", ".join(f"('{g['term']}')" for g in GLOSSARY) + ") v(term) ON contains(lower(text), term)", B.UNITS)
add("j13_expected_outputs", lambda s, d: catalog.memory(s, d).select("item_id", "sentence_no", T.exact_key(F.col("sentence")).alias("k")).join(queries_of(s, d).select(T.exact_key(F.col("q_text")).alias("k"), F.lit(True).alias("hit")).distinct(), "k", "left").select("item_id", "sentence_no", F.coalesce("hit", F.lit(False)).alias("found")), f"SELECT item_id, sentence_no, {B.exact('sentence')} IN (SELECT {B.exact('q_text')} FROM questions) AS found FROM memory", B.UNITS, B.MEMORY, QUESTIONS)
add("u04_merged_pairs", lambda s, d: M.history(("explicit", catalog.pairs(s, d).where("conv_id % 3 = 0"))).select("source", "target").unionByName(catalog.pairs(s, d).where("conv_id % 3 <> 0").join(catalog.pairs(s, d).where("conv_id % 3 = 0").select("source").distinct(), "source", "left_anti").select("source", "target").distinct()).groupBy(F.length("source").cast("long").alias("len")).agg(F.count("*").alias("n")), "SELECT length(source) AS len, count(*) AS n FROM (SELECT DISTINCT source, target FROM pairs WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT source, target FROM pairs WHERE conv_id % 3 <> 0 AND source NOT IN (SELECT source FROM pairs WHERE conv_id % 3 = 0)) GROUP BY 1", B.PAIRS)


def routing(s, d):
    rows = bulleted(s, d).withColumn("unit_id", F.struct("doc_id", "line_no"))
    pairs = rows.where("doc_id % 7 = 0 and line_no = 1").select("unit_id", F.lit("there").alias("existing"))
    memory = known(s, d).select("source", "target")
    return C.routed(rows.select("unit_id", "text"), memory, pairs, "en").groupBy("route").agg(F.count("*").alias("n"))


QUERIES["prj03_routing"] = routing
