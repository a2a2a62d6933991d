"""Queries of concise mode, compliance, post-flight repair and document readers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import language as L
from ..functions import terms as X
from ..functions import vocabulary as V
from ..operators import align as A
from ..operators import compliance as K
from ..operators import concise as S
from ..operators import quality as Q
from ..operators import readers as R
from ..operators import slides as SL
from . import base as B
from . import language_queries as LQ

QUERIES, ORACLES = {}, {}

#: Instructions and translations, beside the lines of documents.
CASES = [
    ("Kiểm tra đường may cách biên 2 mm, mật độ 8-9 mũi/inch theo QA manual.", "Check the seam 2 mm from the edge, 8 - 9 stitches/inch, by the QA manual."),
    ("Không được đứt chỉ, nổi chỉ, bỏ mũi, lệch biên khi may mũi giày", "No broken thread, loose thread at the toe"),
    ("Ép đế với lực 3.5kg/cm² trong 12 s ở 60°C nhưng không lem keo", "Press the sole at 3.5 kg for 12 s at 60 °C"),
    ("Sau khi quét keo lần hai lên đế giữa thì để khô trong khoảng thời gian quy định của dây chuyền sản xuất này", "Apply cement on the midsole and let it dry"),
    ("Chấp nhận mức độ nhăn nhẹ ở gót theo ISO 9001 và PFC hiện hành của nhà máy, không chấp nhận mức nặng hơn", "Light wrinkles at the heel are accepted (ISO 9001, PFC)"),
    ("SPI 10-12, collar lining, tip quarter, heel counter, in 5 in", "10-12 collar lining tip quarter heel counter"),
]
_rows = ", ".join(f"(CAST(-1 AS BIGINT), {i}, '{a}', '{b}')" for i, (a, b) in enumerate(CASES))
PAIRED = f"paired AS (SELECT conv_id AS k, CAST(turn AS INTEGER) AS i, source, target FROM pairs UNION ALL SELECT * FROM (VALUES {_rows}) v(k, i, source, target))"


def paired(s, d):
    cases = s.createDataFrame([(-1, i, *c) for i, c in enumerate(CASES)], "k long, i int, source string, target string")
    return catalog.pairs(s, d).select(F.col("conv_id").alias("k"), F.col("turn").cast("int").alias("i"), "source", "target").union(cases)


def add(name: str, query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (B.with_(*ctes) if ctes else "") + sql


def found(s, d):
    return paired(s, d).withColumn("found", S.entities(F.col("source")))


_N = lambda kind: F.size(F.filter("found", lambda x: x["type"] == kind)).alias(kind)
_MEASURE = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:mm|cm|m|s|sec|seconds?|°C|°F|kg(?:/cm(?:²|2)?)?|%|inch|in\b)"
_SPAN = r"(?i)\b(?:SPI\s*)?(\d+)\s*[-–]\s*(\d+)\s*(?:stitches?/inch|mũi/inch|SPI|mũi)?"
_names = lambda words, c: "(" + " + ".join(f"CAST(contains(lower({c}), '{w}') AS INTEGER)" for w in words) + ")"
_PARTS = list(dict.fromkeys([*V.COMPONENTS_VI, *V.COMPONENTS_EN]))
_standard = " + ".join(rf"len(list_distinct(list_transform(regexp_extract_all(source, '(?i)\b{p}\b'), lambda v: lower(regexp_replace(v, '[\s-]', '', 'g')))))" for p in V.STANDARDS)
COUNTED = rf"""counted AS (
  SELECT *, len(list_distinct(list_transform(regexp_extract_all(source, '{_MEASURE}'), lambda v: lower(regexp_replace(v, '\s+', '', 'g'))))) AS measurement,
    len(list_distinct(list_transform(regexp_extract_all(source, '{_SPAN}'), lambda v: regexp_extract(v, '{_SPAN}', 1) || '-' || regexp_extract(v, '{_SPAN}', 2)))) AS range,
    {_names(_PARTS, "source")} AS component, {_names(V.DEFECTS, "source")} AS defect, {_standard} AS standard,
    len(list_filter(list_slice(regexp_split_to_array(source, '[,;]'), 2, -2), lambda x: regexp_matches(x, '(?i)^\s*(?:không\s+)?[a-z{B.MARKED}\s]{{3,25}}$'))) AS listed,
    len(regexp_extract_all(source, '(?i)\b(?:nếu|trong trường hợp|khi|nhưng|ngoại trừ|chấp nhận|tolera|accept)\b')) AS condition, trim(regexp_replace(source, '\s+', ' ', 'g')) AS bare
  FROM paired
), scored AS (
  SELECT *, least(100, 10 * measurement + 5 * range + 15 * defect + 20 * listed + 8 * standard + 12 * condition) AS complexity FROM counted
)"""
add("a19_complexity", lambda s, d: found(s, d).select("k", "i", *(_N(x) for x in ("measurement", "range", "component", "defect", "standard")), S.complexity(F.col("source"), F.col("found")).alias("complexity")), "SELECT k, i, CAST(measurement AS INTEGER) AS measurement, CAST(range AS INTEGER) AS range, component, defect, CAST(standard AS INTEGER) AS standard, CAST(complexity AS INTEGER) AS complexity FROM scored", B.PAIRS, PAIRED, COUNTED)
add("fil26_concise_mode", lambda s, d: found(s, d).select("k", "i", S.eligibility(F.col("source"), F.col("found")).alias("mode")), """SELECT k, i, CASE WHEN length(bare) < 30 THEN 'too short' WHEN complexity >= 65 THEN 'complex' WHEN defect >= 3 THEN 'defect list'
  WHEN regexp_matches(bare, '(?i)chấp nhận mức độ|tiêu chuẩn chấp nhận|accept.*QA') THEN 'acceptance clause' WHEN length(bare) < 80 THEN 'short enough' ELSE 'eligible' END AS mode FROM scored""", B.PAIRS, PAIRED, COUNTED)  # fmt: skip


def kept(s, d):
    rows = found(s, d).withColumn("lost", S.missing(F.col("target"), F.col("found")))
    return rows.select("k", "i", S.coverage(F.col("found"), F.col("lost")).alias("coverage"), S.rolls_back(F.col("lost")).alias("rollback"))


_low = "trim(regexp_replace(lower(target), '\\s+', ' ', 'g'))"
_or = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_lost_parts = " + ".join(f"CAST(contains(lower(source), '{w}') AND NOT {_or([*V.COMPONENTS_AS_EN.get(w, []), w])} AS INTEGER)" for w in _PARTS)
_lost_defects = " + ".join(f"CAST(contains(lower(source), '{w}') AND NOT {_or(V.DEFECTS_EN[w]) if w in V.DEFECTS_EN else 'FALSE'} AS INTEGER)" for w in V.DEFECTS)
_lost_standards = " + ".join(rf"len(list_filter(list_distinct(regexp_extract_all(source, '(?i)\b{p}\b')), lambda v: NOT contains(low, lower(regexp_replace(v, '[\s-]', '', 'g'))) AND NOT contains(low, lower(v))))" for p in V.STANDARDS)
add("a20_entity_coverage", kept, rf"""
SELECT k, i, CAST(CASE WHEN n = 0 THEN 100 ELSE floor((n - critical - parts) * 100.0 / n + 0.5) END AS INTEGER) AS coverage, critical > 0 AS rollback FROM (
  SELECT k, i, measurement + range + component + defect + standard AS n, {_lost_parts} AS parts, {_lost_defects} + {_lost_standards}
    + len(list_filter(list_distinct(list_transform(regexp_extract_all(source, '{_MEASURE}'), lambda v: lower(regexp_replace(v, '\s+', '', 'g')))), lambda v: NOT contains(low, regexp_extract(v, '\d+(?:[.,]\d+)?'))))
    + len(list_filter(list_distinct(list_transform(regexp_extract_all(source, '{_SPAN}'), lambda v: regexp_extract(v, '{_SPAN}', 1) || '-' || regexp_extract(v, '{_SPAN}', 2))), lambda v: NOT (contains(low, v) OR contains(low, replace(v, '-', ' - ')) OR contains(low, replace(v, '-', ' to '))))) AS critical
  FROM (SELECT *, {_low} AS low FROM scored))""", B.PAIRS, PAIRED, COUNTED)  # fmt: skip
add("f27_prompt_lines", lambda s, d: found(s, d).select("k", "i", F.size(F.split(S.must_keep(F.col("found")), ", ")).alias("lines"), (S.must_keep(F.col("found")) == "").alias("none")).where("k >= 0"), "SELECT k, i, CAST(greatest(1, least(12, measurement + range + component + defect + standard)) AS INTEGER) AS lines, measurement + range + component + defect + standard = 0 AS none FROM scored WHERE k >= 0", B.PAIRS, PAIRED, COUNTED)

# --- pairs of texts
_STEP = r"(?i)^(?:[*•#]\s*)?(?:(?:ct[qp]|step|item|stt|no|bước|mục)\s*)?#?(\d{1,3})[.)\-:]"
_MEASURED = r"(?i)\b\d+(?:[.,]\d+)?(?:\s*(?:%|mm|cm|m|kg|g|spi|bar|psi|°c|°f|s|sec|min|h|hrs?))?\b"
_nums = lambda t, step: rf"list_filter(list_transform(regexp_extract_all({t}, '{_MEASURED}'), lambda v: regexp_replace(lower(v), '\s+', '', 'g')), lambda v: v <> {step} AND NOT regexp_matches(v, '^\d{{1,2}}$'))"
_weak = LQ.listed(V.WEAK_WORDS)
_content = lambda t: rf"list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda v: length(v) >= 3 AND v NOT IN ({_weak}))"
#: Both texts of each pair with their language, the guards, and the words they share.
GUARDED = (
    PAIRED,
    "lines AS (SELECT k AS doc_id, i AS line_no, 'a' AS kind, 0 AS i, source AS text FROM paired UNION ALL SELECT k, i, 'b', 0, target FROM paired)",
    LQ.EVIDENCE,
    rf"""sides AS (
  SELECT a.doc_id AS k, a.line_no AS i, a.text AS a, b.text AS b, a.vietnamese AS va, b.vietnamese AS vb, CASE WHEN a.vietnamese THEN a.text ELSE b.text END AS vi, CASE WHEN a.vietnamese THEN b.text ELSE a.text END AS en
  FROM g a JOIN g b USING (doc_id, line_no) WHERE a.kind = 'a' AND b.kind = 'b'
), steps AS (
  SELECT *, regexp_extract(vi, '{_STEP}', 1) AS sv, regexp_extract(en, '{_STEP}', 1) AS se, regexp_extract(a, '{_STEP}', 1) AS sa, regexp_extract(b, '{_STEP}', 1) AS sb FROM sides
), measured AS (
  SELECT *, {_nums("vi", "sv")} AS nv, {_nums("en", "se")} AS ne, {_nums("a", "sa")} AS na, {_nums("b", "sb")} AS nb, {_content("a")} AS wa, {_content("b")} AS wb FROM steps
), guarded AS (
  SELECT *, CASE WHEN a = '' OR b = '' THEN 'empty' WHEN va = vb THEN 'same language' WHEN regexp_matches(vi, '^[*•#]') <> regexp_matches(en, '^[*•#]') THEN 'heading' WHEN sv <> '' AND se <> '' AND sv <> se THEN 'step'
    WHEN (sv = '') <> (se = '') AND (regexp_matches(vi, '^[*•#]') OR regexp_matches(vi, '(?i)strategy|focus|tiêu điểm|trọng điểm|quy trình|tiêu chuẩn') OR regexp_matches(en, '(?i)strategy|focus|focuses|process|procedure|standard|title|manual')) THEN 'numbered against title'
    WHEN len(nv) > 0 AND len(ne) > 0 AND NOT list_has_any(nv, ne) AND (len(nv) >= 2 OR len(ne) >= 2) THEN 'numbers' END AS guard,
    len(list_filter(wa, lambda p: len(list_filter(wb, lambda w: contains(w, p) OR contains(p, w))) > 0)) AS shared, least(len(wa), len(wb)) AS fewest FROM measured
)""",
)
add("j10_guarded_pairs", lambda s, d: paired(s, d).select("k", "i", L.pair_guards(F.col("source"), F.col("target")).alias("guard")), "SELECT k, i, guard FROM guarded", B.PAIRS, *GUARDED)


def semantic(s, d):
    """The sources themselves are the drafts."""
    rows = paired(s, d).withColumn("p", L.semantic_pair(F.col("source"), F.col("target"), F.col("source"), F.lit(0)))
    return rows.select("k", "i", "p.is_pair", "p.confidence", "p.reason")


_ratio = "CASE WHEN fewest > 0 THEN shared::DOUBLE / fewest ELSE 0 END"
_same, _both = "sa <> '' AND sa = sb", "list_has_any(na, nb)"
add("j12_pair_verdict", semantic, f"""
SELECT k, i, reason IN ('words', 'step') AS is_pair, CAST(CASE reason WHEN 'words' THEN 0.88 WHEN 'step' THEN 0.85 WHEN 'length' THEN 0.1 WHEN 'no overlap' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS confidence, reason FROM (
  SELECT k, i, CASE WHEN guard IS NOT NULL THEN guard WHEN least(length(a), length(b)) < 0.35 * greatest(length(a), length(b)) AND NOT ({_same}) THEN 'length' WHEN shared >= 2 AND {_ratio} >= 0.35 THEN 'words'
    WHEN {_same} AND ({_both} OR shared >= 2 OR (greatest(length(a), length(b)) <= 30 AND shared >= 1)) THEN 'step' ELSE 'no overlap' END AS reason FROM guarded)""", B.PAIRS, *GUARDED)  # fmt: skip

# --- instructions, names, slides
INSTRUCTED = [
    ("2. Kiểm tra khe hở 5 mm", "2. Check with gauge"), ("Ép 3 kg", "3. Press."), ("không vượt quá 3 mm", "3 mm"), ("tối đa 2 cm", "at most 2 cm"), ("Kiểm tra mũi", "Check if the toe"), ("Kiểm tra mũi", "Check if the toe is even"),
    ("có hở keo không?", "Bond gap"), ("Đối với SB-12", "For SB-12 with cutting die"), ("x", "Check if the upper match the mold"), ("x", "The seam is not stitch well"), ("x", "Check if no gap between the parts here"),
]
_ins = ", ".join(f"(CAST(-2 AS BIGINT), {i}, '{a}', '{b}')" for i, (a, b) in enumerate(INSTRUCTED))
_body = r"trim(regexp_replace(trim(target), '(?i)^(?:[*•#]\s*)?(?:(?:step|bước|item|ctq)\s*)?\d+(?:\.\d+)?[.):\-]\s*', ''))"
_asked = _body.replace("target", "source")
_measures = lambda c: rf"list_transform(regexp_extract_all(regexp_replace(replace(regexp_replace(lower({c}), '\+\s*[-−]\s*', '±', 'g'), ',', '.'), 'mũi\s*/\s*inch', 'stitches/inch', 'g'), '(?:[±+\-−]\s*)?\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\s*(?:stitches\s*/\s*inch|kg\s*/\s*cm[²2]|mm|cm|kg|n\b|°\s*c|%)'), lambda v: replace(replace(regexp_replace(v, '\s+', '', 'g'), '–', '-'), '²', '2'))"
_finite = r"\b(?:is|are|has|have|does|do|can|must|should|will|remains?|matches?|fits?|aligns?|exceeds?|meets?|follows?|shows?|covers?|contains?|overlaps?|passes?|stays?|lies?|sits?|reaches?|touches?|looks?|feels?)\b"
_m = lambda c, p: f"regexp_matches({c}, '(?i){p}')"


def instructed(s, d):
    more = s.createDataFrame([(-2, i, *c) for i, c in enumerate(INSTRUCTED)], "k long, i int, source string, target string")
    return paired(s, d).union(more)


add("a22_instruction_quality", lambda s, d: instructed(s, d).select("k", "i", F.array_join(Q.instruction_issues(F.col("source"), F.col("target")), ",").alias("issues")), rf"""
SELECT k, i, concat_ws(',', CASE WHEN {_m(r"trim(regexp_replace(regexp_replace(trim(target), '^\s*(?:\d+(?:\.\d+)?[.):\-]\s*)', ''), '[.!?:;]+$', ''))", r"^(?:check(?:\s+if)?|inspect|verify|ensure|accept|place|attach|apply|stitch|sew|press|avoid)$")} THEN 'incomplete_instruction' END,
  CASE WHEN {_m("body", r"\bcheck\s+with\b")} OR (({_m("asked", r"^kiểm\s+tra\b")} OR {_m("asked", r"(?:^|\s)có\s+.+\s+không[?.!]?$")}) AND NOT opens) THEN 'check_if_required' END,
  CASE WHEN (opens AND (clause = '' OR (NOT {_m("clause", _finite)} AND (len(regexp_extract_all(clause, '\p{{L}}+')) <= 3 OR {_m("clause", r"^(?:the\s+)?(?:consistent|correct|no|free\s+of)\b")} OR {_m("clause", r"\b(?:attached|aligned|positioned|centered|pressed|stitched|bonded)\b")}))))
    OR {_m("body", r"\b(?:isn['’]t|is\s+not|aren['’]t|are\s+not)\s+(?:align|attach|stitch)\b".replace("'", "''"))} OR {_m("body", r"\b(?:must\s+edge-even|with\s+be\s+at\s+center|is\s+not\s+scratch\b)")} OR {_m("body", r"^check\s+if\s+(?:the\s+)?(?:upper|mold|machine|tool|part)\s+match\b")} OR {_m("body", r"^check\s+if\s+(?:the\s+)?(?:real\s+temp|temperature)\s+\d+")} THEN 'incomplete_condition' END,
  CASE WHEN len(list_filter({_measures("source")}, lambda v: NOT list_contains({_measures("target")}, v))) > 0 THEN 'missing_measurement' END,
  CASE WHEN {_m("source", r"không\s+(?:vượt|quá)|tối\s+đa")} AND NOT {_m("target", r"\b(?:not\s+exceed|no\s+more\s+than|at\s+most|maximum|up\s+to|within)\b|[≤<]=?")} THEN 'missing_restriction' END,
  CASE WHEN {_m("source", r"^\s*[*•#]?\s*(?:đối\s+với|dành\s+cho|áp\s+dụng\s+cho)\s+.*[A-Z0-9]+-[A-Z0-9]+")} AND {_m("target", r"\bcutting\s+die\b")} AND NOT {_m("source", "dao|khuôn")} THEN 'unsupported_operation' END) AS issues
FROM (SELECT *, {_m("body", r"^check\s+if\b")} AS opens, regexp_split_to_array(regexp_replace(body, '(?i)^check\s+if\s*', ''), '[,;.!?]')[1] AS clause FROM (SELECT *, {_body} AS body, {_asked} AS asked FROM (SELECT * FROM paired UNION ALL SELECT * FROM (VALUES {_ins}) v(k, i, source, target))))""", B.PAIRS, PAIRED)  # fmt: skip
add("f35_unique_names", lambda s, d: catalog.table(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("book")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_brand"))).alias("x")).select("book", F.posexplode(X.unique_names(F.col("x.p_brand"), " EN")).alias("i", "name")), "SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY p_partkey) - 1 AS INTEGER) AS i, p_brand || CASE WHEN r > 1 THEN ' ' || (r - 1) ELSE '' END || ' EN' AS name FROM (SELECT *, row_number() OVER (PARTITION BY book, p_brand ORDER BY p_partkey) AS r FROM (SELECT *, p_partkey // 50 AS book FROM part))")
SPLITS = [
    ("Final check\nKiểm tra cuối", False, "Final check", "Kiểm tra cuối"), ("1. Cut\n1. Cắt da\n2. Sew\n2. Khâu lại", False, "1. Cut\n2. Sew", "1. Cắt da\n2. Khâu lại"), ("Dán đế\nÉp đế\nAttach\nPress", False, "Attach\nPress", "Dán đế\nÉp đế"),
    ("Toe cap - Hình mũi", True, "Toe cap", "Hình mũi"), ("Toe cap - Hình mũi", False, None, None), ("CTQ 1 - Hình mũi", True, None, None), ("Packing wrongGiấy gói", True, "Packing wrong", "Giấy gói"), ("9-10", True, None, None), ("one\ntwo\nthree", False, None, None), ("Tip-quarter bị nhăn", True, None, None),
]


def splits(s, d):
    cases = s.createDataFrame([(-1, i, t, item) for i, (t, item, _, _) in enumerate(SPLITS)], "doc_id long, line_no int, text string, item boolean")
    rows = catalog.units(s, d).select("doc_id", "line_no", "text", F.lit(False).alias("item")).union(cases).withColumn("p", X.split_bilingual(F.col("text"), F.col("item")))
    return rows.select("doc_id", "line_no", "p.en", "p.vi")


_lit = lambda x: "NULL" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'"
add("f18_bilingual_split", splits, "SELECT doc_id, line_no, CAST(NULL AS VARCHAR) AS en, CAST(NULL AS VARCHAR) AS vi FROM units UNION ALL SELECT * FROM (VALUES " + ", ".join(f"(-1, {i}, {_lit(e)}, {_lit(v)})" for i, (_, _, e, v) in enumerate(SPLITS)) + ") x(doc_id, line_no, en, vi)", B.UNITS)


FORMS = [("the", "this", 0), ("the", "that", 1), ("der", "die", 0), ("la", "le", 0), ("la", "les", 1), ("la", "un", 2)]


def conflict_groups(s, d):
    rows = catalog.pairs(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("unit"), "source", "target")
    found = A.matched_terms(rows, [{"term": t} for t in dict.fromkeys(t for t, _, _ in FORMS)], "unit", "source").select(F.col("key").alias("unit"), "term")
    return Q.conflicts(rows, found, s.createDataFrame(FORMS, "term string, target string, rank int"))


#: Words of a text between ASCII boundaries: letters and digits of other scripts are one letter, underscores are none.
_ascii = lambda c: rf"replace(regexp_replace({c}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', 'q', 'g'), '_', ' ')"
_word = lambda c, w: rf"regexp_matches({c}, '(?i)\b{w}(?:s|es)?\b')"
_case = lambda f: " ".join(f"WHEN '{t}' THEN {f(t)}" for t in ("the", "der", "la"))
_others = {"the": ["that"], "der": [], "la": ["les", "un"]}
_preferred = {"the": "this", "der": "die", "la": "le"}
add("a05_conflict_groups", conflict_groups, rf"""
WITH {B.PAIRS}, u AS (SELECT conv_id * 100 + turn AS unit, {_ascii("source")} AS s, {_ascii("target")} AS t FROM pairs),
m AS (SELECT unit, term, t FROM u, (VALUES ('the'), ('der'), ('la')) v(term) WHERE CASE term {_case(lambda t: _word("s", t))} END),
r AS (SELECT unit, term, NOT CASE term {_case(lambda t: _word("t", _preferred[t]))} END AS lacks,
  CASE term {_case(lambda t: "list_filter([" + ", ".join(f"CASE WHEN {_word(chr(114) + 'est', a)} THEN '{a}' END" for a in _others[t]) + "]::VARCHAR[], lambda a: a IS NOT NULL)")} END AS found
  FROM (SELECT *, CASE term {_case(lambda t: f"regexp_replace(t, '(?i)" + chr(92) + f"b{_preferred[t]}(?:s|es)?" + chr(92) + "b', ' ', 'g')")} END AS rest FROM m))
SELECT term, CASE term WHEN 'the' THEN 'this' WHEN 'der' THEN 'die' ELSE 'le' END AS preferred, count(*) FILTER (lacks) AS missing, count(*) FILTER (len(found) > 0) AS variants, count(*) AS units, min(unit) AS first_unit,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(found)))), ','), '') AS candidates FROM r WHERE lacks OR len(found) > 0 GROUP BY term""")  # fmt: skip


def deck(s, d):
    """Documents as slides of decks of sixteen; the slide's own text is its draft."""
    rows = catalog.units(s, d)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id").agg(texts.alias("texts")).select((F.floor(F.col("doc_id") / 16)).alias("file"), F.col("doc_id").alias("slide"), "texts", F.array_join("texts", " ").alias("probe"))


_vn = lambda c: f"regexp_matches({c}, '[{B.MARKED}{B.MARKED.upper()}]')"
_lat = lambda c: f"(NOT {_vn(c)} AND regexp_matches({c}, '[a-zA-Z]{{2,}}'))"
_count = lambda test: f"CAST(len(list_filter(t, lambda x: {test})) AS INTEGER)"
PROFILES = rf"""decks AS (
  SELECT doc_id // 16 AS file, doc_id AS slide, list(text ORDER BY line_no) AS t FROM units GROUP BY doc_id
), profiled AS (
  SELECT file, slide, t, {_count(_vn("x"))} AS vi, {_count(_lat("x"))} AS en, {_count(_vn("x") + " AND length(trim(x)) >= 25")} AS vi_long, {_count(_lat("x") + " AND length(trim(x)) >= 25")} AS en_long,
    len(list_filter(t[1:6], lambda x: regexp_matches(x, '(?i)\b(?:\d+[._-]?)?EN\b|\[EN\]|\(EN\)'))) > 0 AS en_marker, len(list_filter(t[1:6], lambda x: regexp_matches(x, '(?i)\b(?:\d+[._-]?)?(?:VI|VN)\b|\[VI\]|\(VI\)'))) > 0 AS vi_marker,
    list_distinct(list_filter(flatten(list_transform(t[1:8], lambda x: [regexp_extract(x, '(?i)^\s*(?:(?:step|bước|ctq|sop|item|mục|trạm)\s*[:#]?\s*(\d+(?:\.\d+)?)|#?\s*(\d+(?:\.\d+)?)\s*(?:[.:\-/)]|\s*(?:en|vi|vn)\b))', 1), regexp_extract(x, '(?i)^\s*(?:(?:step|bước|ctq|sop|item|mục|trạm)\s*[:#]?\s*(\d+(?:\.\d+)?)|#?\s*(\d+(?:\.\d+)?)\s*(?:[.:\-/)]|\s*(?:en|vi|vn)\b))', 2), regexp_extract(x, '(?i)\b(\d+(?:\.\d+)?)\s*[._-]?\s*(?:EN|VI|VN)\b', 1)])), lambda x: x <> '')) AS steps
  FROM decks
)"""
add("a17_slide_profile", lambda s, d: SL.profiles(deck(s, d)).select("file", "slide", "vi", "en", "vi_long", "en_long", "en_marker", "vi_marker", "step", "is_en", "is_vi", F.round("vi_ratio", 6).alias("vi_ratio")), """
SELECT file, slide, vi, en, vi_long, en_long, en_marker, vi_marker, CASE WHEN len(steps) = 1 THEN steps[1] END AS step,
  CASE WHEN en_marker AND NOT vi_marker THEN TRUE WHEN en_long >= 2 AND en_long > vi_long * 2 THEN TRUE ELSE (vi = 0 AND (en * 1.0 / len(t) >= 0.2 OR en >= 1)) OR (en > vi AND (vi <= 1 OR vi * 1.0 / len(t) < 0.25)) END AS is_en,
  CASE WHEN vi_marker AND NOT en_marker THEN TRUE WHEN vi_long >= 2 AND vi_long > en_long THEN TRUE ELSE (vi >= 1 AND (vi * 1.0 / len(t) >= 0.2 OR vi >= en)) OR vi >= 2 END AS is_vi, round(vi * 1.0 / len(t), 6) AS vi_ratio FROM profiled""", B.UNITS, PROFILES)  # fmt: skip
QUERIES["j11_greedy_matching"] = lambda s, d: SL.pairs(deck(s, d))

# --- compliance
FINISHED = ["nosew film on the Tip quarter", "tip-quarter, 10 SPI", "Kiểm tra", "SPI 9-10 stitches/inch", "aplly cement foam", "Check with gauge", "Shape toe and shape collar", "8-9 stitches/inch", "*Spray cement and aplly foam", "the logo is printed together without matching", "quality standard tolerances are acceptable", "Dán đế ngoài", "quet keo de giua"]
_fin = ", ".join(f"(CAST(-1 AS BIGINT), {i}, '{c}')" for i, c in enumerate(FINISHED))
FIN = f"fin AS (SELECT doc_id, line_no, text FROM units UNION ALL SELECT * FROM (VALUES {_fin}) v(doc_id, line_no, text))"


def finished(s, d):
    return catalog.units(s, d).select("doc_id", "line_no", "text").union(s.createDataFrame([(-1, i, c) for i, c in enumerate(FINISHED)], "doc_id long, line_no int, text string"))


add("p11_compliance_tool", lambda s, d: finished(s, d).select("doc_id", "line_no", F.array_join(K.violations(F.col("text")), ",").alias("broken")), rf"""
SELECT doc_id, line_no, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\bnosew\b') THEN 'no-sew' END, CASE WHEN regexp_matches(text, '(?i)\btip\s*quarter\b') AND NOT regexp_matches(text, '(?i)\btip-quarter\b') THEN 'tip-quarter' END,
  CASE WHEN regexp_matches(text, '(?i)\b\d+\s*SPI\b') THEN 'spi' END, CASE WHEN regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]') THEN 'leak' END) AS broken FROM fin""", B.UNITS, FIN)  # fmt: skip
audited = lambda s, d: K.post_flight(finished(s, d))
reports = lambda s, d: K.report(audited(s, d), "doc_id")
#: Leaks of all lines, by the detector's SQL.
_LEAKS = LQ.EVIDENCE.replace("FROM lines", "FROM (SELECT doc_id, line_no, 'whole' AS kind, 0 AS i, text FROM fin)")
add("a27_post_flight", lambda s, d: reports(s, d).select("doc_id", "vi_leak", "passed"), "SELECT doc_id, CAST(count(*) FILTER (vietnamese AND length(text) > 5) AS BIGINT) AS vi_leak, count(*) FILTER (vietnamese AND length(text) > 5) = 0 AS passed FROM g GROUP BY doc_id", B.UNITS, FIN, _LEAKS)
add("a28_gate_merge", lambda s, d: K.merged(reports(s, d), catalog.table(s, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("issues")), "doc_id").select("doc_id", "gate_issues", "passed"), "SELECT doc_id, CAST(coalesce(max(issues), 0) AS BIGINT) AS gate_issues, count(*) FILTER (vietnamese AND length(text) > 5) = 0 AND coalesce(max(issues), 0) = 0 AS passed FROM g LEFT JOIN (SELECT doc_id, sum(toxic) AS issues FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY doc_id", B.UNITS, FIN, _LEAKS)


def repairs(s, d):
    rows = audited(s, d)
    return rows.select("doc_id", "line_no", F.array_join("types", ",").alias("types"), F.when(F.size("types") > 0, F.col("fixed")).alias("fixed")).where("doc_id = -1 or types <> ''")


_mended = [
    (0, "typo_repair", "no-sew film on the Tip-quarter"), (1, "invalid_spi", "tip-quarter, SPI 10 stitches/inch"), (2, "", None), (3, "", None), (4, "typo_repair", "attach cement foam"), (5, "translation_quality", "Check if gauge"),
    (6, "inverted_phrase", "Toe shape and Collar shape"), (7, "invalid_spi", "SPI 8-9 stitches/inch"), (8, "typo_repair", "*Spray cement and attach cement foam"), (9, "typo_repair", "logos can be used together without color matching"),
    (10, "typo_repair", "quality standard are acceptable"), (11, "", None), (12, "", None),
]
add("p12_post_flight_repair", repairs, "SELECT CAST(-1 AS BIGINT) AS doc_id, line_no, types, fixed FROM (VALUES " + ", ".join(f"({i}, '{t}', {'NULL' if f is None else repr(f)})" for i, t, f in _mended) + ") v(line_no, types, fixed)")

# --- readers: files are written from the tables' texts, and read back
PARA = lambda text, level: F.concat(F.lit("<w:p><w:pPr>"), F.when(level > 0, F.concat(F.lit('<w:pStyle w:val="Heading'), level.cast("string"), F.lit('"/>'))).otherwise(""), F.lit("</w:pPr><w:r><w:t>"), F.substring(text, 1, 7), F.lit('</w:t></w:r><w:r><w:t xml:space="preserve">'), F.substring(text, 8, 1 << 30), F.lit("</w:t></w:r></w:p>"))
plain = lambda c: F.regexp_replace(c, "[<>&]", " ")


def docx(s, d):
    """Documents as parts of word processor files: every fifth line is a heading."""
    rows = catalog.units(s, d).withColumn("level", F.when(F.col("line_no") % 5 == 2, F.col("line_no") % 3 + 1).otherwise(0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", plain(F.col("text")).alias("text"), "level"))), lambda x: PARA(x["text"], x["level"])), "")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("<w:document><w:body>"), body, F.lit("</w:body></w:document>")).alias("xml")).select(F.col("doc_id").cast("string").alias("file"), "xml")


_STRIP = r"regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '^\s+|\s+$', '', 'g')"
add("src04_heading_sections", lambda s, d: R.sections(R.docx_paragraphs(docx(s, d))).select("file", "section", "title", "level", F.md5("content").alias("content")), rf"""
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY n) AS INTEGER) AS section, title, level, md5(content) AS content FROM (
  SELECT file, n, coalesce(max(t) FILTER (head), 'Introduction') AS title, CAST(coalesce(max(line_no % 3 + 1) FILTER (head), 1) AS INTEGER) AS level, coalesce(string_agg(t, chr(10) ORDER BY line_no) FILTER (NOT head), '') AS content FROM (
    SELECT CAST(doc_id AS VARCHAR) AS file, line_no, {_STRIP} AS t, line_no % 5 = 2 AS head, count(*) FILTER (line_no % 5 = 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM units WHERE {_STRIP} <> ''
  ) GROUP BY file, n) WHERE content <> ''""", B.UNITS)  # fmt: skip
add("w13_section_numbers", lambda s, d: R.sections(R.docx_paragraphs(docx(s, d))).groupBy("file").agg(F.max("section").alias("sections")), "SELECT file, CAST(count(*) AS INTEGER) AS sections FROM (SELECT file, n FROM (SELECT CAST(doc_id AS VARCHAR) AS file, line_no % 5 = 2 AS head, " + _STRIP + " AS t, count(*) FILTER (line_no % 5 = 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM units WHERE " + _STRIP + " <> '') GROUP BY file, n HAVING bool_or(NOT head)) GROUP BY file", B.UNITS)


def pptx(s, d):
    """Pages as parts of presentations: a slide for every four runs, written in the order of nothing."""
    rows = catalog.runs(s, d).withColumn("slide", F.floor(F.col("run_no") / 4) + 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", plain(F.col("text")).alias("text")))), lambda x: F.concat(F.lit("<a:p><a:r><a:t>"), x["text"], F.lit("</a:t></a:r></a:p>"))), "")
    return rows.groupBy("page_id", "slide").agg(body.alias("xml")).select(F.col("page_id").cast("string").alias("file"), F.concat(F.lit("ppt/slides/slide"), F.col("slide").cast("string"), F.lit(".xml")).alias("path"), "xml")


add("src05_text_runs", lambda s, d: R.slides(pptx(s, d)).select("file", "slide", "title", F.size("texts").alias("texts"), F.md5("content").alias("content")), rf"""
SELECT file, CAST(slide AS INTEGER) AS slide, x[1] AS title, CAST(len(x) AS INTEGER) AS texts, md5(CASE WHEN len(x) > 1 THEN array_to_string(x[2:], chr(10)) ELSE x[1] END) AS content FROM (
  SELECT CAST(page_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY page_id ORDER BY run_no // 4) AS slide, list({_STRIP} ORDER BY run_no) FILTER ({_STRIP} <> '') AS x FROM runs GROUP BY page_id, run_no // 4) WHERE len(x) > 0""", B.RUNS)  # fmt: skip
add("src08_presentation_order", lambda s, d: R.slides(pptx(s, d)).groupBy("file").agg(F.max("slide").alias("slides"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide", "title"))), lambda x: F.substring(x["title"], 1, 5)), "|").alias("titles")), rf"""
SELECT file, CAST(max(slide) AS INTEGER) AS slides, string_agg(substr(x[1], 1, 5), '|' ORDER BY slide) AS titles FROM (
  SELECT CAST(page_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY page_id ORDER BY run_no // 4) AS slide, list({_STRIP} ORDER BY run_no) FILTER ({_STRIP} <> '') AS x FROM runs GROUP BY page_id, run_no // 4) WHERE len(x) > 0 GROUP BY file""", B.RUNS)  # fmt: skip


def pdf(s, d):
    """Documents as extracted texts: a form feed before every eighth line."""
    rows = catalog.units(s, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.concat(F.when(x["line_no"] % 8 == 7, "\f").otherwise(""), x["text"])), "\n")
    return rows.groupBy("doc_id").agg(text.alias("text")).select(F.col("doc_id").cast("string").alias("file"), "text")


_BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
PAGES = rf"""numbered AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, line_no, {_BARE} AS t, count(*) FILTER (line_no % 8 = 7) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM units
), paged AS (
  SELECT file, n, list(t ORDER BY line_no) FILTER (t <> '') AS x FROM numbered GROUP BY file, n HAVING count(*) FILTER (t <> '') > 0
)"""
add("a25_section_stats", lambda s, d: R.pages(pdf(s, d)).groupBy("file").agg(F.count("*").alias("pages"), F.sum(F.size("lines")).alias("lines"), F.first("scanned").alias("scanned"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "title"))), lambda x: x["title"]), "|").alias("titles")), r"""
SELECT file, count(*) AS pages, CAST(sum(len(x)) AS BIGINT) AS lines, any_value(scanned) AS scanned, string_agg(substr(x[1], 1, 60), '|' ORDER BY n) AS titles FROM paged
JOIN (SELECT CAST(doc_id AS VARCHAR) AS file, length(regexp_replace(string_agg(CASE WHEN line_no % 8 = 7 THEN chr(12) ELSE '' END || text, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g')) < 50 AS scanned FROM units GROUP BY doc_id) USING (file) GROUP BY file""", B.UNITS, PAGES)  # fmt: skip
DEFINED = ["Access control: Kiểm soát truy cập", "Back up - a second copy", "http link: x y", "ab: no", "Form = Biểu mẫu"]


def definitions(s, d):
    lines = R.pages(pdf(s, d)).select("file", "page", F.explode("lines").alias("text")).union(s.createDataFrame([("own", 1, x) for x in DEFINED], "file string, page int, text string"))
    return R.candidates(lines, confidence=0.75, least_target=3)


_CAND = r"^([A-Za-z0-9\s]{3,35})\s*[:\-=–—]\s*(.+)$"
add("src06_labelled_pairs", lambda s, d: definitions(s, d).select("file", "page", "source_term", "target_term", "confidence"), rf"""
SELECT file, CAST(page AS INTEGER) AS page, s AS source_term, t AS target_term, CAST(0.75 AS DOUBLE) AS confidence FROM (
  SELECT file, page, regexp_replace(regexp_extract(text, '{_CAND}', 1), '^\s+|\s+$', '', 'g') AS s, regexp_replace(regexp_extract(text, '{_CAND}', 2), '^\s+|\s+$', '', 'g') AS t FROM (
    SELECT file, page, unnest(x) AS text FROM (SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) AS page, x FROM paged)
    UNION ALL SELECT 'own', 1, unnest([{", ".join(repr(x) for x in DEFINED)}]))) WHERE length(s) > 2 AND length(t) > 2 AND NOT starts_with(lower(s), 'http')""", B.UNITS, PAGES)  # fmt: skip

HEADERS = {0: ["STT", "English", "Tiếng Việt", "Category"], 1: ["#", "Name", "Type", "Meaning"], 2: ["a", "b"], 3: ["no", "Target", "Term", "Context"]}


def grid(s, d):
    """Parts as four workbooks: with headers, without known ones, of two columns, and with swapped roles."""
    terms = catalog.terms(s, d).select("id", F.col("source_term").alias("en"), F.concat(F.lit("Đ "), "target_term").alias("vi"), "category").withColumn("b", (F.col("id") % 4).cast("int"))
    number = F.col("id").cast("string")
    cells = F.when(F.col("b") == 2, F.array("en", "vi")).when(F.col("b") == 3, F.array(number, "vi", "en", "category")).otherwise(F.array(number, F.concat(F.lit("1. "), F.col("en")), "vi", "category"))
    data = terms.select(F.concat(F.lit("book"), F.col("b").cast("string")).alias("file"), F.lit("s").alias("sheet"), (F.floor(F.col("id") / 4) + 1).cast("long").alias("row_no"), cells.alias("cells"))
    return data.unionByName(s.createDataFrame([(f"book{b}", "s", 0, h) for b, h in HEADERS.items()], "file string, sheet string, row_no long, cells array<string>"))


add("src03_header_roles", lambda s, d: R.column_roles(grid(s, d)), "SELECT file, 's' AS sheet, source, target, definition, context FROM (VALUES ('book0', 1, 2, NULL, 3), ('book1', 1, 2, 3, NULL), ('book2', 0, 1, NULL, NULL), ('book3', 2, 1, NULL, 3)) v(file, source, target, definition, context)")
add("src13_sheet_terms", lambda s, d: R.sheet_terms(grid(s, d)).select("file", "row_no", "source_term", "target_term", "source_language", "definition", "context"), """
SELECT 'book' || (id % 4) AS file, CAST(id // 4 + 1 AS BIGINT) AS row_no, source_term, 'Đ ' || target_term AS target_term, 'en' AS source_language,
  CASE WHEN id % 4 = 1 THEN category END AS definition, CASE WHEN id % 4 IN (0, 3) THEN category ELSE 's' END AS context FROM terms""", B.TERMS)  # fmt: skip
