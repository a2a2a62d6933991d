"""Queries of the language, code and name predicates over all lines of documents and fixed cases, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import language as L
from ..functions import predicates as P
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import classify as C
from . import base as B
from .text_queries import IS_LABEL

QUERIES, ORACLES = {}, {}

CASES = [
    "OK", "3) no good", "[FAIL]", "N/A.", "12.5 mm", "7-9", "2025/1/31", "ISO 14001", "QX-12", "LOT 9B", "PO #77", "me@site.org", "https://a.org/b", "AC 110 V", "***", "SPI 7-8 stitches/inch",
    "kiem tra duong may", "may 3, 2023", "lot no. 7", "day off", "tan leather", "last operation", "may logo", "quet primer", "Ép đế nóng", "press the upper", "the khuon and the giay", "khuon giay", "giay",
    "Nike Zoom 12", "Puma Suede XL", "Hoka Clifton", "AB1234-567", "mẫu giày: TR-08", "Mẫu 3", "Model Q", "Adidas shoes", "IPQC", "Wi-Fi", "brand new", "đế ngoài", "de ngoai la 5 mm",
    "Toe cap (Mũi giày)", "Ép nhiệt / Heat press", "Check - 5 mm", "Dán đế - Kiểm tra", "one | two | ba điểm", "Áp dụng cho model A (toe)", "Final check\nKiểm tra lần cuối", "22/9", "SB-1-A", "LOW OG 22",
    "nosew film", "may lót", "cắt laser", "ép nóng", "mài đế ngoài", "kiểm tra lỗi", "gò mũi", "đường chỉ", "rubber",
]
_rows = ", ".join(f"(CAST(-1 AS BIGINT), {i}, '" + c.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for i, c in enumerate(CASES))
LINES = f"lines AS (SELECT doc_id, line_no, 'whole' AS kind, 0 AS i, text FROM units UNION ALL SELECT doc_id, line_no, 'whole', 0, text FROM (VALUES {_rows}) v(doc_id, line_no, text))"


def lines(s, d):
    cases = s.createDataFrame([(-1, i, c) for i, c in enumerate(CASES)], "doc_id long, line_no int, text string")
    return catalog.units(s, d).select("doc_id", "line_no", "text").union(cases)


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_MARKS = f"regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]')"
_HOMOGRAPHS = r"\b(?:may\s+(?:20\d{2}|\d{1,2}(?:st|nd|rd|th)?(?:\s*,\s*20\d{2}|\s+20\d{2}|$))|lot\s*(?:#|no\.?|number|id|code|size|qty)|day\s*(?:shift|off|time|work|\d+)|tan\s*(?:color|colour|leather|suede)|last\s*(?:step|check|operation|stage|process|inspection))\b"
_COMMAND = r"(?:^|\s)[*•\-#]?\s*(?:\d+[.)]\s*)?(?:may|dan|mai|quet|go|chat|ep|kiem\s*tra|dinh\s*hinh|ve\s*sinh)\s+(?:mudguard|logo|vien|lot|vong\s*co|de|mui|than|luoi|upper|outsole|midsole|heel|toe|collar|lining|tongue|strap|eyestay|label|jig|khuon|keo|primer|\d+\s*kim|zigzag|chi|rap|cup|drap)"
#: Evidence of each line, in columns.
EVIDENCE = rf"""t AS (
  SELECT doc_id, line_no, kind, i, {BARE} AS text FROM lines
), k AS (
  SELECT *, {B.tokens("text")} AS tok FROM t
), e AS (
  SELECT doc_id, line_no, kind, i, text, {_MARKS} AS marks, regexp_matches(text, '(?i){_HOMOGRAPHS}') AS homographs,
    regexp_matches(array_to_string(tok, ''), '{"|".join(V.PHRASES)}') OR regexp_matches(text, '(?i){_COMMAND}') AS phrase,
    regexp_matches(array_to_string(tok, ''), '{"|".join(T.plain_compact(p) for p in V.EVIDENCE_PHRASES)}') AS hints, len(tok) AS n,
    len(list_filter(tok, lambda x: x IN ({listed(V.ENGLISH)}))) AS known, len(list_filter(tok, lambda x: regexp_matches(x, '\p{{L}}'))) AS letters,
    len(list_filter(tok, lambda x: x IN ({listed(V.SYLLABLES)}) AND x NOT IN ({listed(V.ENGLISH)}))) AS syllables,
    len(list_filter(tok, lambda x: x IN ({listed(V.ENGLISH)}) OR regexp_matches(x, '(?i)^[A-Z0-9\-./]+$'))) AS plain
  FROM k
), l AS (
  SELECT *, CASE WHEN marks THEN TRUE WHEN homographs THEN FALSE WHEN phrase THEN TRUE WHEN n >= 2 AND known >= 0.35 * n THEN FALSE
    ELSE syllables >= 2 OR (letters >= 2 AND syllables >= 0.4 * letters) OR (letters = 1 AND syllables = 1) END AS vietnamese FROM e
), g AS (
  SELECT *, NOT vietnamese AND NOT hints AND n > 0 AND plain >= 0.6 * n AS english FROM l
)"""

_NAMES = listed([*V.BRANDS, *V.MODEL_WORDS, *V.ACRONYMS])
_PART = rf"(x IN ({_NAMES}) OR regexp_matches(x, '^\d+$') OR regexp_matches(x, '^[IVXLCDM]+$') OR length(x) <= 4 OR (regexp_matches(x, '\d') AND regexp_matches(x, '^[A-Z0-9]+$')))"
_VALID = rf"""(w = '' OR w IN ({_NAMES}) OR regexp_matches(w, '^\d+$') OR regexp_matches(w, '^[IVXLCDM]+$') OR (regexp_matches(w, '\d') AND regexp_matches(w, '^[A-Z0-9\-./]+$')) OR (length(w) <= 4 AND regexp_matches(w, '^[A-Z0-9]+$'))
    OR (len(regexp_split_to_array(w, '[-_/]')) > 1 AND len(list_filter(regexp_split_to_array(w, '[-_/]'), lambda x: NOT {_PART})) = 0))"""
_PREFIX = r"(?i)^(?:tên\s*(?:hình\s*thể|giày|mẫu)|hình\s*thể|mẫu\s*giày|model(?:\s*name)?)\s*[:：\-]\s*"
_UNIT = r"(?:%|mm|cm|m|kg|g|spi|bar|psi|°c|°f|s|sec|min|h|hrs?)"
_FORMS = [
    r"(?i)^(?:AC|DC)\s*\d+(?:[.,]\d+)?\s*V$", r"^[A-Z]{2,6}\s+[A-Z]{1,6}\d+[A-Z0-9-]*$", r"(?i)^https?://\S+$|^[\w.+-]+@[\w.-]+\.[a-z]{2,}$", r"^[*•\-#:/,.()\[\]{}_]+$", rf"(?i)^\d+(?:[.,]\d+)?(?:\s*{_UNIT})?$",
    rf"(?i)^\d+(?:[.,]\d+)?\s*[-–—~]\s*\d+(?:[.,]\d+)?(?:\s*{_UNIT})?$", r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$", r"(?i)^ISO(?:\s*|/IEC\s*)\d+(?:[-:]\d+)?$", r"(?i)^\(?[A-Z]{2,4}[-_]\d{2,4}(?:[-_][A-Z0-9]+)*\)?$",
    r"(?i)^(?:P/O|PO|BOM|LOT|STYLE|COLOR|SIZE|ITEM)(?:\s*[#:]\s*|\s+)[A-Z0-9\-_/]*\d[A-Z0-9\-_/]*$", r"(?i)^(?:P/O|PO|BOM|LOT|STYLE|COLOR|SIZE|ITEM)\s*#[A-Z0-9\-_/]+$", r"(?i)^SPI\s+\d+(?:-\d+)?\s+stitches/inch$",
    r"(?i)^(?:Model\s+[A-Z0-9\-]+|Nike(?:\s+[A-Za-z0-9\-]+)*)$",
]
_FORM = " OR ".join(f"regexp_matches(text, '{f}')" for f in _FORMS) + r" OR (regexp_matches(text, '\d') AND regexp_matches(text, '(?i)^(?:model\s+)?[A-Z0-9]{1,6}(?:[-_][A-Z0-9]+)+(?:\s*\([A-Z0-9\-]+\))?$'))"
_WORD = r"upper(regexp_replace(regexp_replace(text, '^[#(\[{.:]+|[)\]}.:,]+$', '', 'g'), '^\s+|\s+$', '', 'g'))"
#: Names and codes of each line.
CODES = rf"""m AS (
  SELECT *, regexp_replace(regexp_replace(text, '{_PREFIX}', ''), '^\s+|\s+$', '', 'g') AS name FROM g
), u AS (
  SELECT *, list_transform(list_filter(regexp_split_to_array(upper(regexp_replace(name, '[()\[\]{{}}<>"'',]', ' ', 'g')), '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[#.:\-]+|[.:\-]+$', '', 'g')) AS words FROM m
), v AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_PREFIX}') AND marks THEN FALSE ELSE name <> '' AND (regexp_matches(name, '(?i)^(?:model|mẫu|sample|hình\s*thể|style|code|art(?:icle)?)\s*[:#\-]?\s*([A-Z0-9\-./]+)$')
    OR regexp_matches(name, '(?i)^\(?[A-Z0-9]{{5,8}}[-_/]\d{{3}}\)?$') OR (regexp_matches(name, '\d') AND regexp_matches(name, '(?i)^\(?#?[A-Z0-9]{{1,8}}(?:[-_/.][A-Z0-9]{{1,8}})+\)?$'))
    OR (regexp_matches(upper(name), '\b(?:{V.MODEL_SIGNS})\b') AND len(words) > 0 AND len(list_filter(words, lambda w: NOT {_VALID})) = 0)) END AS model FROM u
), c AS (
  SELECT *, {IS_LABEL} AS label, text = '' OR model OR (NOT vietnamese AND ({_FORM} OR {_WORD} IN ({_NAMES}) OR {IS_LABEL})) AS code FROM v
)"""


def add(name: str, columns: dict, sql: str, *ctes: str) -> None:
    QUERIES[name] = lambda s, d: lines(s, d).select("doc_id", "line_no", *(c(F.col("text")).alias(k) for k, c in columns.items()))
    ORACLES[name] = B.with_(B.UNITS, LINES, *ctes) + f"SELECT doc_id, line_no, {sql} FROM {'c' if CODES in ctes else 'g' if EVIDENCE in ctes else 'lines'} WHERE kind = 'whole'"


add("fil15_vietnamese", {"vietnamese": L.is_vietnamese}, "vietnamese", EVIDENCE)
add("fil16_english", {"english": L.is_english}, "english", EVIDENCE)
add("fil09_model_name", {"model": L.is_model_name}, "model", EVIDENCE, CODES)
add("fil08_non_translatable", {"code": L.is_code}, "code", EVIDENCE, CODES)
add("fil11_immune", {"immune": L.is_immune, "immune_en": lambda t: L.is_immune(t, "en")}, "text <> '' AND NOT vietnamese AND (label OR code OR english) AS immune, text <> '' AND (label OR code) AS immune_en", EVIDENCE, CODES)
add("fil18_metadata", {"metadata": L.is_metadata}, rf"""text <> '' AND NOT marks AND (code OR regexp_matches(text, '^\d{{1,2}}[/\-.]\d{{1,2}}(?:[/\-.]\d{{2,4}})?$') OR (length(text) <= 45 AND regexp_matches(text, '(?i)^[A-Z0-9\-_/.:#()\s]+$')
  AND len(list_filter(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[#(\[{{.:]+|[)\]}}.:,]+$', '', 'g')), lambda w: NOT (w = '' OR regexp_matches(w, '\d') OR length(w) <= 3 OR upper(w) IN ({listed(V.METADATA)})))) = 0)) AS metadata""", EVIDENCE, CODES)  # fmt: skip
_STAGES = "CASE " + " ".join(rf"WHEN regexp_matches(text, '(?i)\b(?:{w})\b') THEN '{n}'" for n, w in [
    ("nosew", r"nosew|no-sew|ép\s+nhiệt|máy\s+nosew|pizza\s+pan|protective\s+film|màng\s+tpu|màng\s+bảo\s+vệ"), ("stitching", r"may|đường\s+may|kim|chỉ|mũi/inch|spi|mudguard|collar\s+lining|may\s+lót|may\s+vòng\s+cổ"),
    ("cutting", r"chặt|dao\s+chặt|khuôn\s+dao|máy\s+chặt|cắt\s+laser|bàn\s+chặt"), ("assembly", r"gò|dán\s+đế|quét\s+keo|quét\s+primer|sấy|lò\s+sấy|lực\s+ép\s+đế|ép\s+lạnh|ép\s+nóng|last|lasting"),
    ("stockfit", r"mài\s+đế|xử\s+lý\s+đế|phun\s+sơn\s+đế|đế\s+ngoài|outsole|midsole|stockfit"), ("qa", r"kiểm\s+tra|lỗi|khuyết\s+tật|defect|ctq|isq|tiêu\s+chuẩn|qa\s+manual|mức\s+độ|ẩn\s+màu|lem\s+màu"),
]) + " ELSE 'general' END AS stage"
add("prj06_stage", {"stage": P.stage}, _STAGES)


def bilingual(s, d):
    return lines(s, d).select("doc_id", "line_no", L.is_bilingual(F.col("text")).alias("both_languages"))


#: The same lines with their parts - lines of a text, both parts around a parenthesis, and parts around dashes - as rows of their own.
PARTS = LINES.replace("lines AS (", "whole_lines AS (", 1) + rf""", w AS (
  SELECT doc_id, line_no, {BARE} AS text FROM whole_lines
), sides AS (
  SELECT doc_id, line_no, 'line' AS kind, string_split(text, chr(10)) AS p FROM w
  UNION ALL SELECT doc_id, line_no, 'inner', CASE WHEN regexp_matches(text, '^[^()]+?\s*\([^()]+?\)$') THEN [regexp_extract(text, '^([^()]+?)\s*\(([^()]+?)\)$', 1), regexp_extract(text, '^([^()]+?)\s*\(([^()]+?)\)$', 2)] ELSE [] END FROM w
  UNION ALL SELECT doc_id, line_no, 'mark', regexp_split_to_array(trim(regexp_replace(regexp_replace(text, '\([^()]*\)', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')), '[-–—/|]') FROM w
), lines AS (
  SELECT doc_id, line_no, 'whole' AS kind, 0 AS i, text FROM w
  UNION ALL SELECT doc_id, line_no, kind, CAST(n AS INTEGER), x[n] FROM (SELECT doc_id, line_no, kind, x, unnest(range(1, len(x) + 1)) AS n FROM
    (SELECT doc_id, line_no, kind, list_filter(list_transform(p, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS x FROM sides) WHERE len(x) > 1)
)"""
_ITEM = r"regexp_matches(regexp_replace(text, '^[#(\[{.:*\-\s]+|[)\]}.:,\-\s]+$', '', 'g'), '(?i)^(?:CTQ|CTP|SOP|QC|QA|STEP|ITEM|PART|NO|STT)?\s*#?\d+[a-z]?$')"
#: Whether each line is bilingual, by its parts.
BILINGUAL = rf"""p AS (
  SELECT *, english AND NOT code AND NOT {_ITEM} AS en, english AND NOT {_ITEM} AS plain_en, lower(text) IN ({listed(V.UNIT_WORDS)}) AS unit, length(text) AS len FROM c
), b AS (
  SELECT doc_id, line_no,
    bool_or(kind = 'line' AND plain_en) AND bool_or(kind = 'line' AND marks) AS by_line,
    (bool_or(kind = 'inner' AND i = 1 AND en) AND bool_or(kind = 'inner' AND i = 2 AND marks)) OR (bool_or(kind = 'inner' AND i = 1 AND marks) AND bool_or(kind = 'inner' AND i = 2 AND en)) AS by_parenthesis,
    count(*) FILTER (kind = 'mark') AS parts, count(*) FILTER (kind = 'mark' AND marks) AS vi, count(*) FILTER (kind = 'mark' AND en) AS en2, count(*) FILTER (kind = 'mark' AND en AND NOT unit) AS en, count(*) FILTER (kind = 'mark' AND unit) AS units,
    coalesce(min(len) FILTER (kind = 'mark'), 0) AS short, coalesce(max(len) FILTER (kind = 'mark'), 1) AS long, coalesce(sum(len) FILTER (kind = 'mark' AND marks), 0) AS vi_len, coalesce(sum(len) FILTER (kind = 'mark' AND en AND NOT unit), 0) AS en_len,
    bool_or(kind = 'whole' AND regexp_matches(text, '(?i)^\s*\*?\s*(?:đối\s*với|áp\s*dụng\s*cho|dành\s*cho|model\s*[:\s\-]|mẫu\s*[:\s\-])')) AS header
  FROM p GROUP BY doc_id, line_no
), bi AS (
  SELECT doc_id, line_no, NOT header AND (by_line OR by_parenthesis OR (parts = 2 AND units = 0 AND short >= 0.28 * long AND en2 = 1 AND vi = 1)
    OR (parts > 2 AND vi = 1 AND en >= 1 AND vi + en = parts AND least(vi_len, en_len) >= 0.28 * greatest(vi_len, en_len))) AS both_languages FROM b
)"""
QUERIES["fil13_bilingual"] = bilingual
ORACLES["fil13_bilingual"] = B.with_(B.UNITS, PARTS, EVIDENCE, CODES, BILINGUAL) + "SELECT doc_id, line_no, both_languages FROM bi"
#: PRJ01 from English to Vietnamese over lines of documents: memory are the lines of every third document, the glossary is the approved sentences, a container is a document.
_UNIT_PARTS = PARTS.replace(LINES.replace("lines AS (", "whole_lines AS (", 1), "whole_lines AS (SELECT doc_id, line_no, text FROM units)")
CLASSIFIED = (
    B.MEMORY, _UNIT_PARTS, EVIDENCE, CODES, BILINGUAL,
    rf"""held AS (SELECT doc_id, bool_or({_MARKS}) AS vi FROM units GROUP BY doc_id),
classified AS (
  SELECT c.doc_id, c.line_no, {B.exact('u.text')} AS key, CASE WHEN c.label OR c.code THEN 'NON_TRANSLATABLE' WHEN bi.both_languages THEN 'MIXED_LANGUAGE'
    WHEN {B.exact('u.text')} IN (SELECT {B.exact('sentence')} FROM memory) OR {B.canonical('u.text')} IN (SELECT {B.canonical('sentence')} FROM memory) THEN 'LOCKED_TERMINOLOGY'
    WHEN {B.exact('u.text')} IN (SELECT {B.exact('text')} FROM units WHERE doc_id % 3 = 0) OR {B.canonical('u.text')} IN (SELECT {B.canonical('text')} FROM units WHERE doc_id % 3 = 0) THEN 'TM_REUSE'
    WHEN c.marks THEN 'ALREADY_TRANSLATED' WHEN c.english AND held.vi THEN 'ALREADY_TRANSLATED' WHEN c.english THEN 'NEEDS_TRANSLATION' ELSE 'REVIEW_REQUIRED' END AS status
  FROM c JOIN bi USING (doc_id, line_no) JOIN held USING (doc_id) JOIN units u USING (doc_id, line_no) WHERE c.kind = 'whole'
)""",
)


def classified(s, d):
    """Lines of documents with their status and exact key."""
    units = catalog.units(s, d)
    memory = units.where("doc_id % 3 = 0").select(F.col("text").alias("source"), F.col("text").alias("target"))
    glossary = catalog.memory(s, d).select(F.col("sentence").alias("source"), F.col("sentence").alias("target"))
    return C.classified(C.with_container(units, "doc_id"), memory, glossary, "en", "vi").withColumn("key", T.exact_key(F.col("text")))


QUERIES["prj01_classifier"] = lambda s, d: classified(s, d).select("doc_id", "line_no", "status")
ORACLES["prj01_classifier"] = B.with_(B.UNITS, *CLASSIFIED) + "SELECT doc_id, line_no, status FROM classified"

#: Calls that failed: a status and a message each, told by the event's number.
FAILURES = [
    (429, "Resource exhausted, retry in 12.2 s"), (429, "quota PerDay used"), (None, "429 too many, PerMinute"), (429, "slow down"), (400, "bad"), (None, "INVALID_ARGUMENT x"), (401, "who"), (403, "no"),
    (404, "gone"), (500, "oops"), (503, "busy"), (None, "socket hang up"), (None, "request timeout"), (None, "TypeError: fetch failed"), (None, None), (200, "strange"), (429, "Retry-After: 30"), (None, "resource exhausted: see billing"),
]


def failures(s, d):
    cases = F.broadcast(s.createDataFrame([(i, *f) for i, f in enumerate(FAILURES)], "n int, status int, message string"))
    found = catalog.log(s, d).select("id", (F.col("id") % len(FAILURES)).cast("int").alias("n")).join(cases, "n").withColumn("f", P.failure(F.col("status"), F.col("message")))
    return found.select("id", F.col("f.type").alias("error_type"), "f.retryable", F.col("f.retry_after").cast("long").alias("retry_after"))


QUERIES["prj08_error_type"] = failures
ORACLES["prj08_error_type"] = B.with_(B.LOG) + """
SELECT id, error_type, retryable, CAST(retry_after AS BIGINT) AS retry_after FROM (SELECT id, id % 18 AS n FROM log) JOIN (VALUES
  (0, 'RATE_LIMIT_RPM', TRUE, 13), (1, 'RATE_LIMIT_RPD', FALSE, NULL), (2, 'RATE_LIMIT_RPM', TRUE, NULL), (3, 'RATE_LIMIT_RPM_OR_UNKNOWN', TRUE, NULL), (4, 'INVALID_REQUEST', FALSE, NULL), (5, 'INVALID_REQUEST', FALSE, NULL),
  (6, 'AUTH_ERROR', FALSE, NULL), (7, 'PERMISSION_ERROR', FALSE, NULL), (8, 'MODEL_NOT_FOUND', FALSE, NULL), (9, 'SERVER_5XX', TRUE, NULL), (10, 'SERVER_5XX', TRUE, NULL), (11, 'ECONNRESET', TRUE, NULL), (12, 'TIMEOUT', TRUE, NULL),
  (13, 'NETWORK_ERROR', TRUE, NULL), (14, 'UNKNOWN_ERROR', FALSE, NULL), (15, 'UNKNOWN_ERROR', FALSE, NULL), (16, 'RATE_LIMIT_RPM', TRUE, 30), (17, 'RATE_LIMIT_RPD', FALSE, NULL)
) v(n, error_type, retryable, retry_after) USING (n)"""
