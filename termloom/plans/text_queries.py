"""Queries of the scalar functions and predicates, over lines of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import predicates as P
from ..functions import text as T
from . import base as B

QUERIES, ORACLES = {}, {}


def units_query(name: str, columns: dict, sql: dict[str, str]) -> None:
    """Registers columns over units beside their SQL."""
    QUERIES[name] = lambda s, d: catalog.units(s, d).select("doc_id", "line_no", *(c().alias(k) for k, c in columns.items()))
    ORACLES[name] = B.with_(B.UNITS) + "SELECT doc_id, line_no, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + " FROM units"


t = lambda: F.col("text")

units_query("f01_canonical_key", {"key": lambda: T.canonical_key(t())}, {"key": B.canonical("text")})
units_query("f02_exact_key", {"key": lambda: T.exact_key(t())}, {"key": B.exact("text")})
units_query("f04_text_forms", {"normalised": lambda: T.normalised(t()), "folded": lambda: T.folded(t()), "n_tokens": lambda: F.size(T.tokens(t()))}, {"normalised": B.normalised("text"), "folded": B.folded("text"), "n_tokens": f"CAST(len({B.tokens('text')}) AS INTEGER)"})
units_query("f05_word_key", {"key": lambda: T.word_key(t())}, {"key": B.word_key("text")})
units_query("f20_step_number", {"step": lambda: T.step_number(t()), "bare": lambda: T.without_step(t())}, {
    "step": r"nullif(regexp_extract(text, '(?i)^\s*(?:[*•#]\s*)?(?:(?:step|bước|ctq|sop|item|mục|trạm)\s*[:#]?\s*)?(\d+(?:\.\d+)?)(?:[.:\-/)]|\s+(?:en|vi|vn)(?:[^A-Za-z0-9_]|$))', 1), '')",
    "bare": r"trim(regexp_replace(trim(text), '(?i)^(?:[*•#]\s*)?(?:(?:step|bước|item|ctq)\s*)?\d+(?:\.\d+)?[.):\-]\s*', ''))",
})
units_query("f29_numbers", {"numbers": lambda: F.array_join(T.numbers(t()), "|")}, {"numbers": r"array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), '|')"})
units_query("f39_source_hash", {"hash": lambda: T.source_hash(t())}, {"hash": f"substr(md5({B.canonical('text')}), 1, 16)"})
units_query("f40_cache_key", {"key": lambda: T.cache_key(F.col("lang"), t())}, {"key": "sha256(lang || chr(0) || text)"})
units_query("fil14_diacritics", {"marked": lambda: P.has_marks(t())}, {"marked": f"regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]')"})
units_query("fil21_technical_term", {"term": lambda: P.is_technical_term(t())}, {
    "term": rf"length(trim(text)) >= 3 AND NOT regexp_matches(trim(text), '^\d+$') AND (len(regexp_split_to_array(trim(text), '\s+')) BETWEEN 2 AND 8 OR regexp_matches(trim(text), '(?i)^({P.TECHNICAL})$'))",
})

LABEL = r"(?:GOOD|NO\s*GOOD|OK|NG|PASS|FAIL|REJECT|ACCEPT|SAMPLE|DEFECT|CORRECT|INCORRECT|N/A)"


def literal_query(name: str, rows: list[str], columns: dict, sql: dict[str, str]) -> None:
    """Registers columns over fixed texts joined to the lines' first words, so that both plain cases and data are covered."""
    quoted = ", ".join("('" + r.replace("'", "''") + "')" for r in rows)

    def run(s, d):
        words = catalog.units(s, d).select(F.explode(F.split(F.trim("text"), r"\s+")).alias("text")).distinct()
        return words.union(s.createDataFrame([(r,) for r in rows], "text string")).distinct().select("text", *(c().alias(k) for k, c in columns.items()))

    QUERIES[name] = run
    ORACLES[name] = B.with_(B.UNITS, rf"w AS (SELECT DISTINCT unnest(regexp_split_to_array(trim(text), '\s+')) AS text FROM units UNION SELECT * FROM (VALUES {quoted}) v(text))") + "SELECT text, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + " FROM w"


CASES = ["OK", "1. NO GOOD", "(PASS)", "N/A.", "Step 12", "#4a", "CTQ 3:", "12.5 mm", "10-12", "2026-10-02", "ISO 9001", "AB-123", "SB-077-A-1", "LOT 45A", "PO #12", "a@b.org", "https://x.org/y", "98.5%", "Check if", "2) verify.", "press", "SPI 9-10 stitches/inch", "for AB-12, CD-3", "model: ZZ-9", "10 spi", "***", "AC 220 V", "quét keo", "Kiểm tra 5 mm", "khi ép", "*Heading: a", "3. Place part", "no.", "3.5%", "FA25", "two words", "tolerance ±0.5 mm, 12 kg/cm²", "vamp lining", "gap at toe", "rubber foam", "sew now", "nosew film", "last line"]
_label_raw, _label_bare = r"trim(regexp_replace(text, '^[#(\[{.:*]+|[)\]}.:,]+$', '', 'g'))", r"trim(regexp_replace(regexp_replace(text, '^(?:\s*[*•\-#\d+.:)(\[\]{}①-⑳]+\s*)+', ''), '[)\]}.:,]+$', ''))"
IS_LABEL = f"(regexp_matches({_label_raw}, '(?i)^{LABEL}$') OR regexp_matches({_label_bare}, '(?i)^{LABEL}$'))"
literal_query("fil10_inspection_label", CASES, {"label": lambda: P.is_label(t())}, {"label": IS_LABEL})
literal_query("fil12_item_code", CASES, {"code": lambda: P.is_item_code(t())}, {"code": r"regexp_matches(trim(regexp_replace(text, '^[#(\[{.:*\-\s]+|[)\]}.:,\-\s]+$', '', 'g')), '(?i)^(?:CTQ|CTP|SOP|QC|QA|STEP|ITEM|PART|NO|STT)?\s*#?\d+[a-z]?$')"})
literal_query("fil19_cell_text", CASES, {"cell": lambda: P.is_cell_text(t())}, {
    "cell": rf"length(trim(text)) >= 2 AND NOT (regexp_matches(trim(text), '^\d+(\.\d+)?%?$') OR regexp_matches(trim(text), '(?i)^(stt|no\.?|id|#)$') OR (regexp_matches(trim(text), '(?i)^[A-Z0-9_\-./]+$') AND regexp_matches(trim(text), '\d') AND NOT regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]'))) AND (regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]') OR (regexp_matches(trim(text), '[a-zA-Z]{{2,}}') AND contains(trim(text), ' ')))",
})
literal_query("fil22_special_term", CASES, {"term": lambda: P.is_special_term(t())}, {
    "term": r"length(trim(text)) BETWEEN 2 AND 40 AND NOT regexp_matches(trim(text), '[.?!;\n\r]') AND NOT regexp_matches(trim(text), '(?i)(^|[^A-Za-z0-9_])(phải|cần|nên|để|để không|không bị|sau đó|tiến hành|thực hiện|nhằm|nếu|khi|trong khi|bởi vì|trước khi|sau khi|tuyệt đối|chú ý|lưu ý|hãy|bị|được)([^A-Za-z0-9_]|$)') AND len(regexp_split_to_array(trim(text), '\s+')) BETWEEN 1 AND 4",
})
literal_query("fil23_fragment", CASES, {"fragment": lambda: P.is_fragment(t())}, {"fragment": r"regexp_matches(trim(regexp_replace(regexp_replace(trim(text), '^\s*(?:\d+(?:\.\d+)?[.):\-]\s*)', ''), '[.!?:;]+$', '')), '(?i)^(?:check(?:\s+if)?|inspect|verify|ensure|accept|place|attach|apply|stitch|sew|press|avoid)$')"})


def ladder(column: str, stages) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i)(^|[^A-Za-z0-9_])(?:{w})([^A-Za-z0-9_]|$)') THEN '{n}'" for n, w in stages) + " ELSE 'general' END"


literal_query("prj05_category", CASES, {"category": lambda: P.category(t())}, {"category": ladder("text", P.CATEGORIES)})
literal_query("f21_model_section", CASES, {"model": lambda: T.model_section(t())}, {
    "model": r"""CASE WHEN regexp_matches(text, '[\r\n]') OR len(regexp_extract_all(upper(regexp_extract(trim(text), '(?i)^(?:[*•#]\s*)?(?:đối\s+với|for|áp\s+dụng\s+cho|apply\s+to|applicable\s+to|dành\s+cho|with\s+(?:the\s+)?cutting\s+die|model\s*[:\-]?|mẫu\s*[:\-]?)\s+(.+)$', 1)), '[A-Z0-9]+(?:[-–][A-Z0-9]+)+')) = 0 THEN NULL
      ELSE array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper(regexp_extract(trim(text), '(?i)^(?:[*•#]\s*)?(?:đối\s+với|for|áp\s+dụng\s+cho|apply\s+to|applicable\s+to|dành\s+cho|with\s+(?:the\s+)?cutting\s+die|model\s*[:\-]?|mẫu\s*[:\-]?)\s+(.+)$', 1)), '[A-Z0-9]+(?:[-–][A-Z0-9]+)+'), lambda c: replace(c, '–', '-')))), '|') END""",
})
literal_query("f30_measurements", CASES, {"measures": lambda: F.array_join(T.measurements(t()), "|")}, {
    "measures": r"array_to_string(list_transform(regexp_extract_all(regexp_replace(replace(regexp_replace(lower(text), '\+\s*[-−]\s*', '±', 'g'), ',', '.'), 'mũi\s*/\s*inch', 'stitches/inch', 'g'), '(?:[±+\-−]\s*)?\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\s*(?:stitches\s*/\s*inch|kg\s*/\s*cm[²2]|mm|cm|kg|n\b|°\s*c|%)'), lambda m: replace(replace(regexp_replace(m, '\s+', '', 'g'), '–', '-'), '²', '2')), '|')",
})
literal_query("f26_file_name", CASES, {"name": lambda: T.safe_file_name(t())}, {"name": "regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g')"})
literal_query("prj04_section", CASES, {"section": lambda: P.section(t(), F.length(t()) > 60, F.length(t()) == 2)}, {
    "section": r"CASE WHEN length(text) = 2 THEN 'inspection item' WHEN length(text) > 60 THEN 'title' WHEN starts_with(trim(text), '*') THEN 'process heading' WHEN starts_with(trim(text), '•') OR starts_with(trim(text), '-') OR regexp_matches(trim(text), '^\d+[.)]') THEN 'process step' ELSE 'content' END",
})
literal_query("prj07_surface_forms", ["a / b", "one", "x/y/z", " p/ "], {"forms": lambda: F.array_join(forms(t()), "|")}, {
    "forms": "array_to_string(list_concat([trim(text)], list_filter(list_distinct_in_order(text), lambda x: x <> trim(text))), '|')",
})
from ..operators.glossary import forms  # noqa: E402

ORACLES["prj07_surface_forms"] = ORACLES["prj07_surface_forms"].replace("list_filter(list_distinct_in_order(text), lambda x: x <> trim(text))", "list_filter(list_transform(string_split(text, '/'), lambda x: trim(x)), lambda x: x <> '' AND x <> trim(text))")
literal_query("fil17_language_hits", CASES, {"hits": lambda: P.language_hits(T.tokens(t()), ["the", "and", "of", "der", "und", "la", "que"])}, {"hits": f"CAST(len(list_filter({B.tokens('text')}, lambda t: t IN ('the', 'and', 'of', 'der', 'und', 'la', 'que'))) AS INTEGER)"})


def f33(s, d):
    n = F.col("n").cast("int")
    return catalog.table(s, d, "part").select((F.col("p_partkey") + 1).alias("n")).withColumn("letters", T.column_letters(n)).withColumn("back", T.column_index(F.col("letters")))


QUERIES["f33_spreadsheet_columns"] = f33
ORACLES["f33_spreadsheet_columns"] = """
SELECT n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
  ELSE chr(CAST(65 + ((n - 703) // 676) AS INTEGER)) || chr(CAST(65 + ((n - 703) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END AS letters, CAST(n AS INTEGER) AS back
FROM (SELECT p_partkey + 1 AS n FROM part)"""

QUERIES["f31_half_up"] = lambda s, d: catalog.log(s, d).select("id", T.half_up(-F.col("duration")).alias("r"))
ORACLES["f31_half_up"] = B.with_(B.LOG) + "SELECT id, CAST(floor(-duration + 0.5) AS BIGINT) AS r FROM log"
QUERIES["f37_day_key"] = lambda s, d: catalog.log(s, d).select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
ORACLES["f37_day_key"] = B.with_(B.LOG) + "SELECT id, strftime(ts, '%Y-%m-%d') AS day FROM log"
QUERIES["f32_geometry_box"] = lambda s, d: catalog.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.percent_box(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(30000.0))[0].alias("low"))
ORACLES["f32_geometry_box"] = "SELECT l_orderkey, l_linenumber, floor(greatest(0.0, least(100.0, l_extendedprice / 30000.0 * 100)) * 10 + 0.5) / 10 AS low FROM lineitem"
QUERIES["f25_xml_unescape"] = lambda s, d: catalog.runs(s, d).select("page_id", "run_no", "tag", T.unescape_xml(F.col("text")).alias("text"))
ORACLES["f25_xml_unescape"] = B.with_(B.RUNS) + "SELECT page_id, run_no, tag, replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS text FROM runs"
