"""Document readers: paragraphs, sections, slides, pages and sheets as rows, and the term candidates that they hold.

Containers (zip, PDF) are unpacked by the caller into rows of parts: (file, path, xml), (file, text) or
(file, sheet, row_no, cells). Everything after that is expressions and windows within a file, which bound the
rows that meet in a task by a document's own size.

Edge cases: null texts and parts without text give no rows; files without headings have one section; repeated
files are one file as far as their names are equal; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T

#: Patterns of paragraphs, text runs and heading styles.
PARAGRAPH, RUN, STYLE = r"(?s)(<w:p(?:\s|>).*?</w:p>)", r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", r'<w:pStyle\s+w:val="Heading(\d)"'
SLIDE, SLIDE_RUN = r"^ppt/slides/slide(\d+)\.xml$", r"<a:t(?:\s[^>]*)?>([^<]*)</a:t>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """SRC04: (file, para_no, text, level) of document parts (file, xml): paragraphs with text; level is a heading's, else null."""
    rows = files.select("file", F.posexplode(F.regexp_extract_all(F.coalesce("xml", F.lit("")), F.lit(PARAGRAPH), 1)).alias("para_no", "p"))
    level = F.regexp_extract("p", STYLE, 1)
    return rows.select("file", "para_no", _strip(F.array_join(F.regexp_extract_all("p", F.lit(RUN), 1), "")).alias("text"), F.when(level != "", level.cast("int")).alias("level")).where("text <> ''")


def sections(paragraphs: DataFrame, first: str = "Introduction") -> DataFrame:
    """SRC04, W13: (file, section, title, level, content): a heading starts a section; those without content are left out; texts before the first heading belong to ``first``."""
    so_far = Window.partitionBy("file").orderBy("para_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = paragraphs.withColumn("_section", F.count("level").over(so_far))
    found = marked.groupBy("file", "_section").agg(
        F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("text"))), F.lit(first)).alias("title"),
        F.coalesce(F.max("level"), F.lit(1)).alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("para_no", "text")))), lambda x: x["text"]), "\n").alias("content"),
    ).where("content <> ''")
    return found.select("file", F.row_number().over(Window.partitionBy("file").orderBy("_section")).alias("section"), "title", "level", "content")


def slides(parts: DataFrame) -> DataFrame:
    """SRC05, SRC08: (file, slide, title, texts, content) of presentation parts (file, path, xml) in the order of the numbers in their paths; slides without text are left out but counted."""
    number = F.regexp_extract("path", SLIDE, 1)
    rows = parts.where(number != "").select("file", F.row_number().over(Window.partitionBy("file").orderBy(number.cast("long"))).alias("slide"), F.filter(F.transform(F.regexp_extract_all(F.coalesce("xml", F.lit("")), F.lit(SLIDE_RUN), 1), _strip), lambda x: x != "").alias("texts"))
    rest = F.array_join(F.slice("texts", 2, 1 << 30), "\n")
    return rows.where(F.size("texts") > 0).select("file", "slide", F.get("texts", F.lit(0)).alias("title"), "texts", F.when(rest != "", rest).otherwise(F.get("texts", F.lit(0))).alias("content"))


def pages(files: DataFrame) -> DataFrame:
    """SRC06: (file, page, title, lines, content, scanned) of extracted texts (file, text): parts between form feeds or two blank lines; a text of under 50 characters counts as scanned."""
    t = F.coalesce("text", F.lit(""))
    kept = F.filter(F.split(t, r"\f|\n\s*\n\s*\n"), lambda x: _strip(x) != "")
    rows = files.select("file", (F.length(_strip(t)) < 50).alias("scanned"), F.posexplode(kept).alias("page", "part"))
    lines = F.filter(F.transform(F.split("part", "\n"), _strip), lambda x: x != "")
    return rows.select("file", (F.col("page") + 1).alias("page"), F.substring(F.get(lines, F.lit(0)), 1, 60).alias("title"), lines.alias("lines"), _strip(F.col("part")).alias("content"), "scanned")


def candidates(lines: DataFrame, longest: int = 35, confidence: float = 0.8, least_target: int = 2) -> DataFrame:
    """SRC04, SRC05, SRC06: "Term: translation" lines (text, and any context columns) as (source_term, target_term, confidence); addresses are no terms."""
    form = rf"^([A-Za-z0-9\s]{{3,{longest}}})\s*[:\-=–—]\s*(.+)$"
    source, target = _strip(F.regexp_extract("text", form, 1)), _strip(F.regexp_extract("text", form, 2))
    rows = lines.withColumns({"source_term": source, "target_term": target, "confidence": F.lit(confidence)})
    return rows.where((F.length("source_term") > 2) & (F.length("target_term") >= least_target) & ~F.lower("source_term").startswith("http"))


#: Headers of columns: numbers to skip, then whole and partial names by role.
ROLES = {
    "skip": (["stt", "no", "no.", "#", "index", "id"], []),
    "source": (["en", "eng", "source", "term"], ["english", "tiếng anh", "tieng anh"]),
    "target": (["vn", "vi", "target"], ["vietnamese", "tiếng việt", "tieng viet", "translation"]),
    "definition": ([], ["definition", "định nghĩa", "meaning"]),
    "context": ([], ["context", "ngữ cảnh", "category"]),
}


def header_role(header: Column) -> Column:
    """SRC03, SRC17: what a column's header says of it; null if nothing."""
    h = _strip(F.lower(F.coalesce(header, F.lit(""))))
    role = F.lit(None).cast("string")
    for name, (whole, part) in reversed(ROLES.items()):
        found = h.isin(*whole) if whole else F.lit(False)
        for p in part:
            found = found | h.contains(p)
        role = F.when(found, name).otherwise(role)
    return role


def column_roles(grid: DataFrame, sampled: int = 20) -> DataFrame:
    """SRC03, A16: (file, sheet, source, target, definition, context): numbers of columns, by headers, else by what the first ``sampled`` rows hold, else the first two columns.

    grid: (file, sheet, row_no, cells), row_no 0 is the header; blank rows are no data.
    """
    data = grid.where((F.col("row_no") > 0) & F.exists("cells", lambda c: _strip(F.coalesce(c, F.lit(""))) != ""))
    order = Window.partitionBy("file", "sheet").orderBy("row_no")
    sample = data.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sampled)
    cells = sample.select("file", "sheet", F.posexplode("cells").alias("col", "v")).withColumn("v", _strip(F.coalesce("v", F.lit("")))).where("v <> ''")
    number = F.col("v").rlike(r"^\d+$")
    profile = cells.groupBy("file", "sheet", "col").agg(F.count_if(number).alias("numbers"), F.count_if(~number & P.has_marks(F.col("v"))).alias("vi"), F.count_if(~number & ~P.has_marks(F.col("v")) & F.col("v").rlike("[a-zA-Z]{2,}")).alias("en"))
    headers = grid.where("row_no = 0").select("file", "sheet", F.size("cells").alias("width"), F.posexplode("cells").alias("col", "h"))
    rows = headers.withColumn("role", header_role(F.col("h"))).join(profile, ["file", "sheet", "col"], "left")
    plain = (F.coalesce("numbers", F.lit(0)) <= 10) & ~_strip(F.lower(F.coalesce("h", F.lit("")))).isin("stt", "no", "no.", "#")
    first = lambda test: F.min(F.when(test, F.col("col")))
    last = lambda test: F.max(F.when(test, F.col("col")))
    found = rows.groupBy("file", "sheet").agg(
        F.max("width").alias("width"), first(F.col("role") == "source").alias("s"), first(F.col("role") == "target").alias("t"), last(F.col("role") == "definition").alias("definition"), last(F.col("role") == "context").alias("context"),
        first(plain & (F.col("en") > 3) & (F.col("vi") == 0)).alias("en"), first(plain & (F.col("vi") > 3)).alias("vi"),
    )
    source, target = F.coalesce("s", "en"), F.coalesce("t", "vi")
    neither = source.isNull() & target.isNull() & (F.col("width") >= 2)
    return found.select("file", "sheet", F.when(neither, 0).otherwise(source).alias("source"), F.when(neither, 1).otherwise(target).alias("target"), "definition", "context")


def sheet_terms(grid: DataFrame) -> DataFrame:
    """SRC03: (file, sheet, row_no, source_term, target_term, source_language, definition, context): rows with both terms, numbering removed; a cell of two lines holds both."""
    data = grid.where("row_no > 0").join(column_roles(grid), ["file", "sheet"])
    cell = lambda c: _strip(F.coalesce(F.get("cells", F.col(c)), F.lit("")))
    marks = lambda x: F.coalesce(P.has_marks(x), F.lit(False))
    lines = lambda x: F.filter(F.transform(F.split(x, r"\r?\n"), _strip), lambda y: F.length(y) >= 2)

    def both(l: Column) -> Column:
        """(source, target) of two lines, the English one first; null of fewer."""
        a, b = F.get(l, F.lit(0)), F.get(l, F.lit(1))
        return F.when(F.size(l) >= 2, F.when(~marks(a) & marks(b), F.struct(a.alias("s"), b.alias("t"))).otherwise(F.struct(b.alias("s"), a.alias("t"))))

    def mixed(l: Column) -> Column:
        return F.when((F.size(l) >= 2) & (marks(F.get(l, F.lit(0))) != marks(F.get(l, F.lit(1)))), both(l))

    own = F.struct(cell("source").alias("s"), cell("target").alias("t"))
    in_source = T.let(lines(cell("source")), both)
    anywhere = F.get(F.filter(F.transform("cells", lambda c: T.let(lines(_strip(F.coalesce(c, F.lit("")))), mixed)), lambda p: p.isNotNull()), F.lit(0))
    pair = F.when((own["s"] != "") & (own["t"] != ""), own).otherwise(F.coalesce(F.when((own["t"] == "") & (own["s"] != ""), in_source), anywhere))
    rows = data.withColumn("_p", pair).where("_p is not null and _p.s <> '' and _p.t <> '' and _p.s <> _p.t").where(~F.col("_p.s").rlike(r"^\d+$") & ~F.col("_p.t").rlike(r"^\d+$") & (F.length("_p.s") >= 2) & (F.length("_p.t") >= 2))
    bare = lambda c: _strip(F.regexp_replace(c, r"^(\(\d+\)|\d+[.)\-–—])\s*", ""))
    text = lambda c: F.when(F.col(c).isNotNull(), F.nullif(cell(c), F.lit("")))
    rows = rows.select("file", "sheet", "row_no", bare(F.col("_p.s")).alias("source_term"), bare(F.col("_p.t")).alias("target_term"), text("definition").alias("definition"), F.coalesce(text("context"), F.when(F.col("context").isNull(), F.col("sheet"))).alias("context"))
    language = F.when(marks(F.col("source_term")) & ~marks(F.col("target_term")), "vi").otherwise("en")
    return rows.where("source_term <> '' and target_term <> ''").withColumn("source_language", language)
