"""Presentations as tables: order of slides, nesting of their XML, units with their places, boxes of nested groups, table cells.

Parts of a deck are rows (deck, part, xml). XML becomes events, one for each tag with the text behind it, numbered in
order; what encloses what follows from running depths, however deep shapes are nested: by two window functions over a
part's events (``enclosing``), or, for units, in one reading of the part. A part is one slide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut

PART = ["deck", "part"]

# Order ---------------------------------------------------------------------------------------------------------------


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, null if it has none."""
    return F.regexp_extract(tag, rf'[\s:]{name}="([^"]+)"', 1)


def relationships(parts: DataFrame) -> DataFrame:
    """(deck, source, rid, kind, target): internal relationships of .rels parts; source: the part they belong to, target: a path in the deck."""
    rows = parts.where(F.col("part").endswith(".rels")).select("deck", F.regexp_replace("part", r"(^|/)_rels/([^/]+)\.rels$", "$1$2").alias("source"), F.explode(F.regexp_extract_all("xml", F.lit(r"(<Relationship\s[^>]*>)"), 1)).alias("tag"))
    target = attribute(F.col("tag"), "Target")
    resolved = F.when(target.startswith("/"), F.substring(target, 2, 1 << 20)).otherwise(F.concat(F.lit("ppt/"), F.regexp_replace(target, r"^\.{1,2}/", "")))
    out = rows.where(~F.col("tag").contains('TargetMode="External"')).select("deck", "source", attribute(F.col("tag"), "Id").alias("rid"), F.regexp_extract(attribute(F.col("tag"), "Type"), r"([^/]+)$", 1).alias("kind"), resolved.alias("target"))
    return out.where("rid <> '' and target <> 'ppt/'")


SLIDE = r"^ppt/slides/slide(\d+)\.xml$"


def slide_order(parts: DataFrame) -> DataFrame:
    """SRC08: (deck, part, slide): slides in the order of the presentation's list of ids, each found through the relationships
    (the last one of an id counts); decks whose list leads nowhere by the numbers in their names."""
    slides = parts.where(F.col("part").rlike(SLIDE)).select("deck", "part").distinct()
    ids = parts.where("part = 'ppt/presentation.xml'").select("deck", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(<p:sldId\s[^>]*>)"), 1)).alias("at", "tag")).select("deck", "at", F.regexp_extract("tag", r'\sr:id="([^"]+)"', 1).alias("rid"))
    known = relationships(parts).where("source = 'ppt/presentation.xml' and kind = 'slide'").join(slides.withColumnRenamed("part", "target"), ["deck", "target"], "left_semi")
    known = known.groupBy("deck", "rid").agg(F.max("target").alias("part"))
    listed = ids.join(known, ["deck", "rid"])
    rest = slides.join(listed.select("deck").distinct(), "deck", "left_anti").select("deck", "part", F.regexp_extract("part", SLIDE, 1).cast("long").alias("at"))
    both = listed.select("deck", "part", F.col("at").cast("long").alias("at")).unionByName(rest)
    return both.select("deck", "part", F.row_number().over(Window.partitionBy("deck").orderBy("at", "part")).alias("slide"))


# Nesting -------------------------------------------------------------------------------------------------------------


def events(parts: DataFrame) -> DataFrame:
    """(deck, part, n, tag, name, step, text): tags in order, 1 for an opening one, -1 for a closing one, 0 for an empty one, with the text behind them."""
    rows = parts.select(*PART, F.posexplode(F.regexp_extract_all("xml", F.lit(r"(<[^>]*>[^<]*)"), 1)).alias("n", "token"))
    tag = F.regexp_extract("token", r"^(<[^>]*>)", 1)
    step = F.when(tag.startswith("</"), -1).when(tag.endswith("/>") | tag.rlike(r"^<[?!]"), 0).otherwise(1)
    return rows.select(*PART, "n", tag.alias("tag"), F.regexp_extract(tag, r"^</?([A-Za-z0-9:_]+)", 1).alias("name"), step.alias("step"), F.regexp_extract("token", r"^<[^>]*>([^<]*)", 1).alias("text"))


def enclosing(rows: DataFrame, kinds: list[str], column: str) -> DataFrame:
    """events with ``column``: the number of the innermost open tag of these kinds that holds the event (a tag holds itself), null outside.

    Tags nest, so what is open at depth k is what was opened last at depth k."""
    own = F.when(F.col("name").isin(kinds), F.col("step")).otherwise(0)
    order = Window.partitionBy(*PART).orderBy("n")
    depth = F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.when(own == -1, 1).otherwise(0)
    last = Window.partitionBy(*PART, "_depth").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_opened", F.when(own == 1, F.col("n"))).withColumn("_depth", depth)
    return out.withColumn(column, F.when(F.col("_depth") > 0, F.last("_opened", ignorenulls=True).over(last))).drop("_depth", "_opened")


# fixed values: what a title's shape is told by
TITLE_TYPE, TITLE_NAME = r'\stype="(?:title|ctrTitle)"', r'(?i)\sname="Title(?![A-Za-z0-9_])'
TITLE_TEXT = r"(?iu)(?<![\p{L}\p{N}_])(?:inspection\s*strategy|chiến\s*lược\s*kiểm\s*tra|standard\s*operating\s*procedure|ipqc\s*manual|qa/?ipqc\s*manual)(?![\p{L}\p{N}_])"
SHAPES = ["p:sp", "p:pic", "p:graphicFrame", "a:tc"]


#: What a text that ``TITLE_TEXT`` finds holds; more is not refused.
_MAYBE = re.compile(r"inspection\s*strategy|chiến\s*lược\s*kiểm\s*tra|standard\s*operating\s*procedure|(?:qa/?)?ipqc\s*manual", re.IGNORECASE)
_TOKEN = re.compile(r"(<[^>]*>)([^<]*)")
_NAME = re.compile(r"</?([A-Za-z0-9:_]+)")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


class _Open:
    """What is open of some kinds of tags, as ``enclosing`` tells it: at depth k what was opened last at depth k."""

    def __init__(self):
        self.depth, self.count, self.last = 0, 0, {}

    def step(self, step: int, what) -> None:
        self.depth += step
        if step == 1:
            self.last[self.depth], self.count = (self.count, what), self.count + 1

    def __call__(self) -> tuple | None:
        return self.last.get(self.depth) if self.depth > 0 else None


def _paragraphs(xml: str) -> Iterator[tuple]:
    """(paragraph, text, container, shape, shape_kind, in_table, title by its tags, what may be a title's text) of a part, tag by tag."""
    title_type, title_name = re.compile(TITLE_TYPE, re.ASCII), re.compile(TITLE_NAME, re.ASCII)
    p, body, shape, sp, cell = opened = [_Open() for _ in range(5)]
    kinds = {"a:p": [p], "p:txBody": [body], "a:txBody": [body], "p:sp": [shape, sp], "p:pic": [shape], "p:graphicFrame": [shape], "a:tc": [shape, cell]}
    found, shapes = [], []  # paragraphs with what held them as they were opened; of each p:sp whether its tags are a title's, and its texts
    for tag, text in _TOKEN.findall(xml):
        name = _NAME.match(tag)
        name = name[1] if name else ""
        step = -1 if tag.startswith("</") else 0 if tag.endswith("/>") or tag[1:2] in ("?", "!") else 1
        if name in kinds and step:
            for kind in kinds[name]:
                kind.step(step, name)
            if step == 1 and name == "p:sp":
                shapes.append([False, []])
            elif step == 1 and name == "a:p":
                found.append(([], *(kind() for kind in opened[1:])))
        elif name in ("p:ph", "p:cNvPr"):
            if (held := sp()) and (title_type if name == "p:ph" else title_name).search(tag):
                shapes[held[0]][0] = True
        elif name == "a:t" and step == 1:
            for entity, char in _ENTITIES:
                text = text.replace(entity, char)
            if held := sp():
                shapes[held[0]][1].append(text)
            if held := p():
                found[held[0]][0].append(text)
    titles = []
    for tagged, texts in shapes:
        said = " ".join(texts)
        titles.append((tagged, "\n".join(said[max(0, m.start() - 1) : m.end() + 1] for m in _MAYBE.finditer(said))))
    for i, (texts, held, around, of, inside) in enumerate(found):
        if (text := "".join(texts).strip(" ")) != "":
            yield (i, text, held and held[0], around and around[0], around and around[1], inside is not None, *(titles[of[0]] if of else (False, "")))


def units(parts: DataFrame) -> DataFrame:
    """SRC11: (deck, part, paragraph, text, container, shape, shape_kind, is_title, in_table): non-blank paragraphs.

    container: number of the text body in its part, null outside; shape: number of the innermost shape or cell among its
    part's; a title is a paragraph in a shape that is one by placeholder, name or text, but never in a table cell.
    A part is read once where it stands, and nothing is shuffled."""
    columns = "paragraph int, text string, container int, shape int, shape_kind string, in_table boolean, _tagged boolean, _said string"
    schema = StructType([parts.schema["deck"], parts.schema["part"], *StructType.fromDDL(columns).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, xml in enumerate(b.column(2).to_pylist()):
                if xml is not None:
                    rows += _paragraphs(xml)
                    at += [i] * (len(rows) - len(at))
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], schema.names)

    title = ~F.col("in_table") & (F.col("_tagged") | F.col("_said").rlike(TITLE_TEXT))
    return parts.select(*PART, "xml").mapInArrow(run, schema).select(*PART, "paragraph", "text", "container", "shape", "shape_kind", title.alias("is_title"), "in_table")


RELATED = r"^ppt/(?:notesSlides/notesSlide\d+|diagrams/data\d+)\.xml$"


def related_parts(parts: DataFrame) -> DataFrame:
    """SRC11: (deck, part, related, kind): notes and diagrams of slides, through relationships; a slide without notes gets
    those of its own number, if there are such."""
    there = parts.select("deck", "part").where(F.col("part").rlike(RELATED)).distinct()
    found = relationships(parts).where(F.col("source").rlike(SLIDE) & F.col("kind").isin("notesSlide", "diagramData")).select("deck", F.col("source").alias("part"), F.col("target").alias("related"), "kind").distinct()
    found = found.join(there.withColumnRenamed("part", "related"), ["deck", "related"], "left_semi").select("deck", "part", "related", "kind")
    slides = parts.where(F.col("part").rlike(SLIDE)).select("deck", "part").distinct().join(found.where("kind = 'notesSlide'"), ["deck", "part"], "left_anti")
    guessed = slides.withColumn("related", F.concat(F.lit("ppt/notesSlides/notesSlide"), F.regexp_extract("part", SLIDE, 1), F.lit(".xml"))).withColumn("kind", F.lit("notesSlide"))
    return found.unionByName(guessed.join(there.withColumnRenamed("part", "related"), ["deck", "related"], "left_semi"))


# Boxes ---------------------------------------------------------------------------------------------------------------


def placed(shapes: DataFrame, key: list[str]) -> DataFrame:
    """SRC12: shapes with x, y, w, h in the slide's units, through all groups around them.

    shapes: key, id, parent (an id of the same key, null at the top), x, y, w, h, and for groups child_x, child_y, child_w,
    child_h. A group maps its inside by (x - child_x) * scale + group_x; maps are composed upwards, twice as many levels
    in every round, so a tree of depth d takes log2(d) rounds of one join. Shapes in a ring of parents get null boxes, as
    do those whose parent is not there."""
    scale = lambda own, child: F.when(F.col(child) > 0, F.col(own) / F.col(child)).otherwise(1.0)
    child = lambda c, own: F.coalesce(F.col(c), F.col(own)).cast("double")
    groups = shapes.select(*key, F.col("id").alias("up"), F.col("parent").alias("next"), *(F.col(c).cast("double").alias(c) for c in "xywh"), child("child_x", "x").alias("cx"), child("child_y", "y").alias("cy"), child("child_w", "w").alias("cw"), child("child_h", "h").alias("ch"))
    groups = groups.select(*key, "up", "next", scale("w", "cw").alias("sx"), scale("h", "ch").alias("sy"), "x", "y", "cx", "cy").select(*key, "up", "next", "sx", "sy", (F.col("x") - F.col("cx") * F.col("sx")).alias("tx"), (F.col("y") - F.col("cy") * F.col("sy")).alias("ty"))
    unit = [F.lit(v).alias(c) for c, v in (("sx", 1.0), ("sy", 1.0), ("tx", 0.0), ("ty", 0.0))]
    # what maps the inside of a group to the inside of ``next``, null once that is the slide
    maps = cut(groups)
    nodes = maps.count()
    rounds = 0
    while maps.where("next is not null").limit(1).count() and 1 << rounds <= 2 * nodes:
        above = maps.select(*key, F.col("up").alias("next"), F.col("next").alias("over"), *(F.col(c).alias(f"o{c}") for c in ("sx", "sy", "tx", "ty")))
        joined = maps.join(above, [*key, "next"], "left")
        gone = F.col("next").isNotNull() & F.col("osx").isNull()  # a parent that is not there
        chain = lambda s, t: [F.when(gone, F.lit(None)).otherwise(F.coalesce(f"o{s}", F.lit(1.0)) * F.col(s)).cast("double").alias(s), F.when(gone, F.lit(None)).otherwise(F.coalesce(f"o{s}", F.lit(1.0)) * F.col(t) + F.coalesce(f"o{t}", F.lit(0.0))).cast("double").alias(t)]
        maps = cut(joined.select(*key, "up", F.col("over").alias("next"), *chain("sx", "tx"), *chain("sy", "ty")))
        rounds += 1
    ends = maps.select(*key, F.col("up").alias("parent"), *(F.when(F.col("next").isNull(), F.col(c)).alias(c) for c in ("sx", "sy", "tx", "ty")))
    top = shapes.where("parent is null").select("*", *unit)
    inner = shapes.where("parent is not null").join(ends, [*key, "parent"], "left").select(*shapes.columns, "sx", "sy", "tx", "ty")
    moved = {"x": F.col("sx") * F.col("x") + F.col("tx"), "y": F.col("sy") * F.col("y") + F.col("ty"), "w": F.col("sx") * F.col("w"), "h": F.col("sy") * F.col("h")}
    return top.unionByName(inner).withColumns({f"slide_{c}": e for c, e in moved.items()}).drop("sx", "sy", "tx", "ty")


def percent_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """boxes with left, top, width, height in percent of the slide, at least 0.5 wide and high, to a tenth."""
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    left, top = (F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(f"slide_{c}") / size * 100)) for c, size in (("x", width), ("y", height)))
    size = lambda c, whole, at: F.greatest(F.lit(0.5), F.least(100 - at, F.col(f"slide_{c}") / whole * 100))
    known = F.col("slide_x").isNotNull()
    return boxes.select("*", *(F.when(known, tenth(c)).alias(n) for n, c in (("left", left), ("top", top), ("width", size("w", width, left)), ("height", size("h", height, top)))))


def table_cells(frames: DataFrame) -> DataFrame:
    """SRC12: cells of tables as boxes within the frame: frames with row, col, row_span, col_span, cell_x, cell_y, cell_w, cell_h.

    frames: x, y, w, h, columns (widths), and rows: array of (height, cells: array of (row_span, col_span, merged)). Widths
    are scaled to the frame's; heights grow with the rows and are scaled up to the frame's if that is higher; cells that
    belong to a merged one are left out; a table without widths or heights is cut evenly."""
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    total = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, v: s + F.coalesce(v, F.lit(0)).cast("double"))
    heights = F.transform("rows", lambda r: F.greatest(F.coalesce(r["height"], F.lit(0)), F.lit(0)))
    cells = frames.withColumn("_heights", heights).withColumns({"_grid_w": F.coalesce(F.nullif(total(F.col("columns")), F.lit(0.0)), F.col("w").cast("double")), "_grid_h": F.coalesce(F.nullif(total(F.col("_heights")), F.lit(0.0)), F.col("h").cast("double"))})
    cells = cells.select("*", F.posexplode("rows").alias("row", "_row")).select("*", F.posexplode("_row.cells").alias("col", "_cell")).where(~F.coalesce("_cell.merged", F.lit(False)))
    cells = cells.withColumns({"row_span": F.greatest(F.lit(1), F.coalesce("_cell.row_span", F.lit(1))), "col_span": F.greatest(F.lit(1), F.coalesce("_cell.col_span", F.lit(1)))})
    x_scale, y_scale = F.col("w") / F.col("_grid_w"), F.when(F.col("_grid_h") > 0, F.greatest(F.col("h").cast("double"), F.col("_grid_h")) / F.col("_grid_h")).otherwise(1.0)
    x_scale = F.coalesce(x_scale, F.col("w").cast("double"))  # a frame of no width and no columns
    in_row, rows = F.greatest(F.size("_row.cells"), F.lit(1)), F.greatest(F.size("rows"), F.lit(1))
    part = lambda a, at, n: total(F.slice(a, at + 1, n))
    span_w, span_h = F.nullif(part("columns", F.col("col"), F.col("col_span")), F.lit(0.0)), F.nullif(part("_heights", F.col("row"), F.col("row_span")), F.lit(0.0))
    span_w, span_h = F.coalesce(span_w, half_up(F.col("col_span") * F.col("w") / in_row).cast("double")), F.coalesce(span_h, half_up(F.col("row_span") * F.col("h") / rows).cast("double"))
    at_x = F.when(F.col("col") < F.size("columns"), total(F.slice("columns", 1, F.col("col")))).otherwise(half_up(F.col("col") * F.col("w") / in_row).cast("double"))
    at_y = total(F.slice("_heights", 1, F.col("row")))
    out = cells.withColumns({"cell_x": F.col("x") + half_up(at_x * x_scale), "cell_y": F.col("y") + half_up(at_y * y_scale), "cell_w": half_up(span_w * x_scale), "cell_h": half_up(span_h * y_scale)})
    return out.drop("_heights", "_grid_w", "_grid_h", "_row", "_cell", "rows", "columns")
