"""Queries of presentations: the tables' lines written as the XML of decks and read back, nested boxes, table cells; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..operators import decks as D
from . import base as B

QUERIES, ORACLES = {}, {}


def lines(s, d):
    """(deck, slide, j, n, file, text): five lines a slide; files are numbered backwards in even decks."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = catalog.units(s, d).withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.floor((F.count("*").over(Window.partitionBy("doc_id")) + 4) / 5))
    slide = F.floor(F.col("r") / 5)
    return rows.select(F.col("doc_id").alias("deck"), slide.alias("slide"), (F.col("r") % 5).alias("j"), "n", F.when(F.col("doc_id") % 2 == 0, F.col("n") - slide).otherwise(slide + 1).alias("file"), "text")


LINES = """lines AS (SELECT doc_id AS deck, r // 5 AS slide, r % 5 AS j, n, CASE WHEN doc_id % 2 = 0 THEN n - r // 5 ELSE r // 5 + 1 END AS file, text
  FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS r, (count(*) OVER (PARTITION BY doc_id) + 4) // 5 AS n FROM units))"""


def parts(s, d):
    """(deck, part, xml): slides with a box (a title in some), a group of a box with two paragraphs, and a table of two cells; notes
    of odd slides; relationships; the list of slides, which every fifth deck lacks."""
    body = F.concat(F.lit("<a:p><a:r><a:t>"), F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</a:t></a:r></a:p>"))
    rows = lines(s, d).groupBy("deck", "slide", "n", "file").agg(*(F.max(F.when(F.col("j") == j, body)).alias(f"b{j}") for j in range(5)))
    name = F.when(F.col("slide") % 2 == 0, '<p:cNvPr id="1" name="Title 1"/>').otherwise('<p:cNvPr id="1" name="Box 1"/>')
    holder = F.when(F.col("slide") % 3 == 0, '<p:nvPr><p:ph type="ctrTitle"/></p:nvPr>').otherwise("")
    first = F.concat(F.lit("<p:sp><p:nvSpPr>"), name, holder, F.lit("</p:nvSpPr><p:txBody><a:bodyPr/>"), "b0", F.lit("</p:txBody></p:sp>"))
    group = F.concat(F.lit("<p:grpSp><p:grpSpPr/><p:sp><p:txBody>"), "b1", F.coalesce("b2", F.lit("")), F.lit("<a:p/></p:txBody></p:sp></p:grpSp>"))
    cell = lambda b: F.concat(F.lit("<a:tc><a:txBody>"), b, F.lit("</a:txBody><a:tcPr/></a:tc>"))
    frame = F.concat(F.lit('<p:graphicFrame><a:tbl><a:tr h="1">'), cell("b3"), F.coalesce(cell("b4"), F.lit("")), F.lit("</a:tr></a:tbl></p:graphicFrame>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><p:sld><p:spTree>'), first, F.coalesce(group, F.lit("")), F.coalesce(frame, F.lit("")), F.lit("</p:spTree></p:sld>"))
    path = lambda before, after: F.concat(F.lit(before), F.col("file").cast("string"), F.lit(after))
    slides = rows.select("deck", path("ppt/slides/slide", ".xml").alias("part"), xml.alias("xml"))
    odd = rows.where("slide % 2 = 1")
    notes = odd.select("deck", path("ppt/notesSlides/notesSlide", "0.xml").alias("part"), F.concat(F.lit("<p:notes>"), "b0", F.lit("</p:notes>")).alias("xml"))
    links = odd.select("deck", path("ppt/slides/_rels/slide", ".xml.rels").alias("part"), F.concat(F.lit('<Relationships><Relationship Id="rId1" Type="http://x/relationships/notesSlide" Target="../notesSlides/notesSlide'), F.col("file").cast("string"), F.lit('0.xml"/><Relationship Id="rId2" Type="http://x/relationships/image" Target="../media/a.png"/></Relationships>')).alias("xml"))
    by = F.array_sort(F.collect_list(F.struct("slide", "file")))
    joined = lambda f: F.array_join(F.transform("l", f), "")
    listed = rows.where("deck % 5 <> 0").groupBy("deck").agg(by.alias("l"))
    text = lambda c: (c * 3 + 1).cast("long").cast("string")
    presentation = listed.select("deck", F.lit("ppt/presentation.xml").alias("part"), F.concat(F.lit("<p:presentation><p:sldIdLst>"), joined(lambda x: F.concat(F.lit('<p:sldId id="9" r:id="rId'), text(x["slide"]), F.lit('"/>'))), F.lit("</p:sldIdLst></p:presentation>")).alias("xml"))
    order = listed.select("deck", F.lit("ppt/_rels/presentation.xml.rels").alias("part"), F.concat(F.lit("<Relationships>"), joined(lambda x: F.concat(F.lit('<Relationship Id="rId'), text(x["slide"]), F.lit('" Type="http://x/relationships/slide" Target="slides/slide'), x["file"].cast("string"), F.lit('.xml"/>'))), F.lit("</Relationships>")).alias("xml"))
    return slides.unionByName(notes).unionByName(links).unionByName(presentation).unionByName(order)


QUERIES["src08_slide_order"] = lambda s, d: D.slide_order(parts(s, d))
ORACLES["src08_slide_order"] = B.with_(B.UNITS, LINES) + "SELECT DISTINCT deck, 'ppt/slides/slide' || file || '.xml' AS part, CAST(CASE WHEN deck % 5 = 0 THEN file ELSE slide + 1 END AS INTEGER) AS slide FROM lines"

QUERIES["src11_units"] = lambda s, d: D.units(parts(s, d).where(F.col("part").rlike(D.SLIDE))).select("deck", "part", "paragraph", F.md5("text").alias("text"), "container", "shape", "shape_kind", "is_title", "in_table")
ORACLES["src11_units"] = B.with_(B.UNITS, LINES) + """SELECT deck, 'ppt/slides/slide' || file || '.xml' AS part, CAST(j AS INTEGER) AS paragraph, md5(trim(text)) AS text,
  CAST([0, 1, 1, 2, 3][j + 1] AS INTEGER) AS container, CAST([0, 1, 1, 3, 4][j + 1] AS INTEGER) AS shape, CASE WHEN j < 3 THEN 'p:sp' ELSE 'a:tc' END AS shape_kind, j = 0 AND (slide % 2 = 0 OR slide % 3 = 0) AS is_title, j > 2 AS in_table FROM lines"""

QUERIES["src11_related_parts"] = lambda s, d: D.related_parts(parts(s, d))
ORACLES["src11_related_parts"] = B.with_(B.UNITS, LINES) + "SELECT deck, 'ppt/slides/slide' || file || '.xml' AS part, 'ppt/notesSlides/notesSlide' || file || '0.xml' AS related, 'notesSlide' AS kind FROM lines WHERE slide % 2 = 1 GROUP BY deck, file UNION SELECT a.deck, 'ppt/slides/slide' || a.file || '.xml', 'ppt/notesSlides/notesSlide' || a.file || '.xml', 'notesSlide' FROM lines a JOIN lines b ON a.deck = b.deck AND b.slide % 2 = 1 AND a.file = b.file * 10 WHERE a.slide % 2 = 0"


def shapes(s, d):
    """(deck, id, parent, x ... child_h): parts as groups in groups: binary trees, chains, and rings without a top."""
    k, size = F.col("p_partkey"), F.col("p_size")
    i = k % 200
    deck = F.floor(k / 200)
    parent = F.when((deck % 4 == 3) & (i < 3), (i + 1) % 3).when(i == 0, None).when(deck % 4 == 1, i - 1).when((deck % 4 == 2) & (i == 7), 999).otherwise(F.floor((i - 1) / 2))
    w = size + 50
    return catalog.table(s, d, "part").select(deck.alias("deck"), i.alias("id"), parent.cast("long").alias("parent"), (size * 3).alias("x"), (size + i).alias("y"), w.alias("w"), (w + 8).alias("h"), (size % 5).alias("child_x"), F.when(i % 6 != 0, size % 9).alias("child_y"), F.when(i % 10 == 0, w * 2).when(i % 9 == 4, 0).otherwise(w).alias("child_w"), F.when(i % 7 == 3, (w + 8) * 2).alias("child_h"))


QUERIES["src12_nested_boxes"] = lambda s, d: D.percent_boxes(D.placed(shapes(s, d), ["deck"]), F.lit(1024.0), F.lit(768.0)).select("deck", "id", "slide_x", "slide_y", "slide_w", "slide_h", "left", "top", "width", "height")
ORACLES["src12_nested_boxes"] = """
WITH RECURSIVE p AS (SELECT p_partkey // 200 AS deck, p_partkey % 200 AS id, p_size AS s FROM part),
shapes AS (SELECT deck, id, CASE WHEN deck % 4 = 3 AND id < 3 THEN (id + 1) % 3 WHEN id = 0 THEN NULL WHEN deck % 4 = 1 THEN id - 1 WHEN deck % 4 = 2 AND id = 7 THEN 999 ELSE (id - 1) // 2 END AS parent, s * 3.0::DOUBLE AS x, s + id * 1.0::DOUBLE AS y, s + 50.0::DOUBLE AS w, s + 58.0::DOUBLE AS h,
  s % 5 AS cx, CASE WHEN id % 6 <> 0 THEN s % 9 ELSE s + id END AS cy, CASE WHEN id % 10 = 0 THEN (s + 50) * 2 WHEN id % 9 = 4 THEN 0 ELSE s + 50 END AS cw, CASE WHEN id % 7 = 3 THEN (s + 58) * 2 ELSE s + 58 END AS ch FROM p),
up AS (SELECT deck, id, parent, x, y, w, h, 0 AS d FROM shapes UNION ALL
  SELECT u.deck, u.id, g.parent, g.x + (u.x - g.cx) * sx, g.y + (u.y - g.cy) * sy, u.w * sx, u.h * sy, d + 1 FROM up u JOIN (SELECT *, CASE WHEN cw > 0 THEN w / cw ELSE 1.0 END AS sx, CASE WHEN ch > 0 THEN h / ch ELSE 1.0 END AS sy FROM shapes) g ON u.deck = g.deck AND u.parent = g.id WHERE d < 400),
done AS (SELECT deck, id, x, y, w, h, greatest(0.0, least(100.0, x / 1024.0 * 100)) AS l, greatest(0.0, least(100.0, y / 768.0 * 100)) AS t FROM up WHERE parent IS NULL)
SELECT s.deck, s.id, d.x AS slide_x, d.y AS slide_y, d.w AS slide_w, d.h AS slide_h, floor(l * 10 + 0.5) / 10 AS "left", floor(t * 10 + 0.5) / 10 AS top, CASE WHEN d.id IS NOT NULL THEN floor(greatest(0.5, least(100 - l, d.w / 1024.0 * 100)) * 10 + 0.5) / 10 END AS width, CASE WHEN d.id IS NOT NULL THEN floor(greatest(0.5, least(100 - t, d.h / 768.0 * 100)) * 10 + 0.5) / 10 END AS height
FROM shapes s LEFT JOIN done d USING (deck, id)"""


def frames(s, d):
    k = F.col("o_orderkey")
    upto = lambda n: F.sequence(F.lit(0), n.cast("int"))
    columns = F.when(k % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(upto(k % 5), lambda i: (k * 7 + i * 13) % 50 + 10))
    rows = F.transform(upto(k % 4), lambda i: F.struct(F.when(k % 13 == 0, 0).otherwise((k * 3 + i * 11) % 40).alias("height"), F.transform(upto((k + i) % 5), lambda j: F.struct((1 + (k + i + j) % 2).alias("row_span"), (1 + (k + j) % 3).alias("col_span"), ((k + i * 2 + j) % 7 == 0).alias("merged"))).alias("cells")))
    return catalog.table(s, d, "orders").select(k.alias("frame"), (k % 300).alias("x"), (k % 200).alias("y"), (k % 400 + 20).alias("w"), (k % 90 + 5).alias("h"), columns.alias("columns"), rows.alias("rows"))


QUERIES["src12_table_cells"] = lambda s, d: D.table_cells(frames(s, d)).select("frame", "row", "col", "cell_x", "cell_y", "cell_w", "cell_h")
ORACLES["src12_table_cells"] = """
WITH f AS (SELECT o_orderkey AS k, o_orderkey % 300 AS x, o_orderkey % 200 AS y, o_orderkey % 400 + 20 AS w, o_orderkey % 90 + 5 AS h FROM orders),
g AS (SELECT *, CASE WHEN k % 11 = 0 THEN [] ELSE [(k * 7 + i * 13) % 50 + 10 FOR i IN range(0, k % 5 + 1)] END AS cols, [CASE WHEN k % 13 = 0 THEN 0 ELSE (k * 3 + i * 11) % 40 END FOR i IN range(0, k % 4 + 1)] AS hs FROM f),
c AS (SELECT *, unnest(range(0, (k + r) % 5 + 1)) AS j FROM (SELECT *, unnest(range(0, k % 4 + 1)) AS r FROM g)),
m AS (SELECT *, coalesce(nullif(list_sum(cols), 0), w)::DOUBLE AS gw, coalesce(nullif(list_sum(hs), 0), h)::DOUBLE AS gh, 1 + (k + r + j) % 2 AS rs, 1 + (k + j) % 3 AS cs, (k + r) % 5 + 1 AS cells FROM c WHERE (k + r * 2 + j) % 7 <> 0)
SELECT k AS frame, CAST(r AS INTEGER) AS "row", CAST(j AS INTEGER) AS col,
  CAST(x + floor((CASE WHEN j < len(cols) THEN coalesce(list_sum(cols[1:j]), 0)::DOUBLE ELSE floor(j * w / cells + 0.5) END) * (w / gw) + 0.5) AS BIGINT) AS cell_x,
  CAST(y + floor(coalesce(list_sum(hs[1:r]), 0)::DOUBLE * (greatest(h, gh) / gh) + 0.5) AS BIGINT) AS cell_y,
  CAST(floor(coalesce(nullif(list_sum(cols[j + 1:j + cs])::DOUBLE, 0), floor(cs * w / cells + 0.5)) * (w / gw) + 0.5) AS BIGINT) AS cell_w,
  CAST(floor(coalesce(nullif(list_sum(hs[r + 1:r + rs])::DOUBLE, 0), floor(rs * h / (k % 4 + 1) + 0.5)) * (greatest(h, gh) / gh) + 0.5) AS BIGINT) AS cell_h
FROM m"""
