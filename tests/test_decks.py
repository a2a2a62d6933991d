"""Decks by hand: order, nesting, units, relations, boxes of nested groups, cells of tables."""

import random

import pytest
from pyspark.sql import functions as F
from termloom.operators import decks as D

REL = '<Relationship Id="{}" Type="http://x/{}" Target="{}"{}/>'


def parts(spark, rows):
    return spark.createDataFrame(rows, "deck long, part string, xml string").repartition(3)


def test_order_through_relationships_and_by_number(spark):
    rels = REL.format("rId2", "slide", "slides/slide10.xml", "") + REL.format("rId7", "slide", "/ppt/slides/slide2.xml", "") + REL.format("rId3", "slide", "slides/slide3.xml", ' TargetMode="External"') + REL.format("rId4", "slideLayout", "slides/slide3.xml", "") + REL.format("rId5", "slide", "slides/gone.xml", "") + REL.format("rId6", "slide", "./slides/slide1.xml", "")
    ids = "".join(f'<p:sldId id="{i}" r:id="rId{k}"/>' for i, k in enumerate((6, 3, 7, 5, 2, 9)))
    slides = [(d, f"ppt/slides/slide{n}.xml", "<x/>") for d in (1, 2, 3) for n in (1, 2, 3, 10)]
    rows = [*slides, (1, "ppt/_rels/presentation.xml.rels", rels), (1, "ppt/presentation.xml", ids), (2, "ppt/presentation.xml", ids), (3, "ppt/_rels/presentation.xml.rels", rels), (4, "ppt/presentation.xml", ids), (5, None, None)]
    got = {}
    for r in D.slide_order(parts(spark, rows)).orderBy("deck", "slide").collect():
        got.setdefault(r.deck, []).append(r.part[len("ppt/slides/slide") : -4])
    assert got == {1: ["1", "2", "10"], 2: ["1", "2", "3", "10"], 3: ["1", "2", "3", "10"]}
    assert D.slide_order(parts(spark, [])).collect() == []


def test_related_parts(spark):
    rels = REL.format("a", "notesSlide", "../notesSlides/notesSlide9.xml", "") + REL.format("b", "diagramData", "/ppt/diagrams/data4.xml", "") + REL.format("c", "notesSlide", "../../secret.xml", "") + REL.format("d", "diagramData", "../diagrams/data5.xml", "")
    rows = [(1, "ppt/slides/slide1.xml", ""), (1, "ppt/slides/_rels/slide1.xml.rels", rels), (1, "ppt/slides/slide2.xml", ""), (1, "ppt/slides/slide3.xml", ""), *((1, f"ppt/notesSlides/notesSlide{n}.xml", "") for n in (1, 2, 9)), (1, "ppt/diagrams/data4.xml", ""), (1, "secret.xml", "")]
    got = sorted((r.part[-10:-4], r.related.split("/")[-1]) for r in D.related_parts(parts(spark, rows)).collect())
    assert got == [("slide1", "data4.xml"), ("slide1", "notesSlide9.xml"), ("slide2", "notesSlide2.xml")]


def test_units_of_nested_shapes(spark):
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    xml = (
        '<?xml version="1.0"?><p:sld>' + p("outside") + '<p:sp><p:nvSpPr><p:cNvPr id="1" name="Titles"/></p:nvSpPr><p:txBody>' + p("plain") + "<a:p/>" + p("  ") + '<a:p><a:r><a:t xml:space="preserve">two </a:t></a:r><a:r><a:t>runs &amp; more</a:t></a:r></a:p></p:txBody></p:sp>'
        '<p:grpSp><p:grpSp><p:sp><p:nvSpPr><p:cNvPr id="2" name="title 3"/></p:nvSpPr><p:txBody>' + p("deep title") + '</p:txBody></p:sp></p:grpSp><p:sp><p:ph type="subTitle"/><p:txBody>' + p("Our Inspection  Strategy") + "</p:txBody></p:sp></p:grpSp>"
        '<p:graphicFrame><p:ph type="title"/><a:tbl><a:tr><a:tc><a:txBody>' + p("inspection strategy") + "</a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame></p:sld>"
    )
    got = [tuple(r)[2:] for r in D.units(parts(spark, [(1, "s", xml), (2, "s", None), (3, "s", "no tags")])).orderBy("paragraph").collect()]
    assert got == [
        (0, "outside", None, None, None, False, False), (1, "plain", 0, 0, "p:sp", False, False), (3, "two runs & more", 0, 0, "p:sp", False, False), (4, "deep title", 1, 1, "p:sp", True, False),
        (5, "Our Inspection  Strategy", 2, 2, "p:sp", True, False), (6, "inspection strategy", 3, 4, "a:tc", False, True),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_enclosing_against_a_stack(spark, seed):
    rng, xml, names = random.Random(seed), [], []
    for _ in range(400):
        if names and rng.random() < 0.45:
            xml.append(f"</{names.pop()}>")
        elif rng.random() < 0.2:
            xml.append("<a:b/>")
        else:
            names.append(rng.choice(["a:b", "a:c", "p:d"]))
            xml.append(f"<{names[-1]}>")
    xml += [f"</{n}>" for n in reversed(names)]
    rows = D.enclosing(D.events(parts(spark, [(1, "s", "".join(xml))])), ["a:b", "p:d"], "x").orderBy("n").collect()
    stack = []
    for n, (tag, r) in enumerate(zip(xml, rows)):
        name = tag.strip("</>")
        if not tag.startswith("</") and not tag.endswith("/>"):
            stack.append((name, n))
        assert (r.n, r.x) == (n, next((i for m, i in reversed(stack) if m in ("a:b", "p:d")), None))
        if tag.startswith("</"):
            stack.pop()


def test_boxes_of_nested_groups_against_folding(spark):
    rng, rows = random.Random(4), []
    for deck in range(6):
        for i in range(40):
            parent = None if i == 0 or rng.random() < 0.1 else rng.randrange(i) if deck else i - 1
            rows.append((deck, i, parent, *(rng.randint(-50, 900) for _ in range(2)), *(rng.randint(1, 900) for _ in range(2)), *(rng.choice([None, rng.randint(-9, 99)]) for _ in range(2)), *(rng.choice([None, 0, rng.randint(200, 999)]) for _ in range(2))))
    rows += [(9, 0, 1, *[1] * 8), (9, 1, 0, *[1] * 8), (9, 2, 1, *[1] * 8), (9, 3, 7, *[1] * 8), (9, 4, 4, *[1] * 8), (9, 5, 3, *[1] * 8)]
    names = "x y w h child_x child_y child_w child_h".split()
    df = spark.createDataFrame(rows, "deck long, id long, parent long, " + ", ".join(f"{n} long" for n in names)).repartition(3)
    of = {(r[0], r[1]): dict(zip(names, r[3:])) | {"parent": r[2]} for r in rows}
    for r in D.percent_boxes(D.placed(df, ["deck"]), F.lit(960.0), F.lit(540.0)).collect():
        if r.deck == 9:
            assert r.slide_x is None and r.left is None
            continue
        s = of[r.deck, r.id]
        x, y, w, h = (float(s[n]) for n in "xywh")
        while s["parent"] is not None:
            s = of[r.deck, s["parent"]]
            child = {n: s[n] if s[f"child_{n}"] is None else s[f"child_{n}"] for n in "xywh"}
            sx, sy = (s[n] / child[n] if child[n] > 0 else 1.0 for n in "wh")
            x, y, w, h = s["x"] + (x - child["x"]) * sx, s["y"] + (y - child["y"]) * sy, w * sx, h * sy
        assert (r.slide_x, r.slide_y, r.slide_w, r.slide_h) == pytest.approx((x, y, w, h), rel=1e-9, abs=1e-6)
        left = max(0, min(100, x / 960 * 100))
        assert abs(r.left - left) <= 0.0501 and abs(r.width - max(0.5, min(100 - left, w / 960 * 100))) <= 0.0501
    assert D.placed(df.limit(0), ["deck"]).collect() == []


def test_cells_with_merges_and_without_a_grid(spark):
    cell = lambda rs=1, cs=1, m=False: (rs, cs, m)
    rows = [
        (1, 10, 20, 300, 100, [100, 50], [(10, [cell(2), cell()]), (30, [cell(m=True), cell()])]),
        (2, 0, 0, 90, 60, [], [(0, [cell(), cell(cs=2), cell(m=True)]), (0, [cell()])]),
        (3, 0, 0, 50, 10, [50], [(40, [cell()])]),
        (4, 0, 0, 50, 10, [50], []),
    ]
    df = spark.createDataFrame(rows, "frame long, x long, y long, w long, h long, columns array<long>, rows array<struct<height: long, cells: array<struct<row_span: int, col_span: int, merged: boolean>>>>")
    got = sorted((r.frame, r.row, r.col, r.cell_x, r.cell_y, r.cell_w, r.cell_h) for r in D.table_cells(df).collect())
    assert got == [(1, 0, 0, 10, 20, 200, 100), (1, 0, 1, 210, 20, 100, 25), (1, 1, 1, 210, 45, 100, 75), (2, 0, 0, 0, 0, 30, 30), (2, 0, 1, 30, 0, 60, 30), (2, 1, 0, 0, 0, 90, 30), (3, 0, 0, 0, 0, 50, 40)]
