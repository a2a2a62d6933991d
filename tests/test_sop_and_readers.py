"""Concise mode, compliance, post-flight repair and document readers: cases with known answers, and awkward rows."""

from pyspark.sql import functions as F
from termloom.operators import compliance as K
from termloom.operators import concise as S
from termloom.operators import quality as Q
from termloom.operators import readers as R
from termloom.operators import slides as SL


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


def test_entities(spark):
    keys = lambda t: {(x["type"], x["key"]) for x in one(spark, S.entities, t)}
    assert {("measurement", "2.5kg"), ("measurement", "15s"), ("measurement", "0.5mm")} <= keys("Kiểm tra sau khi ép đáy với lực 2.5kg trong 15s, khe hở không quá 0.5mm, 15 s")
    assert ("range", "9-10") in keys("mật độ 9-10 mũi/inch") and ("standard", "qamanual") in keys("theo QA manual")
    assert sum(k == "defect" for k, _ in keys("không bị đứt chỉ, nổi chỉ, bỏ mũi, lệch biên")) == 4
    assert keys("") == set() and one(spark, S.entities, None) == []


def test_eligibility_and_coverage(spark):
    mode = lambda t: one(spark, lambda c: S.eligibility(c, S.entities(c)), t)
    assert mode("Dán đế") == "too short" and mode(None) == "too short"
    assert mode("Kiểm tra không bị đứt chỉ, nổi chỉ, bỏ mũi, lệch biên, nhảy chỉ, hở keo sau khi may") == "complex"
    assert mode("Quét keo đều lên bề mặt đã được xử lý rồi để khô tự nhiên theo đúng hướng dẫn của chuyền trưởng") == "eligible"
    assert mode("Bề mặt phẳng thì được chấp nhận mức độ nhẹ theo hình mẫu treo tại chuyền") == "acceptance clause"
    lost = lambda a, b: one(spark, lambda x, y: F.array_join(F.transform(S.missing(y, S.entities(x)), lambda e: e["key"]), ","), a, b)
    assert lost("9-10 mũi/inch ở gót, cách 2 mm, PFC", "9 to 10 at the heel, 2.0 mm, PFC") == "mũi" and lost("hở keo", "bond gap") == "" and lost("hở keo", None) == "hở keo"
    assert one(spark, lambda x, y: S.coverage(S.entities(x), S.missing(y, S.entities(x))), "2 mm và 3 mm", "2 mm") == 50
    assert one(spark, lambda x, y: S.rolls_back(S.missing(y, S.entities(x))), "ở gót", "there") is False


def test_compliance(spark):
    broken = lambda t: one(spark, K.violations, t)
    assert broken("Nosew tip quarter, 9 SPI, đế") == ["no-sew", "tip-quarter", "spi", "leak"] and broken("no-sew Tip-quarter SPI 9 stitches/inch") == [] and broken(None) == []
    fixed = lambda t: one(spark, lambda c: K.mended(c)["text"], t)
    assert fixed("Check with 9-10 SPI") == "Check if SPI 9-10 stitches/inch" and fixed("Kiểm tra aplly") == "Kiểm tra aplly" and fixed(None) == ""


def test_rogue_headings(spark):
    rows = [("a", 1, "1. Cut"), ("a", 2, "*Lacing"), ("a", 3, "2. Sew"), ("a", 4, "*Lacing"), ("a", 5, "x"), ("a", 6, "*lacing "), ("b", 1, "*H"), ("b", 2, "*H"), ("c", 1, "*H"), ("c", 2, None), ("c", 3, "*H"), ("c", 4, "2) a"), ("c", 5, "*K"), ("c", 6, "1) b")]
    df = spark.createDataFrame(rows, "body string, para_no int, text string").selectExpr("*", "1 as n", "2 as t")
    assert sorted(map(tuple, K.rogue_headings(df).collect())) == [("a", 2), ("a", 6), ("c", 3)]


def test_docx(spark):
    p = lambda t, level="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="Heading{level}"/>""" if level else ""}</w:pPr><w:r><w:t>{t[:2]}</w:t></w:r><w:r><w:t xml:space="preserve">{t[2:]}</w:t></w:r></w:p>'
    xml = p("before") + p("One", 1) + p("Two", 2) + p("text a") + p(" ") + p("text b") + p("Three", 1)
    files = spark.createDataFrame([("f", xml, 1), ("g", None, 1), ("h", "<w:p/>", 1)], "file string, xml string, level int")
    rows = R.sections(R.docx_paragraphs(files)).orderBy("section").collect()
    assert [(r.file, r.section, r.title, r.level, r.content) for r in rows] == [("f", 1, "Introduction", 1, "before"), ("f", 2, "Two", 2, "text a\ntext b")]


def test_slides_in_numeric_order(spark):
    t = lambda *x: "".join(f"<a:t>{y}</a:t>" for y in x)
    parts = [("f", "ppt/slides/slide10.xml", t("ten", "b")), ("f", "ppt/slides/slide2.xml", t(" two ")), ("f", "ppt/slides/slide3.xml", t(" ")), ("f", "ppt/notes/n1.xml", t("no")), ("f", "ppt/slides/slide4.xml", None)]
    rows = R.slides(spark.createDataFrame(parts, "file string, path string, xml string")).orderBy("slide").collect()
    assert [(r.slide, r.title, r.content) for r in rows] == [(1, "two", "two"), (4, "ten", "b")]


def test_pages_and_candidates(spark):
    files = spark.createDataFrame([("f", "Title line\nTerm: nghĩa\n\n\nsecond page\fthird: ab\n" + "z" * 60), ("s", "short"), ("n", None)], "file string, text string")
    rows = R.pages(files).orderBy("file", "page").collect()
    assert [(r.file, r.page, r.title, r.scanned) for r in rows] == [("f", 1, "Title line", False), ("f", 2, "second page", False), ("f", 3, "third: ab", False), ("s", 1, "short", True)]
    lines = spark.createDataFrame([("Term: nghĩa",), ("http x: y z",), ("ab: cd",), (None,), ("Long dash — here",)], "text string")
    assert sorted((r.source_term, r.target_term) for r in R.candidates(lines).collect()) == [("Long dash", "here"), ("Term", "nghĩa")]


def test_sheets(spark):
    grid = [
        ("a", "s", 0, ["No", "English", "VN"]), ("a", "s", 1, ["1", "2. gap", "khe"]), ("a", "s", 2, ["2", "x", ""]), ("a", "s", 3, ["3", "", "mũi\ntoe"]), ("a", "s", 4, [None, "  ", ""]), ("a", "s", 5, ["5", "12", "13"]),
        *(("b", "s", i, [str(i), f"term {i}", f"nghĩa {i}"]) for i in range(1, 8)), ("b", "s", 0, ["k", "p", "q"]), ("c", "s", 0, ["only"]), ("c", "s", 1, ["x"]),
    ]
    df = spark.createDataFrame(grid, "file string, sheet string, row_no long, cells array<string>")
    roles = {r.file: (r.source, r.target) for r in R.column_roles(df).collect()}
    assert roles == {"a": (1, 2), "b": (1, 2), "c": (None, None)}
    terms = sorted((r.row_no, r.source_term, r.target_term, r.source_language) for r in R.sheet_terms(df).where("file = 'a'").collect())
    assert terms == [(1, "gap", "khe", "en"), (3, "toe", "mũi", "en")]
    assert R.sheet_terms(df.limit(0)).collect() == []


def deck(spark, rows):
    return spark.createDataFrame([("f", i, t, p) for i, (t, p) in enumerate(rows, 1)], "file string, slide int, texts array<string>, probe string").selectExpr("*", "1 as step", "2 as a")


EN, VI = "Apply the cement on the midsole surface evenly", "Quét keo đều lên bề mặt đế giữa của giày"


def test_neighbouring_slides_pair(spark):
    rows = [(["1.EN Cement line", EN, EN], None), (["1.VI Cement line", VI, VI], "apply cement evenly midsole surface"), (["2.EN Press", "Press the sole at 30 kg for long"], None), (["2.VI Press", "Ép đế với lực lớn vừa đủ"], "press sole with force"), (None, None), (["x", None], None)]
    assert sorted(map(tuple, SL.pairs(deck(spark, rows)).collect())) == [("f", 1, 2), ("f", 3, 4)]
    assert SL.pairs(deck(spark, rows).limit(0)).collect() == []


def test_distant_slides_pair_by_score(spark):
    far = [(["Kiểm tra gót", "Kiểm tra đường may ở gót giày 2.5 mm"], "inspect stitching seam heel 2.5 mm"), (["Ép nhiệt", "Ép nhiệt bằng máy ở 110 độ"], "heat pressing machine 110 degree"), (["Heel seam", "Inspect stitching of the heel seam 2.5 mm"], None), (["Heating", "Heat pressing with the machine 110"], None), (["Packing"], None), (["Labels here"], None)]
    assert sorted(map(tuple, SL.pairs(deck(spark, far)).collect())) == [("f", 3, 1), ("f", 4, 2)]


def test_slides_with_conflicts_do_not_pair(spark):
    rows = [(["CTQ 1 EN", "Toe shape is even all over the shoe"], None), (["CTQ 1 VI", "Hình dạng gót đều nhau trên đôi giày"], "toe shape even shoe")]
    assert SL.pairs(deck(spark, rows)).collect() == []


def test_instruction_issues(spark):
    assert one(spark, Q.instruction_issues, None, "Check if the toe") == ["incomplete_condition"] and one(spark, Q.instruction_issues, None, None) == []
    assert one(spark, Q.instruction_issues, "Kiểm tra 5 mm", "Press.") == ["incomplete_instruction", "check_if_required", "missing_measurement"]
    assert one(spark, Q.instruction_issues, "Kiểm tra mũi", "1. Check if the toe is even") == []
