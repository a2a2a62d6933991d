"""Language, code, name, stage and error predicates, and the ladders on top of them: cases with known answers, and awkward rows."""

import pytest
from pyspark.sql import functions as F
from termloom.functions import language as L
from termloom.functions import predicates as P
from termloom.operators import classify as C

AWKWARD = [None, "", "   ", "\n", "x" * 60_000, "từ " * 9000, "a", "a"]


def answers(spark, column, texts, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("out", column(F.col("text"))).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


CASES = {
    L.is_vietnamese: {"May 2026": False, "May 15, 2025": False, "May mudguard": True, "May 1 kim": True, "May viền": True, "Lot #123": False, "Lot number: 45": False, "Day shift": False, "Tan color": False, "Last inspection": False, "kiem tra chi tiet": True, "mai de ngoai": True, "the khuon": False, "khuon": True},
    L.is_english: {"May 2026": True, "Lot #123": True, "Day shift": True, "Tan color": True, "Last inspection": True, "*Buffing outsole": True, "*Vac tech eco fill process": True, "Kiểm tra": False, "chat luong tot": False, "": False},
    L.is_code: {"Nike": True, "ISO 9001": True, "IPQC": True, "Model XYZ-100": True, "Nike SB Zoom Nyjah 4": True, "98.5%": True, "12/05/2024": True, "(SBQ-083-6)": True, "P/O 2026-X1": True, "Color matching": False, "Kiểm tra 5 mm": False, "no-sew": False, "kiem tra": False, "*": True, "": True, "Air Max 95": True},
    L.is_model_name: {"NIKE SB ZOOM NYJAH 4(SB-077-A)": True, "FD0736-001": True, "W-088": True, "Model A": True, "Mẫu 1": False, "ASICS GEL-KAYANO 31": True, "NEW BALANCE 1906R": True, "Hoka shoes": False, "tên giày: Pegasus 41": True, "Giày Nike": False},
    L.is_bilingual: {"Final Inspection\nKiểm tra cuối cùng": True, "Toe shape - Hình dạng mũi": True, "Color matching-Phối màu liệu": True, "Kiểm tra vị trí logo (Tongue label) - Phải cân đối hai bên": False, "5 inch - mũi": False, "Áp dụng cho model A (toe)": False, "toe | heel | mũi và gót": True},
    P.stage: {"kiểm tra": "qa", "Đế outsole": "stockfit", "nosew và may": "nosew", "may": "stitching", "dao chặt": "cutting", "last": "assembly", "lỗi": "qa", "x": "general"},
}


@pytest.mark.parametrize("column", CASES, ids=lambda f: f.__name__)
def test_cases(spark, column):
    texts = list(CASES[column])
    assert dict(zip(texts, answers(spark, column, texts))) == CASES[column]


@pytest.mark.parametrize("column", [*CASES, L.is_immune, L.is_metadata], ids=lambda f: f.__name__)
def test_awkward_texts(spark, column):
    out = answers(spark, column, AWKWARD)
    assert len(out) == len(AWKWARD) and out[-1] == out[-2]
    assert answers(spark, column, []) == []


def test_failures(spark):
    cases = [(429, "retry in 3.1s", "RATE_LIMIT_RPM", True, 4), (429, "PerDay limit", "RATE_LIMIT_RPD", False, None), (500, None, "SERVER_5XX", True, None), (None, None, "UNKNOWN_ERROR", False, None), (401, "x", "AUTH_ERROR", False, None), (None, "read ECONNRESET", "ECONNRESET", True, None), (404, "aborted", "TIMEOUT", True, None)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, status int, message string").withColumn("f", P.failure(F.col("status"), F.col("message")))
    assert [(r.f.type, r.f.retryable, r.f.retry_after) for r in df.orderBy("i").collect()] == [c[2:] for c in cases]


UNITS = [
    (1, "OK", None), (2, "ISO 9001", None), (3, "Press the upper", None), (4, "Kiểm tra keo", None), (5, "Kiểm tra keo", "Check the cement"), (6, "Toe shape - Hình dạng mũi", None), (7, "1. Dán đế", None), (8, "Ép nhiệt", None),
    (9, None, None), (10, "xyzzy qwlk", None), (11, "Kiểm tra keo", None),
]


def test_ladder(spark):
    units = spark.createDataFrame(UNITS, "id int, text string, existing string").selectExpr("*", "'x' as status", "'x' as key", "'x' as source")
    memory = spark.createDataFrame([("Ép nhiệt", "Heat press"), ("Ép nhiệt", "Zeta"), (None, "x"), ("", "y")], "source string, target string")
    glossary = spark.createDataFrame([("dán đế", "Attach sole")], "source string, target string")
    out = {r.id: (r.status, r.suggestion) for r in C.classified(units, memory, glossary).collect()}
    assert out == {1: ("NON_TRANSLATABLE", None), 2: ("NON_TRANSLATABLE", None), 3: ("ALREADY_TRANSLATED", None), 4: ("NEEDS_TRANSLATION", None), 5: ("ALREADY_TRANSLATED", "Check the cement"), 6: ("MIXED_LANGUAGE", None), 7: ("LOCKED_TERMINOLOGY", "Attach sole"), 8: ("TM_REUSE", "Heat press"), 9: ("NON_TRANSLATABLE", None), 10: ("ALREADY_TRANSLATED", None), 11: ("NEEDS_TRANSLATION", None)}
    back = {r.id: r.status for r in C.classified(units, None, None, "en", "vi").collect()}
    assert back[3] == "NEEDS_TRANSLATION" and back[4] == "ALREADY_TRANSLATED" and back[8] == "ALREADY_TRANSLATED"
    assert C.classified(units.limit(0), memory, glossary).collect() == []


def test_presentation_ladder(spark):
    rows = [(1, "Kiểm tra keo", "a", True, False), (2, "NG", "a", False, False), (3, "Size #6.5-#9: 50 kg", "a", False, False), (4, "Check cement", "a", False, False), (5, "Dán đế", "b", False, False), (6, "Dán đế", "b", False, True), (7, "* Đối với SB-12", "b", False, False), (8, "Mẫu: ZX 9", None, False, False), (9, "Ép nhiệt", None, False, False), (10, "Mài đế ngoài", None, None, None), (11, None, None, None, None)]
    units = spark.createDataFrame(rows, "unit_id int, text string, container string, reference boolean, to_duplicate boolean")
    pairs = spark.createDataFrame([(5, "Attach sole"), (6, "Attach sole")], "unit_id int, existing string")
    memory = spark.createDataFrame([("ép nhiệt", "Heat press")], "source string, target string")
    out = {r.unit_id: (r.status, r.suggestion) for r in C.presentation(units, pairs, memory).collect()}
    assert out == {1: ("ALREADY_TRANSLATED", None), 2: ("NON_TRANSLATABLE", None), 3: ("TM_REUSE", "Size #6.5-#9: 50 kg"), 4: ("ALREADY_TRANSLATED", None), 5: ("ALREADY_TRANSLATED", None), 6: ("TM_REUSE", "Attach sole"), 7: ("LOCKED_TERMINOLOGY", "*For SB-12"), 8: ("LOCKED_TERMINOLOGY", "Model: ZX 9"), 9: ("TM_REUSE", "Heat press"), 10: ("NEEDS_TRANSLATION", None), 11: ("NON_TRANSLATABLE", None)}


def test_routes(spark):
    units = spark.createDataFrame([(1, "OK"), (2, "Dán đế"), (3, "Đối với SB-12"), (4, "model: X-1"), (5, "Check the gap"), (6, "Ép nhiệt"), (7, "Ép nhiệt:"), (8, "Mài đế"), (9, None)], "unit_id int, text string")
    memory, pairs = spark.createDataFrame([("ép nhiệt", "Heat press")], "source string, target string"), spark.createDataFrame([(2, "Attach sole")], "unit_id int, existing string")
    out = {r.unit_id: (r.route, r.target) for r in C.routed(units, memory, pairs).collect()}
    assert out == {1: ("label", "OK"), 2: ("pair", "Attach sole"), 3: ("model condition", None), 4: ("model heading", None), 5: ("immune", "Check the gap"), 6: ("memory", "Heat press"), 7: ("memory without colon", "Heat press:"), 8: ("queue", None), 9: ("queue", None)}


def test_semantic_pairs(spark):
    cases = [
        ("May viền", "Stitch binding", "Sew edge", 1, False, "no overlap"), ("May viền", "Stitch binding", "Stitch binding", 1, True, "glossary"), ("1. May vòng cổ", "1. Stitch collar", "1. Stitch collar", 0, True, "words"), ("1. May cổ", "1. Sew collar", "1. Cut collar", 0, True, "step"),
        ("1. May viền", "2. Stitch collar", "x", 0, False, "step"), ("*May viền", "Stitch collar", "x", 0, False, "heading"), ("Mài đế mặt ngoài", "Cold press upper", "Buff outsole outside", 0, False, "no overlap"), ("Dán đế", "Đế giữa", "x", 0, False, "same language"),
        ("Dán", "Attach the whole sole unit to the lasted upper with care", "Attach", 0, False, "length"), (None, "x", "x", 0, False, "empty"), ("3. Ép 12.5 kg", "3. Load 12.5 kg", "3. Force 12.5 kg", None, True, "step"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, a string, b string, p string, n int")
    got = {r.i: (r.x.is_pair, r.x.reason) for r in df.withColumn("x", L.semantic_pair(F.col("a"), F.col("b"), F.col("p"), F.col("n"))).collect()}
    assert got == {i: c[4:] for i, c in enumerate(cases)}
