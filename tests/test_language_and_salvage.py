import pytest
from pyspark.sql import functions as F
from termloom.functions import language as L
from termloom.operators import salvage as S


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(("text", "expected"), [("Kiểm tra", True), ("kiem tra may", True), ("May 12, 2024", False), ("Lot # 45", False), ("Check the gap", False), ("may logo", True), ("quet keo khuon giay", True), ("", False), (None, False), ("random words here", False)])
def test_vietnamese(spark, text, expected):
    assert one(spark, L.is_vietnamese, text) is expected


@pytest.mark.parametrize(("text", "expected"), [("Check the gap", True), ("Kiểm tra gap", False), ("AB-12 press", True), ("", False)])
def test_english(spark, text, expected):
    assert one(spark, L.is_english, text) is expected


@pytest.mark.parametrize(("text", "expected"), [("Toe shape (Hình dạng mũi)", True), ("Final Inspection\nKiểm tra cuối cùng", True), ("Color matching-Phối màu liệu", True), ("Đối với model AB-1 (toe shape)", False), ("Check the gap", False), ("5 mm / mũi", False)])
def test_bilingual(spark, text, expected):
    assert one(spark, L.is_bilingual, text) is expected


@pytest.mark.parametrize(("a", "b", "expected"), [("1. Kiểm tra khe", "1. Check the gap", None), ("1. Kiểm tra", "2. Check it", "step"), ("*Kiểm tra", "Check it", "heading"), ("Check it", "Check the gap", "same language"), ("", "x", "empty"), ("Ép 120 kg 3.5 mm", "Press 80 kg 2.5 mm", "numbers")])
def test_pair_verdict(spark, a, b, expected):
    assert one(spark, L.pair_verdict, a, b) == expected


@pytest.mark.parametrize(("text", "expected"), [("xong .Do lai", "xong. Do lai"), ("thẳng,đường", "thẳng, đường"), ("3.Kiểm 1.8mm", "3. Kiểm 1.8mm"), ("a  b 3.14", "a b 3.14"), ("x.2. y", "x. 2. y")])
def test_punctuation(spark, text, expected):
    assert one(spark, L.punctuated, text) == expected


def test_casing_and_metadata(spark):
    assert one(spark, lambda c: L.cased(c, F.lit(True)), "heel EVA Stitching") == "Heel EVA stitching"
    assert one(spark, lambda c: L.cased(c, F.lit(False)), "Heel SB-077 Line") == "heel SB-077 line"
    assert one(spark, L.is_metadata, "SB-077-C-1") and one(spark, L.is_metadata, "22/9") and not one(spark, L.is_metadata, "Color migration")
    assert one(spark, L.is_immune, "NO GOOD") and not one(spark, L.is_immune, "Kiểm tra")


@pytest.mark.parametrize(("formula", "expected"), [("A1+B2", "A1+C2"), ("SUM(B1:C3)", "SUM(C1:D3)"), ('"B1"&B1', '"B1"&C1'), ("$B$1", "$C$1"), ("Other!B1", "Other!B1"), ("'My S'!B1:C2", "'My S'!B1:C2"), ("B:B", "C:C"), ("LOG10(B1)", "LOG10(C1)"), ("T[B1]+B1", "T[B1]+C1"), ("Z1", "AA1"), (None, None), ('"a""B1"', '"a""B1"')])
def test_formulas(formula, expected):
    assert S.shift_columns(formula, 2) == expected


def test_formula_sheets():
    assert S.rename_sheets("Data!A1+'My S'!B2:C3+\"Data!A1\"+B1", {"data": "Dữ liệu", "my s": "It's"}) == "'Dữ liệu'!A1+'It''s'!B2:C3+\"Data!A1\"+B1"
    assert S.shift_columns("B1+Data!B1:C2+Other!B1", 2, 1, "Own", "Data") == "B1+Data!C1:D2+Other!B1" and S.shift_columns("B1", 2, 1, "Data", "Data") == "C1"
    assert S.rename_sheets(None, {}) is None and S.shift_columns("", 1) == ""


def test_answers(spark):
    raw = ['[{"id":"a","text":"x"},{"id":"a","text":"y"},{"id":"zz","text":"n"}]', '```json\n{"items":[{"id":"b","translation":" t "}]}\n```', '[{"id":"c","text":"cut"},{"id":"d","te', "no json", None, '{"id":"e","text":""}']
    df = spark.createDataFrame(list(enumerate(raw)), "batch long, raw string")
    expected = spark.createDataFrame([(i, c) for i, c in enumerate("abcdef")], "batch long, id string")
    assert {(r.batch, r.id, r.text) for r in S.answers(df, expected).collect()} == {(0, "a", "x"), (1, "b", "t"), (2, "c", "cut")}
    assert [r.formula for r in S.shifted(spark.createDataFrame([(1, "B1"), (2, None)], "k long, formula string"), "k", 2).orderBy("k").collect()] == ["C1", None]
