"""The offline translator: terms, phrases, words and their endings, constructions, case, both directions."""

import re

import pytest
from termloom.operators import offline
from termloom.operators.offline import Lexicon, Term
from termloom.plans import offline_queries

TERMS = {
    "en": [Term("Risk Assessment", "Đánh giá rủi ro"), Term("Access Control", "Kiểm soát truy cập"), Term("Control", "điều khiển"), Term("12", "mười hai"), Term("x", "y")],
    "vi": [Term("hở keo", "Gap"), Term("hở keo", "Bond gap", False), Term("mũi", "Tip"), Term("dán đế", "Bottom attaching"), Term("kiểm tra", "check"), Term("EVA", "eva"), Term("nếp nhăn", "Wrinkle")],
}
WORDS = {"policy": "chính sách", "process": "quy trình", "box": "hộp", "house": "nhà", "review": "xem xét", "complete": "hoàn thành", "test": "thử nghiệm", "strict": "nghiêm ngặt", "clean": "sạch", "cat": "mèo"}
PHRASES = [("in order to", "để"), ("stitch count", "số mũi"), ("the quality standards of this work are fine", "tiêu chuẩn chất lượng của việc này là tốt")]
LEXICON = Lexicon(TERMS, PHRASES, WORDS, {"sạch": "clean", "mèo": "cat", "đẹp": "nice"})


@pytest.fixture(scope="module")
def translator():
    return offline.Translator(LEXICON)


def test_business_sentences(spark):
    df = spark.createDataFrame([(1, "The organization must complete a comprehensive Risk Assessment annually in accordance with ISO 27001 and NIST CSF standards."), (2, "Access Control policies must be enforced across all 4 production zones with 99.9% uptime."), (3, None), (4, "")], "id long, text string")
    got = {r.id: r.translated for r in offline.translated(df, LEXICON).collect()}
    for said in ("tổ chức", "hoàn thành", "đánh giá rủi ro", "hàng năm", "ISO 27001"):
        assert re.search(said, got[1], re.IGNORECASE)
    for said in ("kiểm soát truy cập", "chính sách", "4", r"99,9%|99\.9%"):
        assert re.search(said, got[2], re.IGNORECASE)
    assert got[3] is None and got[4] == ""


@pytest.mark.parametrize("text,expected", [
    ("Policies and PROCESSES", "các chính sách and các quy trình"), ("boxes houses cats", "các hộp các nhà các mèo"), ("reviewed completed", "đã xem xét đã hoàn thành"), ("testing", "đang thử nghiệm"), ("strictly", "một cách nghiêm ngặt"), ("Clean CLEAN clean", "Sạch SẠCH sạch"),
    ("Access Controls, access  control", "Kiểm soát truy cập, Kiểm soát truy cập"), ("control 12 x", "điều khiển 12 x"), ("In order to clean", "để sạch"), ("90% ISO v2 RTO", "90 ISO v2 RTO"), ("glass classy", "glass classy"), ("", ""),
])
def test_from_english(translator, text, expected):
    assert translator.to_vietnamese(text) == expected


@pytest.mark.parametrize("text,expected", [
    ("Hở keo", "Gap"), ("không bị hở keo", "without gap"), ("không được dán đế", "must not bottom attaching"), ("sau khi kiểm tra", "after check"), ("phải đúng mèo", "must meet cat"), ("các nếp nhăn", "the wrinkle"), ("thiếu sạch", "missing clean"), ("Sạch và ĐẸP", "Clean và NICE"),
    # the structure pass mends a second SPI
    ("9-10 mũi/inch", "SPI SPI 9-10 stitches/inch"), ("10 mũi/inch", "SPI SPI 10 stitches/inch"), ("mũi đẹp", "Tip nice"), ("may 2 mũi", "may 2 mũi"), ("số mũi", "Stitch count"), ("1. Eva", "1. EVA"), ("mèo. Kiểm tra", "mèo. Check"), ("tiêu chuẩn chất lượng của việc này là tốt", "The quality standards of this work are fine"),
])
def test_to_english(translator, text, expected):
    assert translator.to_english(text) == expected


def test_direction(translator):
    assert translator.english("plain words", "en") and not translator.english("kiểm tra", "en")
    assert translator.english("check the box", "vi") and not translator.english("plain words", "vi") and not translator.english("the kiểm", "vi")


def test_structure_of_english(spark):
    df = spark.createDataFrame([(1, "kiểm tra Upper .hở keo nosew"), (2, "shape toe 9-10 mũi")], "id long, text string")
    got = {r.id: r.translated for r in offline.translated(df, LEXICON, source="vi").collect()}
    assert got == {1: "Check upper. Gap no-sew", 2: "Toe shape SPI 9-10 stitches/inch"}


@pytest.mark.parametrize("term,middle,start", [("Heel Stitching", "heel stitching", "Heel stitching"), ("pfc", "PFC", "PFC"), ("SB-077-P-1", "SB-077-P-1", "SB-077-P-1"), ("x-ray", "X-ray", "X-ray"), ("No-Sew eva press", "no-sew EVA press", "No-sew EVA press"), ("A-B line", "A-B line", "A-B line"), ("", "", "")])
def test_case_by_place(term, middle, start):
    assert (offline.placed(term, False), offline.placed(term, True)) == (middle, start)


def test_longest_terms_first_without_overlaps():
    found = offline.Terms([Term("aa b", "1"), Term("b cc d", "2"), Term("cc", "3"), Term("b cc d", "4", priority=9), Term("dd", "5", False), Term("d", "6")])
    assert [(s, e, t.target) for s, e, t in found.find("aa b cc d, cc aa b dds")] == [(3, 9, "4"), (11, 13, "3"), (14, 18, "1"), (19, 22, "5")]


def test_whole_tables(spark):
    """Terms found by the automaton are those found by trying every term."""
    lexicon = offline_queries.lexicon(spark, "/root/testdata/sf0.001")
    finder = offline.Terms(lexicon.terms["en"])
    rows = offline_queries.QUERIES["m02_translation"](spark, "/root/testdata/sf0.001").collect()
    texts = [r.text for r in offline_queries.catalog.units(spark, "/root/testdata/sf0.001").collect()]
    assert len(rows) == len(texts) and all(r.translated is not None and "" not in r.translated for r in rows)
    hits = 0
    for t in texts:
        taken = []
        for i, term in enumerate(finder.terms):
            for m in finder.pattern(i).finditer(t):
                if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                    taken.append((m.start(), m.end(), term))
        assert finder.find(t) == sorted(taken, key=lambda x: x[:2])
        hits += len(taken)
    assert hits > 10
