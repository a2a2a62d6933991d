"""Harvested terms: literal cases and brute force over whole tables."""

import re

from termloom.operators import harvest as H
from termloom.plans import harvest_queries as Q

SF = "/root/testdata/sf0.001"
MARKS = re.compile("[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]", re.IGNORECASE)
UNIT = "doc_id long, slide long, at long, text string, target string, is_item boolean"


def word_key(t):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", (t or "").lower())).strip()


def test_patterns_places_and_suggestions(spark):
    units = [
        (1, 1, 0, "*Lăn keo đáy: lăn đều keo từ mũi đến gót", "*Bottom roll cementing: apply cement", False), (1, 1, 1, "Độ sâu rãnh mài", "Buffing groove depth", True), (1, 1, 9, "Chú ý kiểm tra dập gân mũi giày, hở keo", "Note", False),
        (1, 2, 0, "*Ép nóng: 15 giây", "*Hot pressing: 15 s", False), (1, 2, 1, "*Heading: plain", "*X", False), (1, 2, 2, "Hình dạng vòng cổ - tốt", "", False), (1, 2, 3, "Hình dạng vòng cổ: again", "Collar", False), (1, 2, 4, "*Ép nóng", "*Later", False),
        (1, 3, 0, None, None, None), (1, 3, 1, "ab", "", True), (1, 3, 2, "*Gót phải đẹp", "", False), (1, 3, 3, "Tiêu chuẩn gót", "Tiêu chuẩn", False), (1, 3, 4, "*gót", "*GÓT", False), (1, 3, 5, "*Mới lạ", "*9-10 mũi/inch đ", False),
    ]
    glossary = spark.createDataFrame([(1, "hở keo", "bond gap"), (2, "đế", None)], "id long, source_term string, target_term string")
    got = {(r.slide, r.key): r for r in H.unmapped(spark.createDataFrame(units, UNIT), glossary, Q.domain(spark), Q.dictionary(spark), ["doc_id", "slide"]).collect()}
    assert sorted(got) == [(1, "dập gân"), (1, "lăn keo"), (1, "lăn keo đáy"), (1, "độ sâu rãnh mài"), (2, "hình dạng vòng cổ"), (2, "ép nóng"), (3, "gót")]
    assert (got[1, "lăn keo đáy"].pattern, got[1, "lăn keo đáy"].current, got[1, "lăn keo đáy"].options) == ("heading", "Bottom roll cementing", ["Bottom roll cementing", "Bottom roll cementing standard", "Bottom roll cementing specification"])
    assert got[1, "lăn keo"].options == ["Roll cementing", "Roller glue application", "Roll-coating cement"] and got[1, "lăn keo"].current == "Roll cementing" and got[1, "lăn keo"].term == "Lăn keo"
    assert (1, "hở keo") not in got and (2, "heading") not in got and got[2, "ép nóng"].at == 0
    assert got[2, "hình dạng vòng cổ"].options == ["Collar shape", "Collar contour", "Collar symmetry"] and got[2, "hình dạng vòng cổ"].current == "Collar shape"
    assert (3, "gót phải đẹp") not in got and (3, "tiêu chuẩn gót") not in got  # a modal; no target without Vietnamese letters
    assert got[3, "gót"].options == ["Heel", "Standard Heel"]


def test_domain_terms_over_the_whole_tables(spark):
    rows = Q.deck_units(spark, SF).collect()
    known = {word_key(r.source_term) for r in Q.glossary(spark, SF).collect()}
    expected = set()
    for r in rows:
        for _, term, _, _ in Q.DOMAIN:
            if len(r.text.strip()) >= 3 and term in r.text.lower() and word_key(term) not in known:
                expected.add((r.doc_id, r.slide, word_key(term)))
    got = Q.QUERIES["p07_unmapped_terms"](spark, SF).collect()
    keys = {(r.doc_id, r.slide, r.key) for r in got}
    assert len(keys) == len(got) and expected <= keys and len(expected) > 20
    assert all(r.key not in known and r.options and not MARKS.search(r.options) for r in got)
    assert {r.pattern for r in got} == {"heading", "criterion", "domain"}


def special(t):
    t = t.strip()
    modal = re.search(r"(?<![A-Za-z0-9_])(phải|cần|nên|để|để không|không bị|sau đó|tiến hành|thực hiện|nhằm|nếu|khi|trong khi|bởi vì|trước khi|sau khi|tuyệt đối|chú ý|lưu ý|hãy|bị|được)(?![A-Za-z0-9_])", t, re.IGNORECASE)
    return 2 <= len(t) <= 40 and not re.search(r"[.?!;\n\r]", t) and not modal and 1 <= len(re.split(r"\s+", t)) <= 4


def test_feed_over_whole_documents(spark):
    """The first hundred candidates of each document, by a walk over its lines."""
    known = {r.source_term.lower().strip() for r in Q.glossary(spark, SF).collect() if r.source_term}
    glossary = {}
    for r in sorted(Q.glossary(spark, SF).collect(), key=lambda r: (r.id, r.target_term)):
        if r.target_term:
            glossary.setdefault(word_key(r.source_term), r.target_term)
    named = {word_key(t) for _, t, _, _ in Q.DOMAIN} | {word_key(v) for _, _, v in Q.DICTIONARY} | set(glossary)
    docs = {}
    for r in sorted(Q.pages(spark, SF).collect(), key=lambda r: (r.doc_id, r.page, r.line_no)):
        docs.setdefault(r.doc_id, []).append((r.page, r.line_no, r.text.strip()))
    letters = "A-Za-z0-9_À-ỹ"
    expected = []
    for doc, lines in docs.items():
        found = {}
        for page, no, t in lines:
            m = re.match(r"^([A-Za-zÀ-ỹ0-9\s/\-]{2,40})\s*[:\-=–—]\s*([A-Za-zÀ-ỹ0-9\s/\-]{2,50})$", t)
            if m:
                a, b = m[1].strip(), m[2].strip()
                a, b = (b, a) if not MARKS.search(a) and MARKS.search(b) else (a, b)
                if a and b and a.lower() != b.lower() and special(a) and a.lower() not in known:
                    found.setdefault(a.lower(), (a, page, no, "pair"))
        for page, no, t in lines:
            words = re.split(r"\s+", t)
            if 5 <= len(t) <= 250:
                for n in (4, 3, 2, 1):
                    for i in range(len(words) - n + 1):
                        p = re.sub(rf"^[^{letters}]+|[^{letters}]+$", "", " ".join(words[i : i + n]))
                        if special(p) and p.lower().strip() not in known and (not MARKS.search(p) or word_key(p) in named):
                            found.setdefault(p.lower().strip(), (p, page, no, "phrase"))
        expected += [(doc, n, *x) for n, x in enumerate(list(found.values())[:100], 1)]
    got = [(r.doc_id, r.n, r.term, r.page, r.line_no, r.kind) for r in Q.QUERIES["p08_document_feed"](spark, SF).collect()]
    same = len(set(got) & set(expected))
    assert same >= 0.995 * max(len(got), len(expected)), (sorted(set(got) - set(expected))[:5], sorted(set(expected) - set(got))[:5])


def test_pairs_first_and_limits(spark):
    lines = [(1, 1, 1, "short words of a line here"), (1, 1, 2, "Nắp gót đúc : Molded heel cap"), (1, 1, 3, "Tongue trim : Đường viền"), (1, 1, 4, "Tipquarter : tip quarter"), (1, 2, 5, "abcd"), (1, 2, 6, None), (2, 1, 1, "")]
    glossary = spark.createDataFrame([(1, "WORDS ", "x")], "id long, source_term string, target_term string")
    got = H.fed(spark.createDataFrame(lines, "doc_id long, page long, line_no long, text string"), glossary, Q.domain(spark), Q.dictionary(spark), most=4).orderBy("n").collect()
    assert [(r.n, r.term, r.target, r.page, r.kind) for r in got] == [(1, "Nắp gót đúc", "Molded heel cap", 1, "pair"), (2, "Đường viền", "Tongue trim", 1, "pair"), (3, "short words of a", "Short words of a standard", 1, "phrase"), (4, "words of a line", "Words of a line standard", 1, "phrase")]
