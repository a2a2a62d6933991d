"""Literal cases of operators that SQL does not cover."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from termloom.functions import text as T
from termloom.operators import activity, align, glossary, memory, rules


def terms_of(spark, text, glossary_rows):
    df = spark.createDataFrame([(1, text)], "k long, t string")
    return [(r.term, r.found) for r in align.matched_terms(df, glossary_rows, "k", "t").orderBy("start").collect()]


def test_longest_term_first_without_overlap(spark):
    g = [{"term": "risk"}, {"term": "risk assessment"}, {"term": "quality"}]
    assert terms_of(spark, "Risk Assessments need quality; risky is none.", g) == [("risk assessment", "Risk Assessments"), ("quality", "quality")]


def test_words_of_other_scripts_bound_terms(spark):
    assert terms_of(spark, "đế đếx", [{"term": "đế"}]) == [("đế", "đế")]
    assert terms_of(spark, "9 10 a", [{"term": "9"}, {"term": "a"}]) == []


def test_spans_are_free_of_overlap_by_brute_force(spark):
    g = [{"term": t} for t in ("aa", "aa bb", "bb cc", "cc")]
    assert terms_of(spark, "aa bb cc aa cc", g) == [("aa bb", "aa bb"), ("cc", "cc"), ("aa", "aa"), ("cc", "cc")]


def test_greedy_matching_uses_each_side_once(spark):
    df = spark.createDataFrame([(1, "a", "x", 90.0), (1, "a", "y", 95.0), (1, "b", "y", 94.0), (1, "b", "x", 40.0), (2, "a", "x", 50.0)], "deck long, a string, b string, score double")
    out = {(r.deck, r.a, r.b) for r in align.greedy_matching(df, "deck", 45).collect()}
    assert out == {(1, "a", "y"), (2, "a", "x")}


def log(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, start + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate(rows)], "id long, user_id long, ts timestamp, ok boolean")


def test_admission_excludes_the_window_start(spark):
    out = activity.admitted(log(spark, [(0, True), (1, True), (2, True), (60, True), (60, True), (61, True)]), "user_id", 2, 60)
    assert [r.ok for r in out.orderBy("id").collect()] == [True, True, False, True, False, True]


def test_sliding_count_includes_both_ends(spark):
    out = activity.sliding_count(log(spark, [(0, True), (60, True), (61, True)]), "user_id", 60)
    assert [r.n for r in out.orderBy("id").collect()] == [1, 2, 2]


def test_breaker(spark):
    out = activity.breaker(log(spark, [(0, False), (1, False), (2, True), (12, False), (13, True), (30, True), (31, False), (32, True)]), "user_id", 2, 10)
    assert [r.state for r in out.orderBy("id").collect()] == ["CLOSED", "CLOSED", "OPEN", "HALF_OPEN", "OPEN", "HALF_OPEN", "CLOSED", "CLOSED"]


def test_global_rank(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.hash("id"), F.lit(97)))
    out = activity.global_rank(df, ["x", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1000))
    assert [(r.x, r.id) for r in out] == sorted((r.x, r.id) for r in out)


def test_fuzzy_lookup_keeps_numbers_and_negation(spark):
    q = spark.createDataFrame([(1, "Check the glue line at 5 mm now"), (2, "Check the glue line at 6 mm now"), (3, "Do not check the glue line")], "q long, q_text string")
    e = spark.createDataFrame([(10, "Check the glue lines at 5 mm now"), (11, "Do check the glue line ok")], "e long, e_text string")
    assert {(r.q, r.e) for r in memory.fuzzy_matches(q, e).collect()} == {(1, 10)}


@pytest.mark.parametrize(("a", "b", "expected"), [("Kiểm tra.", "kiểm  tra", 0.99), ("Kiểm tra", "kiem tra", 0.97), ("glue line gap", "gluelinegap", 0.96), ("step 1", "step 2", 0.0), ("turn left", "turn right", 0.0), ("a b", "a b c", 0.0)])
def test_guarded_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(T.guarded_similarity(F.col("a"), F.col("b")))
    assert df.first()[0] == expected


def test_winner_is_ambiguous_on_ties(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "gap", "x", True, 5, t), ("2", "gap", "y", True, 5, t), ("3", "toe", "p", False, 9, t), ("4", "toe", "q", True, 1, t)]
    df = spark.createDataFrame(rows, "id string, source_term string, target_term string, is_direct boolean, priority int, updated_at timestamp")
    out = {r.source_key: (r.target_term, r.ambiguous) for r in glossary.winners(df).collect()}
    assert out == {"gap": ("x", True), "toe": ("q", False)}


def test_word_diff_of_equal_prefix_and_suffix(spark):
    df = spark.createDataFrame([("press the sole", "press firmly the sole")], "a string, b string")
    assert tuple(df.select(rules.word_diff(F.col("a"), F.col("b")).alias("w")).select("w.*").first()) == ("", "firmly")


def test_vietnamese_order_collates(spark):
    df = spark.createDataFrame([(1, "đế"), (2, "da"), (3, "ép"), (4, "em")], "id long, target_term string").withColumn("source_term", F.lit(""))
    assert [r.id for r in df.orderBy(*glossary.ordering("az_vi")).collect()] == [2, 1, 4, 3]


def agreement_by_hand(e, v):
    """How sure two profiles are one slide's versions, or None; by plain Python."""
    import re

    from termloom.operators import slides as S

    has = lambda r, *w: any(x in (r["low"] or "") for x in w)
    same, differs = None not in (e["step"], v["step"]) and e["step"] == v["step"], None not in (e["step"], v["step"]) and e["step"] != v["step"]
    markers = e["en_marker"] and v["vi_marker"]
    heel, toe, gót, mũi = has(e, "heel"), has(e, "toe", "tip"), has(v, "gót", "hậu"), has(v, "mũi")
    cut_e, cut_v = has(e, "cutting") and not has(e, "after cutting"), has(v, "chặt", "cutting") and not has(v, "sau khi chặt")
    put_e, put_v = has(e, "assembly", "lasting", "bpm", "gò"), has(v, "thành hình", "lắp ráp", "gò", "bpm")
    sew_e, sew_v = has(e, "stitching", "sewing"), has(v, "may") and not has(v, "may mắn")
    stages = (cut_e and not cut_v and (put_v or sew_v)) or (cut_v and not cut_e and (put_e or sew_e)) or (put_e and not put_v and (cut_v or sew_v)) or (put_v and not put_e and (cut_e or sew_e))
    measures = len(e["numbers"]) >= 2 and len(v["numbers"]) >= 1 and not same and not markers and not set(e["numbers"]) & set(v["numbers"])
    if differs or (heel and not toe and mũi and not gót) or (toe and not heel and gót and not mũi) or stages or measures:
        return None
    words = lambda t: {w for w in re.split(r"\s+", re.sub(r"[^\w\s]|_", " ", (t or "").lower())) if len(w) >= 4 and w not in S.WEAK}
    drafted, there = words(v["probe"]), words(e["low"])
    ratio = sum(any(p in w or w in p for w in there) for p in drafted) / len(drafted) if drafted else 0.0
    return None if ratio < S.OVERLAP and not same and not markers else max(ratio, 0.9 if same else 0.6)


def slide_pairs_by_hand(rows):
    """Neighbours from left to right; where they are few, the rest by falling score."""
    import math
    import re

    from termloom.operators import slides as S

    plain = lambda x: x != "" and not re.search(S.BANNER.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{L}\p{N}", r"\w"), x)
    out = []
    for file in sorted({r["file"] for r in rows}):
        deck = sorted((r for r in rows if r["file"] == file), key=lambda r: r["slide"])
        titled = lambda a, b: (plain(a["title"]) and plain(b["title"]) and (a["title"] in b["title"] or b["title"] in a["title"]), plain(a["subtitle"]) and plain(b["subtitle"]) and a["subtitle"] == b["subtitle"])
        near, i = [], 0
        while i + 1 < len(deck):
            a, b = deck[i], deck[i + 1]
            title, sub = titled(a, b)
            steps = None not in (a["step"], b["step"])
            marker = (a["en_marker"] and b["vi_marker"]) or (a["vi_marker"] and b["en_marker"])
            topic = ((title and len(a["title"]) >= 8) or (sub and len(a["subtitle"]) >= 8)) and ((a["en_long"] >= 2 and b["vi_long"] >= 2) or (a["vi_long"] >= 2 and b["en_long"] >= 2))
            sign = not (steps and a["step"] != b["step"]) and ((steps and a["step"] == b["step"]) or marker or topic) and (title or sub or marker)
            en, vi = (a, b) if a["is_en"] and b["is_vi"] else (b, a) if a["is_vi"] and b["is_en"] else (None, None)
            if sign and en and agreement_by_hand(en, vi) is not None:
                near.append((en["slide"], vi["slide"]))
                i += 1
            i += 1
        out += [(file, *p) for p in near]
        k, n = len(near), len(deck)
        if k >= 2 or k == 1 and n <= 4 or k * 2 >= n * 0.4:
            continue
        used, scored = {s for p in near for s in p}, []
        rest = [r for r in deck if r["slide"] not in used]
        for e in (r for r in rest if r["is_en"]):
            for v in (r for r in rest if r["is_vi"] and r["slide"] != e["slide"]):
                if (sure := agreement_by_hand(e, v)) is not None:
                    score = math.floor(sure * 100 + 0.5) + S.POINTS["step"] * (e["step"] is not None and e["step"] == v["step"]) + S.POINTS["marker"] * (e["en_marker"] and v["vi_marker"]) + S.POINTS["title"] * any(titled(e, v)) + S.POINTS["numbers"] * bool(set(e["numbers"]) & set(v["numbers"])) + S.POINTS["neighbour"] * (abs(e["slide"] - v["slide"]) == 1)
                    scored.append((-score, e["slide"], v["slide"]))
        left, right = set(), set()
        for score, e, v in sorted(scored):
            if -score >= S.LEAST and e not in left and v not in right:
                left.add(e)
                right.add(v)
                out.append((file, e, v))
    return sorted(out)


def test_slide_pairing_query_over_the_whole_tables(spark):
    from termloom.operators import slides
    from termloom.plans import sop_queries

    path = "/root/testdata/sf0.001"
    rows = [r.asDict(recursive=True) for r in slides.profiles(sop_queries.deck(spark, path)).collect()]
    expected = slide_pairs_by_hand(rows)
    assert len(expected) > 5 and sorted(tuple(r) for r in sop_queries.QUERIES["j11_greedy_matching"](spark, path).collect()) == expected
