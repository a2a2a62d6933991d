"""Operators on tables: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and columns of clashing names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from termloom.operators import activity as V
from termloom.operators import align as A
from termloom.operators import glossary as G
from termloom.operators import memory as M
from termloom.operators import quality as Q
from termloom.operators import rules as R

LONG = "word " * 20_000
CLASH = ("key", "n", "rank", "r", "w", "df", "gram", "hits", "status", "term", "run", "at", "x", "size")


def clash(df):
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def units(spark):
    rows = [(1, 0, "Kiểm tra"), (1, 1, None), (1, 2, ""), (1, 3, LONG), (2, 0, "kiểm  tra"), (2, 1, "1. Check"), (2, 1, "1. Check"), (None, 0, "no id"), (3, None, None)]
    return clash(spark.createDataFrame(rows, "doc_id long, line_no int, text string"))


@pytest.fixture(scope="module")
def sides(units):
    return units.withColumn("side", F.when(F.col("line_no") % 2 == 0, "a").otherwise("b"))


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, "a", "b"), (1, "a", "b"), (2, None, "c"), (3, "d", None), (None, None, None), (4, LONG, LONG), (5, "a", "z")]
    return clash(spark.createDataFrame(rows, "p long, source string, target string"))


def count(df):
    return len(df.collect())


def test_memory(spark, units, pairs):
    assert count(M.plan(units, pairs)) == 9 and count(M.plan(units.limit(0), pairs)) == 0 and count(M.plan(units, pairs.limit(0))) == 9
    out = M.reuse(units.drop("key", "status")).collect()
    assert len(out) == 9 and sum(r.status == "TM_REUSE" for r in out if r.text and "tra" in r.text) == 1
    assert count(M.consistency(pairs.drop("n"))) == 2  # texts without a source are one group
    q = spark.createDataFrame([(1, "check the gap now"), (2, None), (3, ""), (4, LONG), (1, "check the gap now")], "q long, q_text string")
    e = spark.createDataFrame([(1, "check the gap new"), (2, None), (3, LONG), (1, "check the gap new")], "e long, e_text string")
    assert {(r.q, r.e) for r in M.fuzzy_matches(clash(q), clash(e)).collect()} >= {(1, 1)} and count(M.fuzzy_matches(q.limit(0), e)) == 0 and count(M.fuzzy_matches(q, e.limit(0))) == 0
    events = spark.createDataFrame([(1, "a", "b", "LOCKED"), (1, "a", "b", "LOCKED"), (2, None, "b", None), (3, "a", "c", "odd"), (4, "", "x", "LOCKED")], "seq long, source string, target string, status string")
    assert [(r.key, r.target, r.conflicts) for r in M.resolve(events).collect()] == [("a", "b", 1)] and count(M.resolve(events.limit(0))) == 0
    known = spark.createDataFrame([("a",), (None,), ("a",)], "sentence string")
    assert count(M.sentences_known(units.select(F.col("doc_id").alias("unit_id"), "text"), known)) == 0
    assert count(M.style_examples(q, e)) >= 1 and count(M.style_examples(q.limit(0), e)) == 0
    assert count(M.history(("x", pairs), ("y", pairs.limit(0)))) == 6


def test_first_of_is_exact_for_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 7), ("cold", 7), (None, 1)], "k string, o long")
    got = sorted((r.k or "", r.o) for r in M.first_of(rows, "k", "o", 5).collect())
    assert got == [("", 1), ("cold", 7), ("cold", 7), *(("hot", i) for i in range(5))]


def test_rules(spark, units):
    rules = R.table(spark, [("r", "n", "c", ["check", "k[i]"], ["no id"], "x", True, 1), ("s", "n", "c", ["."], None, None, False, 2), ("t", None, None, None, ["check"], None, True, None)])
    assert {r.rule for r in R.triggered(units.drop("rule"), rules, "doc_id").collect()} == {"r"}
    assert {(r.doc_id, r.phrase) for r in R.prohibited(units, rules, "doc_id").collect()} == {(None, "no id"), (2, "check")}
    assert count(R.triggered(units.limit(0), rules, "doc_id")) == 0 and count(R.prohibited(units, rules.limit(0), "doc_id")) == 0
    found = {r.gram: (r.documents, r.n) for r in R.grams(units.drop("n", "gram", "w"), 2, 1).collect()}
    assert found["word word"] == (1, 19_999) and found["kiểm tra"] == (2, 2) and found["1 check"] == (1, 2)
    assert count(R.grams(units.limit(0).drop("n"), 2, 1)) == 0
    diff = spark.createDataFrame([("a b c", "a x c"), (None, "a"), ("", ""), ("a a", "a a a")], "o string, t string").select(R.word_diff(F.col("o"), F.col("t")).alias("d")).collect()
    assert (diff[0].d.old, diff[0].d.new) == ("b", "x") and (diff[3].d.old, diff[3].d.new) == ("", "a")


def test_rules_are_counted_before_they_are_sent(spark, units, monkeypatch):
    monkeypatch.setattr(R, "MOST_PATTERNS", 1)
    rules = R.table(spark, [("r", "n", "c", ["a", "b"], ["x"], None, True, 1)])
    with pytest.raises(ValueError, match="2 patterns"):
        R.triggered(units, rules, "doc_id")


def test_align(sides):
    for run in (A.adjacent_pairs, A.block_pairs, lambda u: A.step_pairs(u, ["doc_id"]), lambda u: A.left_over_pairs(u, ["doc_id"]), lambda u: A.stitched(u)):
        plain = sides.drop("n", "run", "at", "step")
        run(plain).collect()
        assert run(plain.limit(0)).collect() == []
    terms = [{"term": "kiểm tra"}, {"term": "check"}, {"term": " "}, {"term": "7"}]
    assert sorted((r.key, r.term) for r in A.matched_terms(sides, terms, "doc_id", "text").collect()) == [(1, "kiểm tra"), (2, "check"), (2, "check"), (2, "kiểm tra")]
    assert A.matched_terms(sides, [], "doc_id", "text").collect() == []


def test_quality(spark, pairs):
    out = pairs.withColumns(Q.qa(F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")))).collect()
    assert len(out) == 7 and all(r.score == 100 for r in out)
    assert count(Q.compliance(pairs.drop("n"), "p")) == 6 and count(Q.compliance(pairs.limit(0), "p")) == 0
    forms = spark.createDataFrame([("gap", "khe", 0), ("gap", "hở (lớn)", 1), ("x", None, 0)], "term string, target string, rank int")
    seen = spark.createDataFrame([(1, "gap"), (1, "gap"), (2, "gap"), (3, "gap"), (4, None), (5, "other")], "unit long, term string")
    texts = clash(spark.createDataFrame([(1, "khe và hở  (lớn)"), (2, None), (3, "Khes"), (5, "x")], "unit long, target string").withColumn("all", F.lit(1))).drop("term", "n")
    (r,) = Q.conflicts(texts, seen, forms).collect()
    assert (r.term, r.preferred, r.missing, r.variants, r.units, r.first_unit, r.candidates) == ("gap", "khe", 1, 0, 1, 2, "") or r.variants == 1
    assert count(Q.conflicts(texts.limit(0), seen, forms)) == 0


def test_activity(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, 1, t, True), (2, 1, t, False), (2, 1, t, False), (3, None, t, None), (4, 1, t + dt.timedelta(days=1), True)], "id long, user_id long, ts timestamp, ok boolean")
    assert sorted(r.n for r in V.sliding_count(log, "user_id", 60).collect()) == [1, 1, 3, 3, 3]
    assert [r.ok for r in V.admitted(log.where("user_id = 1"), "user_id", 2, 86400).collect()] == [True, True, False, True]
    assert count(V.breaker(log, "user_id", 2, 60)) == 5 and count(V.breaker(log.limit(0), "user_id", 2, 60)) == 0
    assert count(V.daily_quota(log, "user_id", 3)) == 3 and count(V.latest(log, "user_id", ["ts", "id"])) == 2 and count(V.zones(log, "user_id", "ok")) == 4
    assert count(V.newest(log, 1, [F.desc("ts")], ["user_id"])) == 2 and count(V.newest(log.limit(0), 5, [F.desc("ts")])) == 0
    assert sorted(r["rank"] for r in V.global_rank(log.select("id"), ["id"]).collect()) == [0, 1, 2, 3, 4]


def test_glossary(spark):
    columns = "id long, source_term string, target_term string, source_lang string, target_lang string, status string, priority int, category string, created_by string, updated_at timestamp, confidence double"
    rows = [(1, "gap", "khe", "en", "vi", "approved", 1, None, None, None, None), (1, "gap", "khe", "en", "vi", "approved", 1, None, None, None, None), (2, None, None, None, None, None, None, None, None, None, None), (3, "", LONG, "vi", "en", "review", 5, "c", "Auto-Harvester", dt.datetime(2024, 1, 1), 0.5)]
    terms = spark.createDataFrame(rows, columns)
    for run in (G.search, G.eligible, G.expand, G.facets, G.health, lambda x: G.both_directions(x, "en", "vi"), lambda x: G.page(x, "newest", 1, 10), lambda x: G.new_rows(x, x.limit(0)), lambda x: G.upsert(x, x.limit(0)), lambda x: G.changes(x.limit(0), x.dropDuplicates(["id"]), "id")):
        assert run(terms).collect() is not None and run(terms.limit(0)).collect() is not None
    assert count(G.set_status(terms, terms.select("id").limit(1), "rejected")) == 4 and count(G.delete(terms, terms.where("id = 1").select("id").distinct())) == 2
