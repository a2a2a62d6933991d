"""Cases of the review's findings: each failed before its repair."""

import functools
import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from termloom.functions import language as L
from termloom.functions import predicates as P
from termloom.functions import sop, terms
from termloom.functions import text as T
from termloom.operators import align, classify, decks, fingerprint, grams, harvest, inference, memory, offline, slides
from termloom.plans import harvest_queries as HQ
from termloom.plans import language_queries as LQ


def test_shares_of_a_bilingual_text_are_compared_in_whole_numbers(spark):
    """7 of 25 letters are 0.28."""
    df = spark.createDataFrame([("Eaupa | leieroi | érément | mentment, | les.",)], "text string")
    assert df.select(L.is_bilingual(F.col("text"))).first()[0] is True


@pytest.mark.parametrize("n,letters", [(18278, "ZZZ"), (22632, "aLL"), (107511, "ßAA"), (200_000, chr(65 + (200_000 - 703) // 676) + "VH"), (7_200_000, chr(65 + (7_200_000 - 703) // 676) + chr(65 + (7_200_000 - 703) // 26 % 26) + chr(65 + (7_200_000 - 703) % 26))])
def test_columns_beyond_three_capitals(spark, n, letters):
    """F7."""
    got = spark.createDataFrame([(n,)], "n int").withColumn("letters", T.column_letters(F.col("n"))).withColumn("back", T.column_index(F.col("letters"))).first()
    assert (got.letters, got.back) == (letters, n)


def test_column_index_takes_either_case(spark):
    assert [r.i for r in spark.createDataFrame([("xfd",), ("Ab",), ("AB",)], "c string").select(T.column_index(F.col("c")).alias("i")).collect()] == [16384, 28, 28]


def test_short_texts_of_one_compact_form_match_exactly(spark):
    """F9."""
    q = spark.createDataFrame([(1, "Ha in."), (2, "no des"), (3, "Ha 1 in"), (4, "wholly other")], "q long, q_text string")
    e = spark.createDataFrame([(1, "Hain"), (2, "nodes"), (3, "Ha 2 in"), (4, "Wholly, other")], "e long, e_text string")
    assert sorted(map(tuple, memory.exact_matches(q, e).collect())) == [(1, 1, 0.92), (2, 2, 0.92), (4, 4, 0.99)]


def test_a_fingerprint_of_bounded_depth_takes_the_greatest_digest(spark, monkeypatch):
    """what the SQL of two levels gives for more rows than two levels hold."""
    monkeypatch.setattr(fingerprint, "FANOUT", 4)
    rows = spark.range(40).select("id")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = [sha(f"{len(str(i))}:{i}") for i in range(40)]
    for _ in range(2):
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    assert len(level) == 3
    assert fingerprint.snapshot(rows, ["id"], ["id"], most=2).first().fingerprint == max(level)[:16]
    assert fingerprint.snapshot(rows, ["id"], ["id"]).first().fingerprint == sha("".join(level))[:16]


def test_translator_passes_over_patterns_that_cannot_match():
    """each pattern's text has its literal; words are translated once and remembered."""
    texts = ["THE ORGANIZATION must be", "ſtandard polİcies", "12%, 5%", "all production  zones", "5 stitches / inch", "9.5 uptime", "must tightly", "với 5 thời gian hoạt động"]
    for table in (offline._BUSINESS, offline._MENDED, offline._DENSITY):
        for text in texts:
            plain = text
            for pattern, to, *_ in table:
                plain = pattern.sub(to, plain)
            assert offline.rewritten(text, table) == plain
    translator = offline.Translator(offline.Lexicon({}, [], {"box": "hộp"}, {}))
    assert translator.to_vietnamese("Boxes and boxes and boxes") == "các hộp and các hộp and các hộp"
    assert translator.english_token.cache_info().hits > 0


def test_slide_overlap_counts_parts_of_words(spark):
    """words in part, either way, long ones too; null where a side is barred."""
    long = "x" * 40
    rows = [("heel\ncounters\nouter", "counter\nmouterm"), (f"{long}\nnone", "xxxxx\nother"), ("", "word"), (None, "word")]
    got = spark.createDataFrame(rows, "a string, b string").select(slides.overlap(F.col("a"), F.col("b"))).collect()
    assert [r[0] if r[0] is None else round(r[0], 6) for r in got] == [0.666667, 0.5, 0.0, None]


def shuffled(spark, df) -> tuple[list, int]:
    """Rows of df, and how many rows its stages shuffle."""

    def records():
        no = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, no, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = records()
    rows = df().collect()
    time.sleep(1)  # the store is behind its stages
    return rows, records() - before


@pytest.mark.parametrize("tokens", [7, 1 << 20])
def test_grams_are_counted_once_a_document(spark, monkeypatch, tokens):
    """also where a document's words are merged in parts, and where there is no document."""
    monkeypatch.setattr(grams, "TOKENS", tokens)
    lines = [(i // 5 if i < 95 else None, " ".join("abc"[(i * j + j) % 3] for j in range(i % 13))) for i in range(100)]
    docs, n = {}, {}
    for doc, text in lines:
        w = text.split()
        for k in range(1, 5):
            for i in range(len(w) - k + 1):
                g = " ".join(w[i : i + k])
                n[g] = n.get(g, 0) + 1
                docs.setdefault(g, set()).update([doc] if doc is not None else [])
    df = spark.createDataFrame(lines, "doc_id long, text string").repartition(3)
    for most, least in ((4, 3), (4, 15), (3, 1), (1, 2)):
        expected = {(g, len(docs[g]), n[g]) for g in n if len(docs[g]) >= least and len(g.split()) <= most}
        assert {tuple(r) for r in grams.grams(df, most, least).collect()} == expected


def test_rare_grams_are_not_shuffled(spark):
    """of words that occur once, only words and pairs go to the shuffle, each once."""
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100)) + " same end of all texts") for i in range(40)], "doc_id long, text string")
    rows, n = shuffled(spark, lambda: grams.grams(df, 4, 5))
    assert len(rows) == 14 and n < 40 * 2 * 105 + 1000


@pytest.mark.parametrize("kind", ["int", "long", "double"])
def test_points_meet_the_best_interval_of_a_node(spark, kind):
    """Against all pairs, with negative and empty intervals, names that are null and points that repeat."""
    r = random.Random(7)
    spans = [(k, b := r.randrange(-70, 200), b + r.choice([-3, 0, 1, 2, 5, 16, 64, 300]), r.choice([None, *range(40)]) if k else r.randrange(40)) for k in (0, 1, 2) for _ in range(60)]
    points = [(k, r.randrange(-90, 400)) for k in (0, 1, 3, None) for _ in range(150)]
    expected = set()
    for k, p in points:
        held = [(e - b, b, n is not None, n) for j, b, e, n in spans if j == k and b <= p < e]
        if held:
            expected.add((k, p, min(held)[3]))
    frames = spark.createDataFrame(points, "k int, pos int").select("k", F.col("pos").cast(kind).alias("pos")), spark.createDataFrame(spans, "k int, start int, end int, name int").select("k", F.col("start").cast(kind).alias("start"), F.col("end").cast(kind).alias("end"), "name")
    got = [tuple(x) for x in align.containing(*frames, ["k"], 16).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_interval_join_shuffles_no_pairs(spark):
    """As many rows as points and nodes, not as pairs of both."""
    points = spark.range(400).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("pos"))
    spans = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") % 40).cast("int").alias("start"), (F.col("id") % 40 + 300).cast("int").alias("end"), F.col("id").alias("name"))
    rows, n = shuffled(spark, lambda: align.containing(points, spans, ["k"], 64))
    assert [r.name for r in sorted(rows, key=lambda r: r.pos)] == [0 if p < 300 else p - 299 for p in range(339)] and n < 20_000


def test_feed_tells_later_phrases_only_where_they_count(spark):
    """the first candidates of a text come from its first lines; texts whose first lines do not do are told whole."""
    words = lambda d, i: " ".join(f"w{d}x{(i * 20 + j) % (600 if d % 2 else 7)}" for j in range(20))
    lines = [(d if d else None, i // 10, i, "Nắp gót : Heel cap" if i == 25 else words(d, i)) for d in range(6) for i in range(30)]
    df = spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string")
    tables = spark.createDataFrame([(1, "w1x1", "x")], "id long, source_term string, target_term string"), HQ.domain(spark), HQ.dictionary(spark)
    whole = sorted(map(tuple, harvest._fed(df, F.lit(True), *tables, "vi", 60).collect()), key=str)
    rows, n = shuffled(spark, lambda: harvest.fed(df, *tables, most=60))
    assert sorted(map(tuple, rows), key=str) == whole and {r.n for r in rows if r.doc_id == 1} == set(range(1, 61))
    _, most = shuffled(spark, lambda: harvest._fed(df.where("doc_id % 2 = 1"), F.lit(True), *tables, "vi", 60))
    odd, n = shuffled(spark, lambda: harvest.fed(df.where("doc_id % 2 = 1"), *tables, most=60))
    assert len(odd) == 180 and n < most / 2


def test_evidence_of_rows_is_that_of_expressions(spark):
    """Told in batches, as the expressions tell it."""
    texts = [*LQ.CASES, None, "", " ", "1) may logo", "-dinh hinh  mui", "kiemtra khuon", "may 12", "may 12 ", "x lot no", "ab\u0085", "İΣ. Σας", "12. khong duoc", "LAST\tCHECK", "ve sinh khuon ve sinh", "漢字 ½ ²", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = L.bare(F.col("text"))
    for r in df.select("text", L.evidence(t).alias("a"), L.evidence_of_rows(t).alias("b")).where("text is not null").collect():
        assert r.a == r.b, r.text


def test_prose_is_no_code_before_all_of_it_is_read(spark):
    """F15 and the classifier's findings: what the first words refuse is what the whole test refuses; names, labels and codes pass on."""
    held = ["model abc", "sample reject )", "style ab-1", "Nike whatever else", "nike another thing", "under armour", "article widget", "color 12a", "civil engin", "model name: zoom 1", "reject .", "correct )"]
    prose = ["press the upper then wait", "ok then press the upper part", "abcde fg"]
    df = spark.createDataFrame([(t, False) for t in held] + [(t, True) for t in prose], "text string, prose boolean")
    assert all(r.prose == r.found for r in df.withColumn("found", F.col("text").rlike(P.PROSE)).collect())
    assert {r.text for r in df.where(L.is_code(F.col("text")) | P.is_label(F.col("text"))).collect()} == {"model abc", "style ab-1", "Nike whatever else", "nike another thing", "under armour", "article widget", "color 12a", "model name: zoom 1", "reject .", "correct )"}


def test_statuses_need_no_targets_of_memory(spark):
    """a status does not carry the texts of units and memory through its joins."""
    units = spark.createDataFrame([(1, "the press"), (2, "other words here")], "id long, text string")
    memory = spark.createDataFrame([("The  press", "x"), ("1) other words here", "y")], "source string, target string")
    out = classify.classified(units, memory, None, "en", "vi")
    assert {(r.id, r.status, r.suggestion) for r in out.collect()} == {(1, "TM_REUSE", "x"), (2, "TM_REUSE", "y")}
    plan = out.select("id", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(coalesce(target" not in plan


def test_single_spaces_are_not_written_again(spark):
    """F15 and the classifier's findings: the pattern of white space skips single spaces, with the keys it gave before."""
    texts = ["".join(p) for n in range(5) for p in itertools.product(" \t\n\u00a0a", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(F.regexp_replace("text", T.SPACE, " ") != F.regexp_replace("text", "[\\s\u00a0]+", " ")).isEmpty()
    assert df.where(F.col("text") == "a a").where(F.col("text").rlike(T.SPACE)).isEmpty()


@pytest.mark.parametrize("threshold", [0.5, 0.78])
def test_fuzzy_lookup_shuffles_no_trigrams_of_queries(spark, threshold):
    """entries are looked up where a query stands, with the rows that the join of trigrams gives; entries beyond the bound are joined."""
    r = random.Random(5)
    words = ["press", "upper", "heel", "not", "no", "left", "seam", "glue", "mold", "12", "1,5", "đế", "sole", "a", "of"]
    entries = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 4, 5, 6])))) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 400 + " y")]

    def changed(t):
        t, i = t or "", r.randrange(len(t or "") + 1)
        return r.choice([t, t[:i] + r.choice("xyz 7") + t[i:], t[:i] + t[i + 1 :], t.replace(" ", ", "), t[:i] + "xq" + t[i:] + " heels"])

    queries = [(i, changed(entries[r.randrange(len(entries))][1])) for i in range(600)] + [(700, None), (701, "wholly other"), (None, "press upper")]
    q, e = spark.createDataFrame(queries, "q long, q_text string").repartition(3), spark.createDataFrame(entries, "e long, e_text string")
    joined = sorted(map(tuple, memory.fuzzy_matches(q, e, threshold, postings=40, candidates=7, most=0).collect()), key=str)
    rows, few = shuffled(spark, lambda: memory.fuzzy_matches(q.limit(100), e, threshold, postings=40, candidates=7))
    rows, n = shuffled(spark, lambda: memory.fuzzy_matches(q, e, threshold, postings=40, candidates=7))
    assert len(joined) > 300 and [x for x in sorted(map(tuple, rows), key=str) if x[0] is not None] == [x for x in joined if x[0] is not None]
    assert n - few < 2_000


def test_house_style_tries_patterns_where_a_word_of_theirs_stands(spark):
    """with the texts that all patterns give, capitals and dotted letters included."""
    r = random.Random(3)
    bits = ["nosew", "NOSEW", "Nosew", "Tip quarter", "tipquarter", "TIP\tQUARTER", "Shape toe", "shape HEEL", "9-10 SPI", "spi", "Spİ", "stiches", "STITCHES per Inch", "9-10 mũi", "9-10 MŨI/INCH", "lại 2-3 mũi", "İnch", "ſpi", "a", "\n", " ", ". ", "1)", "b.", "- x", "\n2. y", "đ", "3.14.", "x.5. ", "?b", "7.c", "😀.d", "😀!4. "]
    texts = [None, "", *bits, *("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(1, 8))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = plain = F.col("t")
    for pattern, to in (("Nosew", "No-sew"), ("nosew", "no-sew"), ("NOSEW", "NO-SEW"), (r"Tip\s*quarter", "Tip-quarter"), (r"tip\s*quarter", "tip-quarter"), (r"TIP\s*QUARTER", "TIP-QUARTER")):
        plain = F.regexp_replace(plain, P.B + pattern + P.E, to)
    turned = t
    for part in ("tip", "toe", "collar", "heel", "vamp", "tongue"):
        turned = F.regexp_replace(turned, rf"(?i){P.B}Shape\s+{part}{P.E}", f"{part.capitalize()} shape")
    spaced = F.regexp_replace(F.regexp_replace(t, r"(?<=\D)([.!?])(\d+\.(?!\d)\s*)", "$1 $2"), r"(?<!\d)([.!?])(\p{L})", "$1 $2")
    now = F.regexp_replace(F.regexp_replace(t, r"([.!?])(?<=\D[.!?])(\d+\.(?!\d)\s*)", "$1 $2"), r"([.!?])(?<!\d[.!?])(\p{L})", "$1 $2")
    pairs = [(terms.hyphenated(t), plain), (terms.reordered(t), turned), (terms.stitch_density(t), terms._stitch_density(t)), (now, spaced)]
    for r_ in df.select("t", *(c.alias(f"{k}{i}") for i, p in enumerate(pairs) for k, c in zip("ab", p))).collect():
        assert all(r_[f"a{i}"] == r_[f"b{i}"] for i in range(len(pairs))), r_
    line = re.compile(rf"((?:^|\n)[{sop._SPACE}]*[*•\-#]*[{sop._SPACE}]*(?:[0-9]+[.)]|[a-zA-Z][.)])?[{sop._SPACE}]*)([^\W\d_])")
    raised = lambda m: m[1] + (m[2].upper() if m[2].islower() else m[2])
    assert all(sop.capitals(x) == line.sub(raised, sop._SENTENCE.sub(raised, x)) for x in texts if x is not None)
    assert "nosew" in df.select(terms.hyphenated(t))._jdf.queryExecution().optimizedPlan().toString().split("regexp_replace")[0]


class Counting:
    """Counts the texts that it is asked for; leaves every other one as it is."""

    def __init__(self, asked):
        self.asked = asked

    def translate(self, texts):
        self.asked.add(len(texts))
        return [t if len(t) % 2 else t.upper() + "!" for t in texts]


def test_texts_are_asked_once_and_bad_answers_again(spark):
    """the first answers are not worked out a second time for the fallback, and texts travel once."""
    asked = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "w" * (i % 20 + 1)) for i in range(100)] + [(200, None), (201, " ")], "id long, text string").repartition(3)
    rows = inference.translate(df, "text", Counting(asked), inference.Offline({}, {"w": "v"} | {"w" * 3: "x"})).select("id", "target", "origin").collect()
    assert (asked.value, len(rows)) == (20, 102)
    assert {r.target for r in rows if r.origin == "model"} == {"W" * k + "!" for k in range(2, 21, 2)}
    assert {r.target for r in rows if r.origin == "fallback"} == {"V", "X", *("W" + "w" * (k - 1) for k in range(5, 21, 2))}
    assert {r.id for r in rows if r.origin is None} == {200, 201}


def test_a_match_is_chosen_from_rows_sorted_once(spark):
    """matches are shuffled and sorted once, into more tasks for more of them; a null target counts as an empty one."""
    row = lambda q, origin, target, confidence: (q, origin, target, confidence, True, 2)
    rows = [row(1, "approved", "a", 0.95), row(1, "approved", "A ", 0.96), row(1, "history", "b", 0.99), row(2, "review", "a", 0.95), row(2, "review", "b", 0.95), row(2, "history", "c", 1.0), row(3, "review", None, 0.9), row(3, "review", "x", 0.9), row(4, "approved", "far", 0.8), row(4, "history", "near", 0.9), row(5, "history", None, 0.9)]
    df = spark.createDataFrame(rows, "q int, origin string, target string, confidence double, exact boolean, words int")
    out = memory.choose(df, rows=1)
    assert {(r.q, r.target, r.origin, r.conflict, r.safe) for r in out.collect()} == {(1, "A ", "approved", False, True), (2, "a", "review", True, False), (3, None, "review", True, False), (4, "near", "history", False, False), (5, None, "history", False, False)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"Exchange hashpartitioning\(q#\d+, 12\)", plan)) == plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_units_of_a_deck_are_read_without_a_shuffle(spark):
    """and as what encloses them tells it, where tags are closed too often or not at all, too."""
    r = random.Random(11)
    tags = ["<p:sp>", "</p:sp>", "<a:p>", "</a:p>", "<p:txBody>", "</p:txBody>", "<a:txBody>", "</a:txBody>", "<a:tc>", "</a:tc>", "<p:pic>", "</p:pic>", "<a:p/>", '<p:ph type="title"/>', '<p:cNvPr id="1" name="title 2"/>', "<a:t>Inspection", "<a:t> Strategy &amp;lt; x", "<a:t>SOP ipqc  manuals", "<a:t>qa/IPQC Manual.", "<a:t> ", "</a:t>", "<?x?>", "<!-- a -->", "<p:graphicFrame>"]
    rows = [(d, f"s{d % 7}", "".join(r.choice(tags) for _ in range(150))) for d in range(60)] + [(70, "s", None), (71, "s", "")]
    df = spark.createDataFrame(rows, "deck long, part string, xml string")
    events = decks.events(df)
    for kinds, column in ((["a:p"], "p"), (["p:txBody", "a:txBody"], "body"), (decks.SHAPES, "shape"), (["p:sp"], "sp"), (["a:tc"], "cell")):
        events = decks.enclosing(events, kinds, column)
    parts = {}
    for e in events.orderBy("deck", "n").collect():
        parts.setdefault((e.deck, e.part), []).append(e)
    expected = set()
    for (deck, part), l in parts.items():
        opened = lambda *kinds: [e.n for e in l if e.step == 1 and e.name in kinds]  # noqa: E731, B023
        said = lambda column, n, c: c.join(functools.reduce(lambda t, x: t.replace(*x), decks._ENTITIES, e.text) for e in l if e[column] == n and e.name == "a:t" and e.step == 1)  # noqa: E731, B023
        for i, n in enumerate(opened("a:p")):
            text, e = said("p", n, "").strip(" "), l[n]
            if text:
                named = [x for x in l if e.sp is not None and x.sp == e.sp and (x.name == "p:ph" or x.name == "p:cNvPr")]
                title = bool(named) or e.sp is not None and bool(re.search(r"(?i)(?<!\w)(inspection\s*strategy|(qa/?)?ipqc\s*manual)(?!\w)", said("sp", e.sp, " ")))
                shapes = opened(*decks.SHAPES)
                expected.add((deck, part, i, text, None if e.body is None else opened("p:txBody", "a:txBody").index(e.body), None if e.shape is None else shapes.index(e.shape), None if e.shape is None else l[e.shape].name, title and e.cell is None, e.cell is not None))
    rows, n = shuffled(spark, lambda: decks.units(df))
    assert n == 0 and {tuple(x) for x in rows} == expected and len(rows) == len(expected) > 100


@pytest.mark.parametrize("threshold,most", [(0.35, 1 << 20), (0.78, 1 << 20), (0.35, 0), (0.78, 0)])
def test_fuzzy_lookup_finds_every_partner(spark, threshold, most):
    """all entries that are similar enough, by comparing all pairs: more than 48 of a query, behind trigrams of more than 256 entries, and without any rare trigram or word in common."""
    r = random.Random(9)
    words = ["press", "upper", "heel", "not", "seam", "glue", "12", "de", "a", "of", "ab"]
    entries = [f"press the upper heel seam {a}{b}" for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq"] + [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 8]))) for _ in range(200)]
    entries += ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "ab cd", "x" * 349 + " y"]

    def changed(t):
        for _ in range(r.choice([1, 1, 2, 4])):
            i = r.randrange(len(t) + 1)
            t = r.choice([t[:i] + r.choice("xyz 7") + t[i:], t[:i] + t[i + 1 :], t[:i] + r.choice("qk") + t[i + 1 :]])
        return t

    queries = ["press the upper heel seam zz", "al phabeta gam madelta eps ilonzeta et atheta io takappa lambdq", "a bce", "x" * 345 + " y", *(changed(r.choice(entries)) for _ in range(150))]
    q, e = (spark.createDataFrame(list(enumerate(x)), f"{n} long, {n}_text string") for n, x in (("q", queries), ("e", entries)))
    pairs = q.select("q", T.forms(F.col("q_text")).alias("a")).crossJoin(e.select("e", T.forms(F.col("e_text")).alias("b"))).cache()
    same = pairs.where("a.compact = b.compact").select("q", "e", T.similarity(F.col("a"), F.col("b")).alias("c"))
    other = pairs.where("size(a.tokens) > 1 and length(a.compact) <= 350").join(same.select("q").distinct(), "q", "left_anti").select("q", "e", T.similarity(F.col("a"), F.col("b")).alias("c"))
    expected = {tuple(x) for x in same.unionByName(other).where(F.col("c") >= threshold).collect()}
    got = [tuple(x) for x in memory.fuzzy_matches(q, e, threshold, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len([1 for x in got if x[0] == 0]) == 288  # one ends in "no"


def test_feed_reads_lines_and_shuffles_no_phrases(spark):
    """with the candidates and targets that joins of all phrases give; lines too long for a phrase or a pair are not shuffled."""
    r = random.Random(4)
    bits = ["Tipquarter", "TIP  quarter", "Tip\tquarter", "nosew", "Nosew", "ßen", "paß", "PAß", "ok", "12a", "AB-1", "đế", "gót", "(đế)", "(x)", "keo (ưu tiên)", "a/b c", "/", "//", "stitch / inch", "mũi/inch", "run off stitching", "hình dạng", "độ bo", "mũi", "vòng  cổ", "für", "of the", "OF THE", "the", "phải", "sau  đó", "no.", "x;", "_", "é", "Élle", "İx", "Ka", "①", "漢字", "“x”", "x-y", ":", "-", "–", "a b : c", "đ = e", "\x85", " ", "\r", "", " ", "w1", "w2", "W1", "w3,", "[w4]"]
    lines = [(r.choice([None, 1, 2, 3, 4, 5]), r.randrange(3), r.choice([None, 0, 1, 2, 3]), r.choice(["", " "]) + " ".join(r.choice(bits) for _ in range(r.choice([1, 2, 3, 3, 4, 9])))) for _ in range(130)]
    lines += [(6, 0, i, f"{a} {s} {b}") for i, (a, s, b) in enumerate((a, s, b) for a in ("ab", "đế", "of the", "Tip quarter", "w9 phải") for s in (":", "-", "–") for b in ("cd", "gót", "AB", "đế"))] + [(7, 0, 0, None), (7, 0, 1, " " * 300), (7, 0, 2, "ab" + " " * 300 + ": cd"), (7, 0, 3, "long words " * 40)]
    df = spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string").repartition(3)
    glossary = spark.createDataFrame([(1, "W1 ", "x"), (2, "w2 w3", "Đế"), (3, "x-y", "a (đế)/b c"), (4, "w4!", "Tip quarter"), (5, None, "z"), (6, "12a", None), (7, "x  y", "y x"), (8, "w3 ok", "/")], "id long, source_term string, target_term string")
    tables = glossary, HQ.domain(spark), HQ.dictionary(spark)
    for most in (20, 10_000):
        joined = sorted(map(tuple, harvest.fed(df, *tables, most=most, keys=0).collect()), key=str)
        rows, n = shuffled(spark, lambda: harvest.fed(df, *tables, most=most))  # noqa: B023
        assert sorted(map(tuple, rows), key=str) == joined and len(joined) > 100 and len({x[0] for x in joined}) == 8
    assert len(joined) > 400
    wide = df.unionByName(spark.range(3000).selectExpr("id + 10 doc_id", "0 page", "0 line_no", "repeat('word ', 60) text"))
    _, more = shuffled(spark, lambda: harvest.fed(wide, *tables, most=most))
    assert more - n < 100 < len(joined)
    long = spark.createDataFrame([(1, 0, i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(200)], df.schema)
    _, all_of_one = shuffled(spark, lambda: harvest.fed(long, *tables))
    assert all_of_one - n < 200


def test_grams_are_counted_where_documents_stand(spark):
    """no text is shuffled, and counts as packed ranges; documents that stand in several places are brought together, with the same counts."""
    r = random.Random(2)
    lines = [(d, " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(6))) for d in [*range(60), None] for _ in range(100)]
    df = spark.createDataFrame(lines, "doc_id long, text string").repartition(8, "doc_id").sortWithinPartitions("doc_id").cache()
    df.count()
    rows, n = shuffled(spark, lambda: grams.grams(df, 2, 50))
    apart = grams.grams(df.repartition(6), 2, 50).collect()
    docs, total = {}, {}
    for doc, text in lines:
        w = text.split()
        for g in [*w, *map(" ".join, itertools.pairwise(w))]:
            total[g] = total.get(g, 0) + 1
            docs.setdefault(g, set()).update([] if doc is None else [doc])
    expected = {(g, len(docs[g]), total[g]) for g in total if len(docs[g]) >= 50}
    assert {tuple(x) for x in rows} == expected == {tuple(x) for x in apart} and len(rows) == len(apart) >= 24
    assert n < len(lines)
