"""Slides as profiles, and the pairing of English slides with their Vietnamese counterparts.

A deck's slides meet in windows and in one join within the deck, so its own size bounds what a task holds.
A draft translation of each slide's text (``probe``) is the caller's.

Edge cases: null texts and slides without text have empty profiles and pair with nothing; repeated slides are
numbered by the caller and pair once each; extra columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions.language import MEASURED
from ..functions.predicates import EDGE
from ..session import cut
from .align import greedy_matching

#: Patterns of steps, of language markers, and of banners that are no titles.
STEP = rf"(?iu)^\s*(?:(?:step|bước|ctq|sop|item|mục|trạm)\s*[:#]?\s*(\d+(?:\.\d+)?)|#?\s*(\d+(?:\.\d+)?)\s*(?:[.:\-/)]|\s*(?:en|vi|vn){EDGE}))"
STEP_MARK = rf"(?i){EDGE}(\d+(?:\.\d+)?)\s*[._-]?\s*(?:EN|VI|VN){EDGE}"
MARKS = {"en": rf"(?i){EDGE}(?:\d+[._-]?)?EN{EDGE}|\[EN\]|\(EN\)", "vi": rf"(?i){EDGE}(?:\d+[._-]?)?(?:VI|VN){EDGE}|\[VI\]|\(VI\)"}
BANNER = rf"(?iu){EDGE}(?:assembly\s*inspection\s*strategy|inspection\s*strategy|chiến\s*lược\s*kiểm\s*tra|standard\s*operating\s*procedure|ipqc\s*manual|qa/?ipqc\s*manual){EDGE}"
#: Words that say nothing about a slide's topic.
WEAK = """
inspection strategy focuses focus standard standards manual procedure process check make sure before after must slide title step presentation
company ching luh nike points shoe upper line into when just with from that this have been will need follow sample stop result results adjustment
grade weekly completely time temperature pressure degree unit units pairs pair
""".split()
#: Texts looked at for steps and markers; length of a long text; least overlap; least score; what each sign adds to a score.
STEP_TEXTS, MARK_TEXTS, LONG, OVERLAP, LEAST = 8, 6, 25, 0.22, 45
POINTS = {"step": 60, "marker": 40, "title": 35, "numbers": 25, "neighbour": 10}


def _content(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*WEAK)))


def profiles(slides: DataFrame) -> DataFrame:
    """(file, slide, vi, en, vi_long, en_long, total, vi_ratio, en_ratio, step, en_marker, vi_marker, title, subtitle, numbers, is_en, is_vi, low, probe) of slides (file, slide, texts; optional probe)."""
    texts = F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    rows = slides.select("file", "slide", texts.alias("t"), (F.col("probe") if "probe" in slides.columns else F.lit(None).cast("string")).alias("probe"))
    marked, latin = lambda x: P.has_marks(x), lambda x: ~P.has_marks(x) & x.rlike("[a-zA-Z]{2,}")
    long = lambda x: F.length(F.trim(x)) >= LONG
    n = lambda test: F.size(F.filter("t", test))
    one = lambda x: F.concat(F.array(F.coalesce(F.nullif(F.regexp_extract(x, STEP, 1), F.lit("")), F.nullif(F.regexp_extract(x, STEP, 2), F.lit("")))), F.array(F.nullif(F.regexp_extract(x, STEP_MARK, 1), F.lit(""))))
    steps = F.array_distinct(F.filter(F.flatten(F.transform(F.slice("t", 1, STEP_TEXTS), one)), lambda x: x.isNotNull()))
    marker = lambda name: F.exists(F.slice("t", 1, MARK_TEXTS), lambda x: x.rlike(MARKS[name]))
    numbers = F.flatten(F.transform("t", lambda x: F.transform(F.regexp_extract_all(x, F.lit(MEASURED), 1), lambda m: F.regexp_replace(F.lower(m), r"\s+", ""))))
    at = lambda i: F.trim(F.lower(F.coalesce(F.get("t", F.lit(i)), F.lit(""))))
    rows = rows.select(
        "file", "slide", n(marked).alias("vi"), n(latin).alias("en"), n(lambda x: marked(x) & long(x)).alias("vi_long"), n(lambda x: latin(x) & long(x)).alias("en_long"), F.size("t").alias("total"),
        F.when(F.size(steps) == 1, steps[0]).alias("step"), marker("en").alias("en_marker"), marker("vi").alias("vi_marker"), at(0).alias("title"), at(1).alias("subtitle"),
        F.array_distinct(F.filter(numbers, lambda x: ~x.isin("1", "2", "3", "4", "5"))).alias("numbers"), F.lower(F.array_join("t", " ")).alias("low"), "probe",
    )
    ratio = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    rows = rows.withColumns({"vi_ratio": ratio("vi"), "en_ratio": ratio("en")})
    is_en = F.expr("case when en_marker and not vi_marker then true when en_long >= 2 and en_long > vi_long * 2 then true else (vi = 0 and (en_ratio >= 0.20 or en >= 1)) or (en > vi and (vi <= 1 or vi_ratio < 0.25)) end")
    is_vi = F.expr("case when vi_marker and not en_marker then true when vi_long >= 2 and vi_long > en_long then true else (vi >= 1 and (vi_ratio >= 0.20 or vi >= en)) or vi >= 2 end")
    return rows.withColumns({"is_en": is_en, "is_vi": is_vi})


#: Longest word whose parts are looked up one by one.
PARTED = 32


def with_content(profiled: DataFrame) -> DataFrame:
    """profiles with ``drafted`` and ``there``: the content words of the draft and of the slide, a line each, told once for each slide."""
    return profiled.withColumns({"drafted": F.array_join(_content(F.col("probe")), "\n"), "there": F.array_join(_content(F.col("low")), "\n")})


def overlap(drafted: Column, there: Column) -> Column:
    """Share of the draft's content words (a line each) that the English slide has, in whole or in part; null if either is null.

    A word is part of one there if it stands in their lines, and holds one if one of its own parts is there, so no word meets all others."""
    longest, shortest = PARTED, 4  # content words have four letters at least

    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        @lru_cache(1 << 16)
        def parts(word: str) -> frozenset[str]:
            return frozenset(word[i:j] for i in range(len(word)) for j in range(i + shortest, len(word) + 1))

        @lru_cache(64)
        def words(lines: str) -> frozenset[str]:
            return frozenset(lines.split("\n")) - {""}

        def share(own: str | None, other: str | None) -> float | None:
            if own is None or other is None:
                return None
            known, mine = words(other), words(own)
            held = lambda p: p in other or (not known.isdisjoint(parts(p)) if len(p) <= longest else any(w in p for w in known))
            return sum(map(held, mine)) / len(mine) if mine else 0.0

        return pd.Series([share(*(None if pd.isna(x) else x for x in pair)) for pair in zip(one, two)], dtype="float64")

    return F.pandas_udf(run, "double")(drafted, there)


def agreement(e: Column, v: Column) -> Column:
    """How sure an English and a Vietnamese profile (``with_content``) are one slide's two versions, 0 to 1; null if steps, parts, stages, measures or words part them."""
    en, vi = lambda *w: _has(e["low"], *w), lambda *w: _has(v["low"], *w)
    step_match, step_differs = F.coalesce(e["step"] == v["step"], F.lit(False)), F.coalesce(e["step"] != v["step"], F.lit(False))
    markers = e["en_marker"] & v["vi_marker"]
    # fixed values: words of parts and stages in both languages
    heel, toe, gót, mũi = en("heel"), en("toe", "tip"), vi("gót", "hậu"), vi("mũi")
    parts = (heel & ~toe & mũi & ~gót) | (toe & ~heel & gót & ~mũi)
    cut_e, cut_v = en("cutting") & ~en("after cutting"), vi("chặt", "cutting") & ~vi("sau khi chặt")
    put_e, put_v = en("assembly", "lasting", "bpm", "gò"), vi("thành hình", "lắp ráp", "gò", "bpm")
    sew_e, sew_v = en("stitching", "sewing"), vi("may") & ~vi("may mắn")
    stages = (cut_e & ~cut_v & (put_v | sew_v)) | (cut_v & ~cut_e & (put_e | sew_e)) | (put_e & ~put_v & (cut_v | sew_v)) | (put_v & ~put_e & (cut_e | sew_e))
    measures = (F.size(e["numbers"]) >= 2) & (F.size(v["numbers"]) >= 1) & ~step_match & ~markers & ~F.arrays_overlap(e["numbers"], v["numbers"])
    barred = F.coalesce(step_differs | parts | stages | measures, F.lit(False))
    r = overlap(F.when(~barred, v["drafted"]), e["there"])  # null if barred
    return F.when(r.isNull() | (r < OVERLAP) & ~step_match & ~markers, None).otherwise(F.greatest(r, F.when(step_match, 0.9).otherwise(0.6)))


def _has(text: Column, *words: str) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def _titled(a: Column, b: Column) -> tuple[Column, Column]:
    """Whether two profiles share their title, and their second line."""
    plain = lambda x: (x != "") & ~x.rlike(BANNER)
    title = plain(a["title"]) & plain(b["title"]) & (a["title"].contains(b["title"]) | b["title"].contains(a["title"]))
    return title, plain(a["subtitle"]) & plain(b["subtitle"]) & (a["subtitle"] == b["subtitle"])


def pairs(slides: DataFrame) -> DataFrame:
    """(file, en, vi) slides that are versions of each other: neighbours first; if they are few, the best scored of the others, each slide once."""
    rows = cut(with_content(profiles(slides)).drop("probe"))  # read five times
    names = [c for c in rows.columns if c != "file"]
    deck = Window.partitionBy("file").orderBy("slide")
    both = rows.select("file", F.struct(*names).alias("a")).withColumn("b", F.lead("a").over(Window.partitionBy("file").orderBy("a.slide"))).withColumn("slides", F.count("*").over(Window.partitionBy("file")))
    a, b = F.col("a"), F.col("b")
    title, sub = _titled(a, b)
    step_match, step_differs = F.coalesce(a["step"] == b["step"], F.lit(False)), F.coalesce(a["step"] != b["step"], F.lit(False))
    marker = (a["en_marker"] & b["vi_marker"]) | (a["vi_marker"] & b["en_marker"])
    topic = ((title & (F.length(a["title"]) >= 8)) | (sub & (F.length(a["subtitle"]) >= 8))) & (((a["en_long"] >= 2) & (b["vi_long"] >= 2)) | ((a["vi_long"] >= 2) & (b["en_long"] >= 2)))
    sign = ~step_differs & (step_match | marker | topic) & (title | sub | marker)
    first = F.when(sign & a["is_en"] & b["is_vi"], True).when(sign & a["is_vi"] & b["is_en"], False)
    sided = cut(both.where(b.isNotNull()).withColumn("first", first).where("first is not null").select("file", "slides", a["slide"].alias("slide"), F.when(F.col("first"), a).otherwise(b).alias("e"), F.when(F.col("first"), b).otherwise(a).alias("v")))
    found = sided.select("file", "slides", "slide", F.col("e.slide").alias("en"), F.col("v.slide").alias("vi"), agreement(F.col("e"), F.col("v")).isNotNull().alias("held")).where("held")
    found = cut(found)  # few and narrow rows; what follows reads them three times, and planning all of it again took minutes
    # neighbours are taken from left to right: of a run of candidates every second one
    run = found.withColumn("_n", F.row_number().over(deck)).withColumn("_run", F.col("slide") - F.col("_n"))
    near = run.withColumn("_i", F.row_number().over(Window.partitionBy("file", "_run").orderBy("slide"))).where("_i % 2 = 1").select("file", "slides", "en", "vi")
    near = near.withColumn("_k", F.count("*").over(Window.partitionBy("file")))
    enough = near.where("_k >= 2 or (_k = 1 and slides <= 4) or _k * 2 >= slides * 0.4").select("file").distinct()
    used = near.select("file", F.explode(F.array("en", "vi")).alias("slide")).distinct()
    left = rows.join(enough, "file", "left_anti").join(used, ["file", "slide"], "left_anti")
    e, v = left.where("is_en").select("file", F.struct(*names).alias("e")), left.where("is_vi").select("file", F.struct(*names).alias("v"))
    scored = e.join(v, "file").where("e.slide <> v.slide").withColumn("sure", agreement(F.col("e"), F.col("v"))).where("sure is not null")
    e, v = F.col("e"), F.col("v")
    title, sub = _titled(e, v)
    points = lambda test, name: F.when(test, POINTS[name]).otherwise(0)
    score = T.half_up(F.col("sure") * 100) + points(e["step"] == v["step"], "step") + points(e["en_marker"] & v["vi_marker"], "marker") + points(title | sub, "title") + points(F.arrays_overlap(e["numbers"], v["numbers"]), "numbers") + points(F.abs(e["slide"] - v["slide"]) == 1, "neighbour")
    far = greedy_matching(scored.select("file", e["slide"].alias("a"), v["slide"].alias("b"), score.alias("score")), "file", LEAST)
    return near.select("file", "en", "vi").union(far.select("file", "a", "b"))
