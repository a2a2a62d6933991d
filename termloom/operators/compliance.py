"""Compliance of finished texts: a checker of four rules, and the post-flight gate that mends what it can and reports the rest.

Rules are data in order: (type, pattern, replacement). Each text is mended in one expression; what changed is told
by comparing the steps, so nothing is shuffled before the report's aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import predicates as P
from ..functions import terms as X
from ..functions import text as T
from ..functions.predicates import EDGE


def violations(text: Column) -> Column:
    """Names of the rules that an English text breaks, in order; null breaks none."""
    text = F.coalesce(text, F.lit(""))
    # fixed values: patterns of unhyphenated terms and of bare stitch densities
    rules = {
        "no-sew": text.rlike(rf"(?i){EDGE}nosew{EDGE}"),
        "tip-quarter": text.rlike(rf"(?i){EDGE}tip\s*quarter{EDGE}") & ~text.rlike(rf"(?i){EDGE}tip-quarter{EDGE}"),
        "spi": text.rlike(rf"(?i){EDGE}(\d+)\s*SPI{EDGE}"),
        "leak": P.has_marks(text),
    }
    return F.filter(F.array(*(F.when(broken, name) for name, broken in rules.items())), lambda x: x.isNotNull())


#: Mistakes of finished texts with their mends, in order.
MENDS = [
    ("typo_repair", r"(?i)\*?Spray\s+cement\s+and\s+(?:aplly|apply)\s+(?:cement\s+)?foam", "*Spray cement and attach cement foam"),
    ("typo_repair", rf"(?i){EDGE}(?:apply|aplly)\s+cement\s+foam{EDGE}", "attach cement foam"),
    ("typo_repair", rf"(?i){EDGE}aplly{EDGE}", "apply"),
    ("typo_repair", r"(?i)(?:the\s+)?(?:swoosh|logo)\s+is\s+printed\s+together\s+without\s+matching", "logos can be used together without color matching"),
    ("typo_repair", rf"(?i){EDGE}Check\s+if\s+nosew\s+bond\s+gap/delaminate\s+on\s+upper{EDGE}", "Check if the upper is free of no-sew bond gaps and delamination"),
    ("translation_quality", rf"(?i){EDGE}Check\s+with{EDGE}", "Check if"),
    ("typo_repair", rf"(?i){EDGE}quality\s+standard\s+tolerances\s+are\s+acceptable{EDGE}", "quality standard are acceptable"),
]


def mended(text: Column, mends=MENDS) -> Column:
    """Struct of text and types: an English run with stitch densities, noun order, known mistakes and hyphens put right, and the type of each step that changed it. Runs with Vietnamese letters stay."""
    steps = [("invalid_spi", X.stitch_density), ("inverted_phrase", X.reordered)]
    steps += [(kind, lambda t, p=p, to=to: F.regexp_replace(t, p, to)) for kind, p, to in mends] + [("typo_repair", X.hyphenated)]
    state = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<string>").alias("types"))
    for kind, step in steps:
        state = T.let(state, lambda s, k=kind, f=step: T.let(f(s["text"]), lambda new: F.struct(new.alias("text"), F.when(new != s["text"], F.concat(s["types"], F.array(F.lit(k)))).otherwise(s["types"]).alias("types"))))
    kept = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<string>").alias("types"))
    return F.when(P.has_marks(F.coalesce(text, F.lit(""))), kept).otherwise(state)


def rogue_headings(paragraphs: DataFrame) -> DataFrame:
    """(body, para_no) of headings to remove from bodies of more than two paragraphs: those between two numbered steps that follow each other, and repeats of a heading that stays."""
    body = Window.partitionBy("body")
    order = body.orderBy("para_no")
    step = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d+)[.)]", 1), F.lit("")).cast("decimal(38,0)")
    t = T.squeeze(F.coalesce("text", F.lit("")))
    rows = paragraphs.select("body", "para_no", t.alias("t"), F.count("*").over(body).alias("n"), step(F.lag(t).over(order)).alias("before"), step(F.lead(t).over(order)).alias("after"))
    rows = rows.where("n > 2").withColumn("between", F.coalesce(F.col("after") > F.col("before"), F.lit(False))).where(F.col("t").rlike(r"^\s*[*•#]\s*\S+"))
    seen = Window.partitionBy("body", F.lower("t")).orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("again", F.coalesce(F.max(F.when(~F.col("between"), 1)).over(seen) == 1, F.lit(False))).where("between or again").select("body", "para_no")


def post_flight(runs: DataFrame) -> DataFrame:
    """Runs (slide, text) with fixed, types and leak: an untranslated Vietnamese text of more than five characters that nothing could mend."""
    rows = runs.withColumn("_m", mended(F.col("text")))
    leak = F.coalesce((P.has_marks(F.col("text")) | L.is_vietnamese(F.col("text"))) & (F.length(T.squeeze(F.col("text"))) > 5), F.lit(False))
    return rows.select(*runs.columns, F.col("_m.text").alias("fixed"), F.col("_m.types").alias("types"), leak.alias("leak"))


def report(audited: DataFrame, key: str) -> DataFrame:
    """Per key issues by type, repaired issues and whether the gate is passed (nothing is left untranslated)."""
    kinds = ("invalid_spi", "inverted_phrase", "typo_repair", "translation_quality")
    n = lambda kind: F.sum(F.size(F.filter("types", lambda x: x == kind))).alias(kind)
    return audited.groupBy(key).agg(*map(n, kinds), F.count_if("leak").alias("vi_leak"), F.sum(F.size("types")).alias("repaired"), (F.count_if("leak") == 0).alias("passed"))


def merged(reports: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Post-flight reports with the issues that other gates found (groups: key, issues); any such issue fails the gate."""
    more = groups.groupBy(key).agg(F.sum("issues").alias("gate_issues"))
    return reports.join(more, key, "left").withColumn("gate_issues", F.coalesce("gate_issues", F.lit(0))).withColumn("passed", F.col("passed") & (F.col("gate_issues") == 0))
