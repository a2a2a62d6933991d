"""Quality rules and roll-ups over translation pairs, units and slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T

#: Standards that translations keep.
KEPT = ["ISO", "API", "SQL", "RTO", "RBAC", "MFA", "SSO"]


def _missing(items: Column, target: Column, variants) -> Column:
    return F.size(F.filter(items, lambda x: ~variants(x, target)))


def _swapped(x: Column) -> Column:
    """The first decimal point as a comma, or the other way round."""
    return F.when(x.contains("."), F.regexp_replace(x, r"^([^.]*)\.", "$1,")).otherwise(F.regexp_replace(x, r"^([^,]*),", "$1."))


def qa(source: Column, target: Column) -> dict[str, Column]:
    """What a translation lost, its score (halves up) and whether it passes."""
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(source, F.lit(pattern), 1))
    b, e = P.B, P.E
    nums, urls = found(rf"{b}(\d+(?:[.,]\d+)?){e}"), found(r"(https?://\S+)")
    percent, mails = found(rf"{b}(\d+(?:[.,]\d+)?\s*%)"), found(r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})")
    number = _missing(nums, target, lambda x, t: t.contains(x) | t.contains(_swapped(x)))
    raw = lambda x: F.trim(F.replace(x, F.lit("%"), F.lit("")))
    share = _missing(percent, target, lambda x, t: t.contains(x) | t.contains(F.concat(raw(x), F.lit("%"))) | t.contains(F.concat(raw(x), F.lit(" %"))) | t.contains(F.concat(_swapped(raw(x)), F.lit("%"))) | t.contains(F.concat(_swapped(raw(x)), F.lit(" %"))))
    url, mail = (_missing(x, target, lambda v, t: t.contains(v)) for x in (urls, mails))
    lost = sum((F.when(source.rlike(f"(?i){b}{a}{e}") & ~target.rlike(f"(?i){b}{a}{e}"), 1).otherwise(0) for a in KEPT), F.lit(0))
    issues = number + share + url + mail + lost
    checks = F.size(nums) + F.size(percent) + F.size(urls) + F.size(mails) + lost
    score = F.when(checks > 0, F.greatest(F.lit(0), T.half_up(100 - issues * (100 / F.greatest(checks, F.lit(4)))))).otherwise(100).cast("int")
    return {"missing_numbers": number, "missing_percentages": share, "missing_urls": url, "missing_emails": mail, "missing_acronyms": lost, "score": score, "passed": (url + mail == 0) & (score >= 80)}


def compliance(paragraphs: DataFrame, key: str) -> DataFrame:
    """Per deck leaks, stitch density, noun order and headings, weighted 0.4, 0.2, 0.2, 0.2, and the grade."""
    b, e = P.B, P.E
    s, t = F.trim("source"), F.trim("target")
    there = t != ""
    heading = r"^\s*\*[\w\s/\-]+:"
    g = paragraphs.groupBy(key).agg(
        F.count("*").alias("paragraphs"),
        F.count_if(there & P.has_marks(t)).alias("leaks"),
        F.count_if(there & (t.rlike(rf"(?i){b}\d+\s*spi{e}") | t.rlike(rf"(?i){b}spi\s+\d+-\d+{e}(?![\s\w]*stitches/inch)"))).alias("densities"),
        F.count_if(there & t.rlike(rf"(?i){b}shape\s+(tip|toe|collar|heel){e}")).alias("nouns"),
        F.count_if(there & s.rlike(heading)).alias("headings"),
        F.count_if(there & s.rlike(heading) & t.rlike(heading)).alias("kept_headings"),
    )
    part = lambda n, cost: F.greatest(F.lit(0), 100 - F.col(n) * cost)
    form = F.when(F.col("headings") == 0, 100).otherwise(T.half_up(F.col("kept_headings") / F.col("headings") * 100))
    score = T.half_up(part("leaks", 25) * 0.4 + part("densities", 20) * 0.2 + part("nouns", 20) * 0.2 + form * 0.2)
    return g.withColumn("score", score.cast("int")).withColumn("grade", F.when(F.col("score") >= 98, "A+").when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").otherwise("C"))


#: Verbs that make a condition, as a pattern.
FINITE = r"is|are|has|have|does|do|can|must|should|will|remains?|matches?|fits?|aligns?|exceeds?|meets?|follows?|shows?|covers?|contains?|overlaps?|passes?|stays?|lies?|sits?|reaches?|touches?|looks?|feels?"


def instruction_issues(source: Column, target: Column) -> Column:
    """Names of the rules that an English instruction breaks, alone and against its source (null: none is known), in order, each once."""
    b, e = P.EDGE, P.EDGE
    target = F.coalesce(target, F.lit(""))
    body = T.without_step(target)
    has = lambda t, p: t.rlike(rf"(?i){p}")
    # fixed values: patterns of instructions and of their mistakes
    opens = has(body, rf"^check\s+if{e}")
    clause = F.split(F.regexp_replace(body, r"(?i)^check\s+if\s*", ""), r"[,;.!?]")[0]
    few = F.size(F.regexp_extract_all(clause, F.lit(r"(\p{L}+)"), 1)) <= 3
    unfinished = (clause == "") | (~has(clause, rf"{b}(?:{FINITE}){e}") & (few | has(clause, rf"^(?:the\s+)?(?:consistent|correct|no|free\s+of){e}") | has(clause, rf"{b}(?:attached|aligned|positioned|centered|pressed|stitched|bonded){e}")))
    broken = (
        (opens & unfinished) | has(body, rf"{b}(?:isn['’]t|is\s+not|aren['’]t|are\s+not)\s+(?:align|attach|stitch){e}") | has(body, rf"{b}(?:must\s+edge-even|with\s+be\s+at\s+center|is\s+not\s+scratch{e})")
        | has(body, rf"^check\s+if\s+(?:the\s+)?(?:upper|mold|machine|tool|part)\s+match{e}") | has(body, r"^check\s+if\s+(?:the\s+)?(?:real\s+temp|temperature)\s+\d+")
    )
    asked = T.without_step(F.coalesce(source, F.lit("")))
    inspects = has(asked, rf"^kiểm\s+tra{e}") | asked.rlike(r"(?iu)(?:^|\s)có\s+.+\s+không[?.!]?$")
    limited = source.rlike(r"(?iu)không\s+(?:vượt|quá)|tối\s+đa") & ~has(target, rf"{b}(?:not\s+exceed|no\s+more\s+than|at\s+most|maximum|up\s+to|within){e}|[≤<]=?")
    model = T.model_section(source).isNotNull() & source.rlike(r"(?iu)^\s*[*•#]?\s*(?:đối\s+với|dành\s+cho|áp\s+dụng\s+cho)") & has(target, rf"{b}cutting\s+die{e}") & ~source.rlike(r"(?iu)dao|khuôn")
    known = lambda test: F.coalesce(source.isNotNull() & test, F.lit(False))
    rules = [
        F.when(P.is_fragment(target), "incomplete_instruction"),
        F.when(has(body, rf"{b}check\s+with{e}") | known(inspects & ~opens), "check_if_required"),
        F.when(broken, "incomplete_condition"),
        F.when(known(F.size(F.array_except(T.measurements(source), T.measurements(target))) > 0), "missing_measurement"),
        F.when(known(limited), "missing_restriction"),
        F.when(known(model), "unsupported_operation"),
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def term_coverage(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Per unit the share of its distinct matched terms (key, term, target_form) whose target occurs in targets (key, text); per cent, halves up."""
    rows = matches.select("key", "term", "target_form").distinct().join(targets, "key")
    found = rows.groupBy("key").agg(F.count("*").alias("terms"), F.count_if(F.lower("text").contains(F.lower("target_form"))).alias("present"))
    return found.withColumn("compliance", T.half_up(100.0 * F.col("present") / F.col("terms")).cast("int"))


def status_histogram(units: DataFrame, batch: int = 25) -> DataFrame:
    """Units by status, and the batches that the pending ones make."""
    by = units.groupBy("status").agg(F.count("*").alias("n"))
    return by.withColumn("batches", F.when(F.col("status") == "NEEDS_TRANSLATION", F.ceil(F.col("n") / batch)).otherwise(0))


def buckets(units: DataFrame) -> DataFrame:
    """Pending units by status and key: their number, least confidence and whether all are safe."""
    g = units.groupBy("status", "key").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.every("safe").alias("safe"))
    return g.where("n > 1")


def deck_statistics(units: DataFrame, key: str) -> DataFrame:
    """Lines, words, characters and first line by document."""
    return units.groupBy(key).agg(F.count("*").alias("lines"), F.sum(F.size(F.array_remove(F.split(F.trim("text"), r"\s+"), ""))).alias("words"), F.sum(F.length("text")).alias("chars"), F.substring(F.min_by(F.trim("text"), "line_no"), 1, 80).alias("title"))


def snapshot(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One fingerprint of a table, whatever its order: hashes of rows, summed."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("fingerprint"))


def entity_report(pairs: DataFrame) -> DataFrame:
    """Total, distinct and saved items."""
    return pairs.agg(F.count("*").alias("total"), F.countDistinct("key").alias("unique")).withColumn("saved", F.col("total") - F.col("unique"))


def _whole_word(term: Column) -> Column:
    """A pattern of a term as a whole word, perhaps in the plural, whatever its case and spacing."""
    escaped = F.regexp_replace(F.regexp_replace(F.trim(term), r"([.*+?^${}()|\[\]\\])", r"\\\\$1"), r"\s+", r"\\\\s+")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), escaped, F.lit(r"(?:s|es)?(?![\p{L}\p{N}])"))


def conflicts(observations: DataFrame, matches: DataFrame, glossary: DataFrame) -> DataFrame:
    """Per term (term, preferred, missing, variants, units, first_unit, candidates): units whose target lacks the preferred form, or has another approved one beside it.

    observations: (unit, target); matches: (unit, term) of terms in the units' sources; glossary: (term, target, rank), the
    preferred target is that of least rank. Flags are computed for each unit and term, and combined before the shuffle.
    """
    order = F.struct("rank", "target")
    terms = glossary.groupBy("term").agg(F.min_by("target", order).alias("preferred"), F.array_sort(F.collect_set("target")).alias("all"))  # as many as a term has approved forms
    rows = matches.select("unit", "term").distinct().join(observations.select("unit", F.coalesce("target", F.lit("")).alias("target")), "unit").join(terms, "term")
    rest = F.call_function("regexp_replace", F.col("target"), _whole_word(F.col("preferred")), F.lit(" "))
    found = F.filter("all", lambda a: (F.lower(a) != F.lower(F.col("preferred"))) & F.call_function("rlike", rest, _whole_word(a)))
    rows = rows.select("unit", "term", "preferred", (~F.call_function("rlike", F.col("target"), _whole_word(F.col("preferred")))).alias("lacks"), found.alias("found")).where("lacks or size(found) > 0")
    groups = rows.groupBy("term", "preferred").agg(F.count_if("lacks").alias("missing"), F.count_if(F.size("found") > 0).alias("variants"), F.count("*").alias("units"), F.min("unit").alias("first_unit"))
    seen = rows.select("term", F.explode("found").alias("c")).distinct().groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("candidates"))
    return groups.join(seen, "term", "left").withColumn("candidates", F.coalesce("candidates", F.lit("")))
