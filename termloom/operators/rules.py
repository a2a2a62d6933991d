"""Data-driven rules: triggers, prohibited phrases, rewriting, harvesting, and the offline translator.

Rules and dictionaries are tables of bounded size, given as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from .grams import grams as grams

RULE = "id string, name string, category string, patterns array<string>, prohibited array<string>, replacement string, enabled boolean, priority int"


def table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


#: Patterns or phrases of rules, at most: texts are matched with each of them.
MOST_PATTERNS = 10_000


def _few(patterns: DataFrame) -> DataFrame:
    """patterns with a broadcast hint, once they are counted."""
    if (n := patterns.count()) > MOST_PATTERNS:
        raise ValueError(f"{n} patterns; texts are matched with {MOST_PATTERNS} at most")
    return F.broadcast(patterns)


def triggered(texts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """FIL24: (key, rule id, priority) of enabled rules one of whose patterns occurs, as a regex over the lower-cased text."""
    patterns = rules.where("enabled").select("id", "priority", F.explode("patterns").alias("pattern"))
    hit = F.expr("rlike(lower(text), lower(pattern))")
    return texts.join(_few(patterns), hit).select(key, F.col("id").alias("rule"), "priority").distinct()


def prohibited(texts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """FIL25: (key, rule, phrase) of phrases that a rule forbids."""
    phrases = rules.where("enabled").select(F.col("id").alias("rule"), F.explode("prohibited").alias("phrase"))
    return texts.join(_few(phrases), F.expr("contains(lower(text), lower(phrase))")).select(key, "rule", "phrase").distinct()


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """ordered rewrites, each a pattern and its replacement."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def cleaned(text: Column) -> Column:
    """a harvested candidate without bullets, brackets and closing punctuation."""
    return T.squeeze(F.regexp_replace(F.regexp_replace(text, r"^[\s*•#\-–0-9.)(]+", ""), r"[\s.,:;!?)(]+$", ""))


def harvested(units: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Candidate terms of the units (short lines and parts of "A: B" lines), cleaned, not yet known, in at least so many documents; the first place of each."""
    parts = units.select("doc_id", "line_no", F.explode(F.split("text", r"[:|]")).alias("part")).withColumn("term", cleaned(F.col("part"))).where(P.is_special_term(F.col("term")) & (F.length("term") >= 3))
    keyed = parts.withColumn("key", T.word_key(F.col("term"))).join(known.select(T.word_key(F.col("source_term")).alias("key")).distinct(), "key", "left_anti")
    found = keyed.groupBy("key").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    return found.where(F.col("documents") >= least).select("key", "documents", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))


def labelled_pairs(lines: DataFrame) -> DataFrame:
    """SRC04, SRC05, SRC06: "A: B" lines as candidate (source, target) rows."""
    a, b = F.trim(F.regexp_extract("text", r"^([^:]{2,60}):\s*(.+)$", 1)), F.trim(F.regexp_extract("text", r"^([^:]{2,60}):\s*(.+)$", 2))
    return lines.select("doc_id", "line_no", a.alias("source"), b.alias("target")).where("source <> '' and target <> ''")


def word_diff(old: Column, new: Column) -> Column:
    """what differs between two texts after their common first and last words: (old part, new part)."""
    a, b = F.split(F.trim(old), r"\s+"), F.split(F.trim(new), r"\s+")
    n = F.least(F.size(a), F.size(b))

    def common(x: Column, y: Column, most: Column) -> Column:
        same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q)
        miss = F.array_position(F.transform(same, lambda v: F.when(v, 0).otherwise(1)), 1)
        return F.least(most, F.when(miss == 0, n).otherwise(miss - 1).cast("int"))

    head = common(a, b, n)
    tail = common(F.reverse(a), F.reverse(b), n - head)
    part = lambda w: F.array_join(F.slice(w, head + 1, F.size(w) - head - tail), " ")
    return F.struct(part(a).alias("old"), part(b).alias("new"))


def translated(text: Column, glossary: dict[str, str], words: dict[str, str]) -> Column:
    """The offline translator: glossary phrases first (longest first), then word by word; other words stay. Dictionaries are literals of bounded size."""
    out = F.lower(text)
    for phrase in sorted(glossary, key=lambda p: (-len(p), p)):
        out = F.replace(out, F.lit(phrase), F.lit(glossary[phrase]))
    table = F.create_map(*(F.lit(x) for kv in sorted(words.items()) for x in kv))
    done = F.array_join(F.transform(F.split(out, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")
    return F.concat(F.upper(F.substring(done, 1, 1)), F.substring(done, 2, 1 << 30))
