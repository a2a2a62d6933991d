"""Glossary store: filters, orders, expansion in both directions, winners, upserts, health.

Glossaries are relations like any other here: keyed operators shuffle on normalised terms, nothing is
collected. Columns: id, source_term, target_term, source_lang, target_lang, status, priority, category,
created_by, updated_at, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T


def search(terms: DataFrame, status: str = "all", source_lang: str | None = None, target_lang: str | None = None, query: str | None = None) -> DataFrame:
    """FIL01: by status (or the pseudo-status auto_harvested), direction, and a substring of source, target or category."""
    if status == "auto_harvested":
        terms = terms.where("created_by = 'Auto-Harvester'")
    elif status != "all":
        terms = terms.where(F.col("status") == status)
    if source_lang:
        terms = terms.where(F.col("source_lang") == source_lang)
    if target_lang:
        terms = terms.where(F.col("target_lang") == target_lang)
    if query:
        found = F.lit(False)
        for c in ("source_term", "target_term", "category"):
            found = found | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
        terms = terms.where(found)
    return terms


def eligible(terms: DataFrame, include_review: bool = False) -> DataFrame:
    """FIL02."""
    return terms.where(F.col("status").isin("approved", *["review"] * include_review))


ORDERS: dict[str, list[Column]] = {}


def ordering(name: str) -> list[Column]:
    """One of the list orders, made total by the id; priority ascends here."""
    tail = [F.col("priority").asc(), F.length("source_term").desc(), F.col("id").asc()]
    return {
        "newest": [F.col("updated_at").desc(), *tail],
        "oldest": [F.col("updated_at").asc(), *tail],
        "az_en": [F.col("source_term").asc(), F.col("id").asc()],
        "az_vi": [F.collate("target_term", "vi").asc(), F.col("id").asc()],
        "priority": tail,
    }[name]


def page(terms: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """FIL03, L07: one page of a listing."""
    return terms.orderBy(*ordering(order)).offset((number - 1) * size).limit(size)


def both_directions(terms: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """Rows of the direction and reversed rows of the opposite one, with is_direct."""
    direct = terms.where((F.col("source_lang") == source_lang) & (F.col("target_lang") == target_lang)).withColumn("is_direct", F.lit(True))
    back = terms.where((F.col("source_lang") == target_lang) & (F.col("target_lang") == source_lang))
    back = back.withColumns({"source_term": F.col("target_term"), "target_term": F.col("source_term"), "source_lang": F.lit(source_lang), "target_lang": F.lit(target_lang), "is_direct": F.lit(False)})
    return direct.unionByName(back)


def aliases(source: Column, target: Column) -> Column:
    """(source, target) variants of a row: itself, slash alternatives (aligned if both sides have as many), and without or with its parenthesis."""
    edge = r"^[/\\,;:.\s]+|[/\\,;:.\s]+$"
    unit = source.rlike(rf"(?iu){P.B}(mũi\s*/\s*inch|kg\s*/\s*cm2|g\s*/\s*cm2|km\s*/\s*h|\d+\s*/\s*\d+){P.E}")
    parts = lambda c: F.filter(F.transform(F.split(c, "/"), lambda p: F.trim(F.regexp_replace(p, edge, ""))), lambda p: F.length(p) >= 2)
    a, b = parts(source), parts(target)
    pair = lambda s, t: F.struct(s.alias("source"), t.alias("target"))
    slashed = F.when(source.contains("/") & ~unit & (F.size(a) > 0) & target.contains("/") & (F.size(a) == F.size(b)), F.zip_with(a, b, pair)).when(
        source.contains("/") & ~unit & (F.size(a) >= 2) & (F.length(source) <= 35), F.transform(a, lambda s: pair(s, target))
    )
    bare = F.trim(F.regexp_replace(T.squeeze(F.regexp_replace(source, r"\([^)]+\)", "")), edge, ""))
    inside = F.trim(F.regexp_replace(F.regexp_extract(source, r"\(([^)]+)\)", 1), edge, ""))
    named = source.rlike(r"\([^)]+\)") & (F.length(bare) >= 2)
    both = named & F.length(inside).between(2, 19) & ~inside.rlike(r"^\d+$")
    none = F.array().cast("array<struct<source:string,target:string>>")
    return F.array_distinct(
        F.concat(
            F.array(pair(source, target)),
            F.coalesce(slashed, none),
            F.when(named, F.array(pair(bare, target))).otherwise(none),
            F.when(both, F.array(pair(F.concat_ws(" ", inside, bare), target), pair(F.concat_ws(" ", bare, inside), target))).otherwise(none),
        )
    )


def expand(terms: DataFrame) -> DataFrame:
    """U02 over a table: one row for each safe alias."""
    rows = terms.withColumn("alias", F.explode(aliases(F.col("source_term"), F.col("target_term")))).withColumns({"source_term": F.col("alias.source"), "target_term": F.col("alias.target")}).drop("alias")
    return rows.where(P.is_safe_term(*(F.col(c) for c in ("source_term", "target_term", "status", "source_lang", "target_lang"))))


def ranking() -> list[Column]:
    """Direct, approved, priority (descending here), newest, no slash, id."""
    return [F.col("is_direct").desc(), (F.col("status") == "approved").desc(), F.col("priority").desc(), F.col("updated_at").desc(), F.col("target_term").contains("/").asc(), F.col("id").asc()]


def first_of_each_pair(terms: DataFrame) -> DataFrame:
    """The best row of each (source, target)."""
    key = Window.partitionBy(F.lower(F.trim("source_term")), F.lower(F.trim("target_term"))).orderBy(*ranking())
    return terms.withColumn("r", F.row_number().over(key)).where("r = 1").drop("r")


def winners(terms: DataFrame) -> DataFrame:
    """Per source term the winner by direct, priority and time; ambiguous if ties name several targets."""
    key = Window.partitionBy(T.exact_key(F.col("source_term")))
    best = key.orderBy(F.col("is_direct").desc(), F.col("priority").desc(), F.col("updated_at").desc())
    top = terms.withColumn("source_key", T.exact_key(F.col("source_term"))).withColumn("r", F.rank().over(best)).where("r = 1")
    return top.groupBy("source_key").agg(F.min("id").alias("id"), F.min_by("target_term", "id").alias("target_term"), F.countDistinct("target_term").alias("n_targets")).withColumn("ambiguous", F.col("n_targets") > 1)


def facets(terms: DataFrame) -> DataFrame:
    """Counts by category."""
    return terms.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("created_by") == "Auto-Harvester").alias("auto"), F.count_if(F.col("source_lang") == "vi").alias("from_vi"))


def health(terms: DataFrame) -> DataFrame:
    """A10: rows by reason of rejection; null: healthy."""
    return terms.groupBy(P.term_problem(F.col("source_term"), F.col("target_term"), F.col("source_lang")).alias("reason")).agg(F.count("*").alias("n"))


def key_of(source: str, target: str) -> list[Column]:
    return [F.lower(F.trim(source)).alias("k_source"), F.lower(F.trim(target)).alias("k_target")]


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (source, target) is not there yet, each pair once (the least id)."""
    first = incoming.select("*", *key_of("source_term", "target_term"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("k_source", "k_target").orderBy("id"))).where("r = 1").drop("r")
    return first.join(existing.select(*key_of("source_term", "target_term")).distinct(), ["k_source", "k_target"], "left_anti").drop("k_source", "k_target")


def without_known_sources(candidates: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Candidates that no glossary row has as its source."""
    known = terms.select(T.word_key(F.col("source_term")).alias("k")).distinct()
    return candidates.withColumn("k", T.word_key(F.col(column))).join(known, "k", "left_anti").drop("k")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """DML01: on (source, target, direction) update category and priority, promote to approved only; else insert. Rejected rows are ignored."""
    good = incoming.where(P.term_problem(F.col("source_term"), F.col("target_term"), F.col("source_lang")).isNull())
    keys = ["k_source", "k_target", "source_lang", "target_lang"]
    old, new = existing.select("*", *key_of("source_term", "target_term")), good.select("*", *key_of("source_term", "target_term"))
    new = new.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("id").desc()))).where("r = 1").drop("r")
    change = new.select(*keys, F.col("category").alias("n_category"), F.col("priority").alias("n_priority"), F.col("status").alias("n_status"))
    kept = (
        old.join(change, keys, "left")
        .withColumn("op", F.when(F.col("n_status").isNotNull(), "update").otherwise("keep"))
        .withColumns({"category": F.coalesce("n_category", "category"), "priority": F.coalesce("n_priority", "priority"), "status": F.when(F.col("n_status") == "approved", "approved").otherwise(F.col("status"))})
    )
    added = new.join(old.select(*keys).distinct(), keys, "left_anti").withColumn("op", F.lit("insert"))
    columns = [*existing.columns, "op"]
    return kept.select(columns).unionByName(added.select(columns))


def set_status(terms: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """DML02: the rows' new status, with the change in history."""
    marked = terms.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return marked.withColumn("history", F.when(F.col("hit") & (F.col("status") != status), F.concat_ws(">", "status", F.lit(status)))).withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status"))).drop("hit")


def delete(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """DML04."""
    return terms.join(ids.select("id").distinct(), "id", "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """SNK02, DML03: op and changed columns of each row that differs between two snapshots."""
    columns = [c for c in before.columns if c != key]
    joined = before.withColumn("_in", F.lit(True)).alias("a").join(after.withColumn("_in", F.lit(True)).alias("b"), key, "full_outer")
    a, b = F.struct(*(F.col(f"a.{c}") for c in columns)), F.struct(*(F.col(f"b.{c}") for c in columns))
    there = {s: F.coalesce(F.col(f"{s}._in"), F.lit(False)) for s in "ab"}
    diff = F.filter(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns)), lambda c: c.isNotNull())
    op = F.when(~there["a"], "insert").when(~there["b"], "delete").when(~a.eqNullSafe(b), "update")
    return joined.select(key, op.alias("op"), F.when(op == "update", F.array_join(diff, ",")).alias("changed")).where("op is not null")


def forms(target: Column) -> Column:
    """PRJ07: surface forms of an approved target: itself and its slash alternatives."""
    return F.array_distinct(F.concat(F.array(F.trim(target)), F.filter(F.transform(F.split(target, "/"), lambda x: F.trim(x)), lambda x: x != "")))


def seeded(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """SRC15: existing, or the seeds where it has no row at all; one row of existing is read to tell."""
    one = F.lit(1).alias("_any")
    there = existing.limit(1).select(one)
    fresh = seeds.select(*existing.columns, one).join(F.broadcast(there), "_any", "left_anti").drop("_any")
    return existing.unionByName(fresh)


def reseeded(existing: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """DML08: the seeds, which take the place of existing, with ``replaced``: whether their key was there before."""
    return seeds.join(existing.select(key).distinct().withColumn("_old", F.lit(True)), key, "left").withColumn("replaced", F.coalesce("_old", F.lit(False))).drop("_old")
