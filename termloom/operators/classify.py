"""Status of text units by a decision ladder: what is not to be translated, what is translated already, what memory knows, what is left.

The ladder's rungs are data (condition, status, confidence): the first that holds decides. Glossary and memory
are joined by the MD5 of keys, one row for each key, so a unit keeps one row and texts stay out of the joins unless
they are asked for; a key that many units share is split by adaptive execution as any skewed equi-join.

Edge cases: null texts are empty, and so not translatable; repeated units each get a row; empty glossaries and
memories match nothing; columns of the units are kept, but for those named status, confidence, rung, suggestion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import predicates as P
from ..functions import text as T

RESULT = ["status", "confidence", "rung", "suggestion"]


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _lookup(pairs: DataFrame, key, name: str) -> DataFrame:
    """(key, target, n): one target for each key's digest, the first in order, and the number of its pairs."""
    return pairs.where(F.trim(F.coalesce("source", F.lit(""))) != "").groupBy(_digest(key(F.col("source"))).alias(f"_{name}_key")).agg(F.min(F.coalesce("target", F.lit(""))).alias(f"_{name}"), F.count("*").alias(f"_{name}_n"))


def _joined(rows: DataFrame, pairs: DataFrame | None, name: str) -> DataFrame:
    """rows with _name: the target by exact key, else by canonical key; null without one; and _name_known: whether there is one, which needs no targets."""
    if pairs is None:
        return rows.withColumns({f"_{name}": F.lit(None).cast("string"), f"_{name}_known": F.lit(False)})
    exact, canonical = _lookup(pairs, T.exact_key, f"{name}_e"), _lookup(pairs, T.canonical_key, f"{name}_c")
    rows = rows.join(exact, rows["_exact"] == exact[f"_{name}_e_key"], "left").join(canonical, rows["_canonical"] == canonical[f"_{name}_c_key"], "left")
    found = {f"_{name}": F.coalesce(f"_{name}_e", f"_{name}_c"), f"_{name}_known": F.col(f"_{name}_e_n").isNotNull() | F.col(f"_{name}_c_n").isNotNull()}
    return rows.withColumns(found).drop(*(f"_{name}_{k}{c}" for k in "ec" for c in ("", "_key", "_n")))


FACTS = ["label", "code", "marks", "vietnamese", "english", "hints", "bilingual"]


def _with_facts(rows: DataFrame) -> DataFrame:
    """rows with what their texts alone tell, as ``_facts``: dealt over all cores, however few files they come from, and told in one pass;
    bilingual is told for texts that are neither labels nor codes nor English."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(parts).withColumn("_t", L.bare(F.coalesce("text", F.lit(""))))
    t = F.col("_t")
    told = dealt.withColumn("_e", L.evidence_of_rows(t)).withColumns({"_label": P.is_label(t), "_code": L.is_code(t), "_vietnamese": L.vietnamese_by(F.col("_e")), "_english": L.english_by(F.col("_e"))})
    told = told.withColumn("_bilingual", F.when(F.col("_label") | F.col("_code") | F.col("_english"), False).otherwise(L.is_bilingual(t)))
    facts = F.struct(*(F.col(f"_e.{c}" if c in ("marks", "hints") else f"_{c}").alias(c) for c in FACTS))
    return told.select(*rows.columns, facts.alias("_facts"))


def _rungs(t: Column, source: str, target: str) -> list[tuple[str, Column, str, float]]:
    """(name, condition, status, confidence), in order."""
    label, code, marks, vietnamese, english, _, bilingual = (F.col(f"_facts.{c}") for c in FACTS)
    existing = L.bare(F.coalesce("_existing", F.lit("")))
    rungs = [
        ("label", label, "NON_TRANSLATABLE", 1.0),
        ("code", code, "NON_TRANSLATABLE", 1.0),
        ("immune", (~vietnamese & english) if source == "vi" else F.lit(False), "ALREADY_TRANSLATED", 1.0),
        ("bilingual item", F.col("_item") & bilingual, "ALREADY_TRANSLATED", 0.98),
        ("bilingual container", F.col("_container_bilingual"), "ALREADY_TRANSLATED", 0.95),
        ("existing translation", (existing != "") & (F.lower(existing) != F.lower(t)), "ALREADY_TRANSLATED", 0.95),
        ("bilingual text", bilingual, "MIXED_LANGUAGE", 0.92),
        ("glossary", F.col("_glossary_known"), "LOCKED_TERMINOLOGY", 1.0),
        ("memory", F.col("_memory_known"), "TM_REUSE", 0.95),
    ]
    if (source, target) == ("vi", "en"):
        rungs += [("source language", vietnamese, "NEEDS_TRANSLATION", 0.95), ("paired line", english & F.col("_container_vi"), "ALREADY_TRANSLATED", 0.95), ("target language", english, "ALREADY_TRANSLATED", 0.9)]
    if (source, target) == ("en", "vi"):
        rungs += [("target language", marks, "ALREADY_TRANSLATED", 0.95), ("paired line", english & F.col("_container_vi"), "ALREADY_TRANSLATED", 0.95), ("source language", english, "NEEDS_TRANSLATION", 0.95)]
    return rungs


def _classified(units: DataFrame, memory: DataFrame | None, glossary: DataFrame | None, source: str, target: str) -> DataFrame:
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in units.columns else F.lit(default)
    rows = _with_facts(units).withColumns({"_item": has("is_item", False), "_container_bilingual": has("container_bilingual", False), "_container_vi": has("container_vi", False), "_existing": has("existing", ""), "_exact": _digest(T.exact_key(F.col("text"))), "_canonical": _digest(T.canonical_key(F.col("text")))})
    rows = _joined(_joined(rows, glossary, "glossary"), memory, "memory")
    t = L.bare(F.coalesce("text", F.lit("")))
    out = F.struct(F.lit("REVIEW_REQUIRED").alias("status"), F.lit(0.6).alias("confidence"), F.lit("ambiguous").alias("rung"))
    for name, holds, status, confidence in reversed(_rungs(t, source, target)):
        out = F.when(holds, F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), F.lit(name).alias("rung"))).otherwise(out)
    rows = rows.withColumn("_d", out)
    suggestion = F.when(F.col("_d.rung") == "glossary", F.col("_glossary")).when(F.col("_d.rung") == "memory", F.col("_memory")).when((F.col("_d.rung") == "existing translation"), F.col("_existing"))
    return rows.select(*(c for c in units.columns if c not in RESULT), *(F.col(f"_d.{c}").alias(c) for c in RESULT[:3]), suggestion.alias("suggestion"), "_facts")


def classified(units: DataFrame, memory: DataFrame | None = None, glossary: DataFrame | None = None, source: str = "vi", target: str = "en") -> DataFrame:
    """PRJ01: units (text; optional existing, is_item, container_bilingual, container_vi) with status, confidence, rung and suggestion.

    memory and glossary: (source, target) pairs; approved examples belong to the glossary.
    """
    return _classified(units, memory, glossary, source, target).drop("_facts")


def with_container(units: DataFrame, key: str) -> DataFrame:
    """units with container_vi: whether a text of the same container (column key) has Vietnamese letters."""
    flags = units.groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.coalesce(P.has_marks(F.col("text")), F.lit(False))).alias("container_vi"))
    return units.join(flags, units[key].eqNullSafe(flags["_key"]), "left").drop("_key")


def presentation(units: DataFrame, pairs: DataFrame, memory: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """PRJ02, from Vietnamese to English: PRJ01 with what only a presentation knows.

    units: unit_id, text, container (null: none), reference (on a slide kept as the Vietnamese reference of a pair),
    to_duplicate (on a slide that is written again in English); pairs: unit_id, existing. Before PRJ01's status stand:
    reference slides, labels and codes, lines of parameters in a Vietnamese container, English, and pairs; a
    pair on a slide to duplicate is translated all the same; conditions and headings that name a model are locked.
    """
    found = units.join(pairs.groupBy("unit_id").agg(F.min("existing").alias("existing")), "unit_id", "left")
    found = with_container(found, "container")
    base = _classified(found, memory, glossary, "vi", "en")
    t = L.bare(F.coalesce("text", F.lit("")))
    # fixed values: patterns of size and parameter lines, of conditions that name a model, and of model headings
    size = r"(?i)^[-–—*•#]?\s*size\s*#?[\d.,\-]+"
    parameter = r"(?i)^[-–—*•#]?\s*#?\d+(?:[.,]\d+)?(?:\s*[-–—/]\s*#?\d+(?:[.,]\d+)?)?\s*[:：]?\s*[\d.,\-+±~]+\s*(?:kg/cm²|kg|g|cm|mm|℃|°c|sec|s|min|bar|psi|spi|%|m/s|v|w|a)?$"
    condition, heading = r"(?iu)^(\s*\*?\s*)(?:đối\s*với|áp\s*dụng\s*cho|dành\s*cho)\s+(.+)$", r"(?iu)^(\s*\*?\s*)(?:model|mẫu)\s*[:：\-]\s*(.+)$"

    label, code, _, vietnamese, english, hints, bilingual = (F.col(f"_facts.{c}") for c in FACTS)
    source = vietnamese | hints
    named = lambda p: (x := L.bare(F.regexp_extract(t, p, 2)), (x != "") & ~P.has_marks(x) & (L.is_model_name(x) | x.rlike(r"(?i)^[A-Z0-9\-/.\s()'\"#:,]+$")))
    (model, is_condition), (title, is_heading) = named(condition), named(heading)
    star = lambda p, word: F.concat(F.when(F.regexp_extract(t, p, 1).contains("*"), f"*{word}").otherwise(word), F.lit(" "))
    paired = F.col("existing").isNotNull()
    keep, duplicate = F.lit(None).cast("string"), F.coalesce("to_duplicate", F.lit(False)) & source
    rungs = [
        (F.coalesce("reference", F.lit(False)), "ALREADY_TRANSLATED", "reference slide", keep),
        (label | code, "NON_TRANSLATABLE", "code", keep),
        (F.col("container").isNotNull() & F.col("container_vi") & (t.rlike(size) | t.rlike(parameter)), "TM_REUSE", "parameter line", F.col("text")),
        (~source & english, "ALREADY_TRANSLATED", "english", keep),
        (paired & ~duplicate, "ALREADY_TRANSLATED", "paired", keep),
        (paired & duplicate, "TM_REUSE", "pair to duplicate", F.col("existing")),
        (~source, "ALREADY_TRANSLATED", "no evidence of the source", keep),
        (bilingual & ~duplicate, "ALREADY_TRANSLATED", "bilingual text", keep),
        (is_condition, "LOCKED_TERMINOLOGY", "model condition", F.concat(star(condition, "For"), model)),
        (is_heading, "LOCKED_TERMINOLOGY", "model heading", F.concat(star(heading, "Model:"), title)),
        (F.col("status").isin("LOCKED_TERMINOLOGY", "TM_REUSE"), F.col("status"), F.col("rung"), F.col("suggestion")),
    ]
    out = F.struct(F.lit("NEEDS_TRANSLATION").alias("status"), F.lit("source language").alias("rung"), F.lit(None).cast("string").alias("suggestion"))
    for holds, status, rung, suggestion in reversed(rungs):
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        out = F.when(holds, F.struct(text(status).alias("status"), text(rung).alias("rung"), suggestion.alias("suggestion"))).otherwise(out)
    done = base.withColumn("_d", out)
    return done.select(*(c for c in base.columns if c not in (*RESULT, "_facts")), *(F.col(f"_d.{c}").alias(c) for c in ("status", "rung", "suggestion"))).withColumn("requires_translation", ~F.col("status").isin("ALREADY_TRANSLATED", "NON_TRANSLATABLE"))


def routed(units: DataFrame, memory: DataFrame | None, pairs: DataFrame, direction: str = "vi") -> DataFrame:
    """PRJ03: how each unit (unit_id, text) gets its translation: label, pair, immune, model condition, model heading, memory, text without its colon in memory, or queue."""
    rows = units.join(pairs.groupBy("unit_id").agg(F.min("existing").alias("_existing")), "unit_id", "left")
    rows = rows.withColumns({"_exact": _digest(T.exact_key(F.col("text"))), "_canonical": _digest(T.canonical_key(F.col("text"))), "_plain": _digest(T.exact_key(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s*[:：]\s*$", "")))})
    rows = _joined(rows, memory, "memory")
    uncoloned = _lookup(memory, T.exact_key, "plain").withColumnRenamed("_plain", "_plain_target") if memory is not None else None
    rows = rows.join(uncoloned, rows["_plain"] == uncoloned["_plain_key"], "left").drop("_plain_key") if uncoloned is not None else rows.withColumn("_plain_target", F.lit(None).cast("string"))
    t = L.bare(F.coalesce("text", F.lit("")))
    condition = t.rlike(r"(?iu)^\s*\*?\s*(?:đối\s*với|áp\s*dụng\s*cho|dành\s*cho)\s+[A-Z0-9\-/.\s()#:,]+$")
    heading = t.rlike(r"(?iu)^\s*\*?\s*(?:model|mẫu)\s*[:：\-]\s*[A-Z0-9\-/.\s()#:,]+$")
    route = (
        F.when(P.is_label(t), "label").when(F.col("_existing").isNotNull(), "pair").when(condition, "model condition").when(heading, "model heading").when(L.is_immune(t, direction), "immune")
        .when(F.col("_memory").isNotNull(), "memory").when(F.col("_plain_target").isNotNull(), "memory without colon").otherwise("queue")
    )
    target = F.when(route == "pair", F.col("_existing")).when(route == "memory", F.col("_memory")).when(route == "memory without colon", F.concat("_plain_target", F.lit(":"))).when(route.isin("label", "immune"), F.col("text"))
    return rows.select(*units.columns, route.alias("route"), target.alias("target"))
