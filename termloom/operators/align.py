"""Alignment of units on two language sides: steps, neighbours, blocks, intervals, greedy matching."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import predicates as P
from ..functions import text as T


def scopes(units: DataFrame, side: Column, model: Column) -> DataFrame:
    """Units (doc_id, line_no, text) with their scope: on each side the last model heading, numbered by occurrence, general before the first."""
    order = Window.partitionBy("doc_id", "side").orderBy("line_no")
    seen = Window.partitionBy("doc_id", "side", "model").orderBy("line_no")
    rows = units.withColumns({"side": side, "model": model})
    mark = F.when(F.col("model").isNotNull(), F.concat_ws("#", "model", F.count("*").over(seen).cast("string")))
    return rows.withColumn("mark", mark).withColumn("scope", F.coalesce(F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("general"))).drop("mark")


def step_pairs(units: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of both sides (column side: a or b) with equal step, where a step is unique on each side of its scope."""
    steps = units.withColumn("step", T.step_number(F.col("text"))).where(F.col("step").isNotNull() & ~P.is_fragment(F.col("text")))
    once = steps.groupBy(*keys, "side", "step").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).where("n = 1")
    a, b = (once.where(F.col("side") == s).select(*keys, "step", F.col("line_no").alias(f"{s}_line")) for s in "ab")
    return a.join(b, [*keys, "step"])


def adjacent_pairs(units: DataFrame) -> DataFrame:
    """Neighbouring units of different sides, each used once: runs of alternating sides are cut into twos."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = units.withColumn("joins", F.coalesce(F.lag("side").over(order) != F.col("side"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no"))).withColumns({"mate": F.lead("line_no").over(Window.partitionBy("doc_id", "run").orderBy("line_no"))})
    return rows.where("at % 2 = 1 and mate is not null").select("doc_id", F.col("line_no").alias("first"), F.col("mate").alias("second"))


def block_pairs(units: DataFrame) -> DataFrame:
    """Documents that are one block of side a, then one of side b of equal length: paired by position."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = units.withColumns({"change": F.when(F.lag("side").over(order) != F.col("side"), 1).otherwise(0)})
    rows = rows.withColumns({"at": F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("line_no"))})
    good = rows.groupBy("doc_id").agg(F.sum("change").alias("changes"), F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")).where("changes = 1 and na = nb").select("doc_id")
    rows = rows.join(good, "doc_id")
    a, b = (rows.where(F.col("side") == s).select("doc_id", "at", F.col("line_no").alias(f"{s}_line")) for s in "ab")
    return a.join(b, ["doc_id", "at"])


def left_over_pairs(units: DataFrame, keys: list[str]) -> DataFrame:
    """Scopes with exactly one unit on each side."""
    g = units.groupBy(*keys).agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"), F.min(F.when(F.col("side") == "a", F.col("line_no"))).alias("a_line"), F.min(F.when(F.col("side") == "b", F.col("line_no"))).alias("b_line"))
    return g.where("na = 1 and nb = 1").drop("na", "nb")


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Each point (pos) with the narrowest interval (start, end, name) that holds it.

    Whole-numbered intervals are parted into nodes of a binary tree, 2 for each doubling of their length at most; only the
    best interval of a node meets the points, each once for every level of the tree. Others are dealt into bins of
    ``width`` and all intervals of a bin meet its points.
    """
    one = intervals.where("start < end").groupBy(*keys, "start", "end").agg(F.min("name").alias("name"), F.bool_or(F.col("name").isNull()).alias("none"))
    one = one.withColumn("name", F.when(~F.col("none"), F.col("name"))).drop("none")
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("length"), "start", "name")).alias("x")
    if not all(isinstance(t.schema[c].dataType, IntegralType) for t, c in ((points, "pos"), (one, "start"), (one, "end"))):
        binned = one.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
        found = points.withColumn("bin", F.floor(F.col("pos") / width)).join(binned, [*keys, "bin"]).where("pos >= start and pos < end")
        return found.groupBy(*keys, "pos").agg(best).select(*keys, "pos", "x.name")
    longest = one.agg(F.max(F.col("end").cast("long") - F.col("start").cast("long"))).first()[0] or 1
    levels = lambda top: F.sequence(F.lit(0), top.cast("int"))
    rows = one.withColumn("level", F.explode(levels(F.floor(F.log2(F.col("end") - F.col("start"))) + 1)))
    first, last = F.expr("-shiftright(-cast(start as bigint), level)"), F.expr("shiftright(cast(end as bigint), level)")
    left, right = F.when(F.pmod(first, F.lit(2)) == 1, first), F.when(F.pmod(last, F.lit(2)) == 1, last - 1)
    rows = rows.where(first < last).withColumn("node", F.explode(F.array_compact(F.array(left, right))))
    nodes = rows.groupBy(*keys, "level", "node").agg(best)
    found = points.select(*keys, "pos").distinct().withColumn("level", F.explode(levels(F.lit(longest.bit_length())))).withColumn("node", F.expr("shiftright(cast(pos as bigint), level)"))
    return found.join(nodes, [*keys, "level", "node"]).groupBy(*keys, "pos").agg(F.min("x").alias("x")).select(*keys, "pos", "x.name")


def greedy_matching(scored: DataFrame, key: str, least: float) -> DataFrame:
    """Per key, pairs (a, b, score) of at least ``least`` by falling score, each side once (ties: a, then b).

    A key is one deck: its scored pairs are bounded by its slides squared.
    """

    def match(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], r["a"], r["b"]))
        left, right, kept = set(), set(), []
        for r in rows:
            if r["a"] not in left and r["b"] not in right:
                left.add(r["a"])
                right.add(r["b"])
                kept.append(r)
        return pa.Table.from_pylist(kept, table.schema)

    rows = scored.where(F.col("score") >= least).select(key, "a", "b", "score")
    return rows.groupBy(key).applyInArrow(match, rows.schema)


def overlay(rows: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """Edits (id, text_key, edited) laid over rows, by id, else by the text's exact key."""
    by_id = edits.where("id is not null").groupBy(F.col("id").alias(key)).agg(F.max("edited").alias("by_id"))
    by_text = edits.where("id is null and text_key is not null").groupBy("text_key").agg(F.max("edited").alias("by_text"))
    out = rows.withColumn("text_key", T.exact_key(F.col(text))).join(by_id, key, "left").join(by_text, "text_key", "left")
    return out.withColumns({"final": F.coalesce("by_id", "by_text", text), "edited": F.col("by_id").isNotNull() | F.col("by_text").isNotNull()}).drop("by_id", "by_text", "text_key")


def stitched(units: DataFrame, longest: int = 60) -> DataFrame:
    """Short neighbours joined into one candidate text."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = units.withColumns({"next_text": F.lead("text").over(order), "next_side": F.lead("side").over(order)})
    return rows.where((F.col("next_side") == F.col("side")) & (F.length("text") <= longest) & (F.length("next_text") <= longest)).select("doc_id", "line_no", F.concat_ws(" ", F.trim("text"), F.trim("next_text")).alias("joined"))


def slide_range(expression: Column, last: Column) -> Column:
    """FIL29: the numbers of an expression such as "1-5, 8", in order, within 1 and last."""
    parts = F.filter(F.split(F.regexp_replace(expression, r"\s*-\s*", "-"), r"[,;\s]+"), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    bound = lambda p, i: F.get(F.split(p, "-"), i).cast("int")

    def numbers(p: Column) -> Column:
        a, b = bound(p, F.lit(0)), F.coalesce(bound(p, F.lit(1)), bound(p, F.lit(0)))
        low, high = F.greatest(F.lit(1), F.least(a, b)), F.least(last, F.greatest(a, b))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def matched_terms(texts: DataFrame, glossary: list[dict], key: str, text: str) -> DataFrame:
    """(key, start, end, term, found): longest term first, no overlaps, whole words, plural s or es for ASCII endings.

    glossary: rows with term, priority and is_direct; a document's glossary is a parameter of bounded size.
    """
    import re

    order = sorted(glossary, key=lambda g: (-len(g["term"]), not g.get("is_direct", True), -g.get("priority", 1), g["term"]))
    order = [g for g in order if len(g["term"].strip()) >= 2 and not g["term"].strip().isdigit()]

    def compiled():
        out = []
        for g in order:
            raw = g["term"].strip()
            body = r"\s+".join(map(re.escape, raw.split()))
            plural = "(?:es|s)?" if raw[-1].isascii() and raw[-1].isalpha() else ""
            out.append((g["term"], " ".join(raw.lower().split()), re.compile(rf"(?<![^\W_])({body}{plural})(?![^\W_])", re.IGNORECASE)))
        return out

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                low, taken = " ".join(t.lower().split()), []
                for term, plain, regex in patterns:
                    if plain not in low:
                        continue
                    for m in regex.finditer(t):
                        s, e = m.span(1)
                        if all(e <= a or b <= s for a, b, *_ in taken):
                            taken.append((s, e, term, m[1]))
                out += [{"key": k, "start": s, "end": e, "term": x, "found": f} for s, e, x, f in sorted(taken)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("found", pa.string())]))

    rows = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(match, "key long, start long, end long, term string, found string")


def anchored_pairs(units: DataFrame, pairs: DataFrame, slide: list[str], gaps: bool = False) -> DataFrame:
    """(slide, a, b) of left-over units in containers that share a pair.

    units: slide, id, container, at (order on the slide), foreign (is it of the source language), eligible (may it be paired
    here); pairs: slide, a, b that are there. Containers are taken two by two in the order of their first units: if a pair
    ties them and they have as many left-overs, these are tied one by one, where their languages differ, and are gone for the
    containers after. gaps: where the numbers differ, the longest chain of pairs that rises in both containers parts their
    left-overs, and parts with equal numbers are tied. A slide is one group; its units are bounded by what a slide holds.
    """

    def chain(ties: list[tuple[int, int]]) -> list[tuple[int, int]]:
        ends: list[tuple[int, int]] = []  # (b, place in back) of the best chain of each length
        back: list[tuple[tuple[int, int], int]] = []
        for a, b in sorted(ties, key=lambda t: (t[0], -t[1])):
            k = bisect_left(ends, (b, -1))
            back.append(((a, b), ends[k - 1][1] if k else -1))
            ends[k : k + 1] = [(b, len(back) - 1)]
        out, i = [], ends[-1][1] if ends else -1
        while i >= 0:
            out.append(back[i][0])
            i = back[i][1]
        return out[::-1]

    def match(key, mine: pa.Table, there: pa.Table) -> pa.Table:
        rows = sorted(mine.to_pylist(), key=lambda r: (r["at"], r["id"]))
        of: dict = {}
        for r in rows:
            of.setdefault(r["container"], []).append(r)
        partner: dict = {}
        for p in there.to_pylist():
            partner.setdefault(p["a"], p["b"])
            partner.setdefault(p["b"], p["a"])
        found = []

        def tie(x: list, y: list) -> None:
            if len(x) == len(y):
                for p, q in zip(x, y):
                    if p["foreign"] != q["foreign"]:
                        a, b = (p, q) if p["foreign"] else (q, p)
                        found.append((*(v.as_py() for v in key), a["id"], b["id"]))
                        partner[a["id"]], partner[b["id"]] = b["id"], a["id"]

        names = list(of)
        for i, one in enumerate(names):
            for other in names[i + 1 :]:
                places = {r["id"]: k for k, r in enumerate(of[other])}
                ties = [(k, places[partner[r["id"]]]) for k, r in enumerate(of[one]) if partner.get(r["id"]) in places]
                if not ties:
                    continue
                free = [[r for r in of[c] if r["eligible"] and r["id"] not in partner] for c in (one, other)]
                if len(free[0]) == len(free[1]) or not gaps:
                    tie(*free)
                    continue
                borders = [(-1, -1), *chain(ties), (len(of[one]), len(of[other]))]
                for (a0, b0), (a1, b1) in zip(borders, borders[1:]):
                    tie(*([r for r in of[c][lo + 1 : hi] if r["eligible"] and r["id"] not in partner] for c, lo, hi in ((one, a0, a1), (other, b0, b1))))
        names = [*slide, "a", "b"]
        return pa.Table.from_pylist([dict(zip(names, f)) for f in found], pa.schema([pa.field(n, t) for n, t in zip(names, [*(k.type for k in key), mine.schema.field("id").type, mine.schema.field("id").type])]))

    id_type = units.schema["id"].dataType.simpleString()
    schema = ", ".join([*(f"{c} {units.schema[c].dataType.simpleString()}" for c in slide), f"a {id_type}", f"b {id_type}"])
    mine = units.select(*slide, "id", "container", "at", "foreign", "eligible")
    return mine.groupBy(*slide).cogroup(pairs.select(*slide, "a", "b").groupBy(*slide)).applyInArrow(match, schema)


def mediated_pairs(units: DataFrame, known: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, a, b): sources with the targets that memory gives them.

    units: scope, id, at, text, side ('source', 'target', or else not in play); known: q_text, origin, target, confidence, exact,
    words (matches of a source's compact form). Of a source's matches the preferred one counts unless others conflict with it
    (W11). Sources that want the same target text take those that have it in order, so the assignment needs no rounds: the
    k-th source gets the k-th target of a compact form."""
    from .memory import choose

    wanted = choose(known.withColumn("q", T.compact(F.col("q_text")))).where("not conflict").select("q", T.compact(F.col("target")).alias("form"))
    form = T.compact(F.col("text"))
    nth = F.row_number().over(Window.partitionBy(*scope, "form").orderBy("at", "id"))
    sources = units.where("side = 'source'").withColumn("q", form).join(wanted, "q").where("form <> ''").select(*scope, "form", F.col("id").alias("a"), nth.alias("k"))
    targets = units.where("side = 'target'").withColumn("form", form).select(*scope, "form", F.col("id").alias("b"), nth.alias("k"))
    return sources.join(targets, [*scope, "form", "k"]).select(*scope, "a", "b")


def stitched_pairs(units: DataFrame, known: DataFrame, scope: list[str], longest: int = 60) -> DataFrame:
    """(scope, a, a2, b, joined): neighbours that together are what memory knows, with their one partner.

    units: scope, id, at, text, side ('source', 'target', or else), paired; known: as in ``mediated_pairs``. Two sources that
    follow one another, each of at most ``longest`` characters, without different step numbers and not both paired, are joined
    without their steps; the partner is the first unit of the scope that is no source, has no other step than the first, and
    whose compact form is that of the preferred match, or holds it, or is held by it. Scopes are containers of a slide."""
    from .memory import choose

    order = Window.partitionBy(*scope).orderBy("at", "id")
    after = {f"_{c}": F.lead(c).over(order) for c in ("id", "text", "side", "paired")}
    rows = units.withColumns(after)
    one, two = (F.coalesce(T.step_number(F.col(c)), F.lit("")) for c in ("text", "_text"))
    fits = (F.col("side") == "source") & (F.col("_side") == "source") & ~(F.col("paired") & F.col("_paired")) & (F.length(F.trim("text")) <= longest) & (F.length(F.trim("_text")) <= longest)
    rows = rows.where(fits & ~((one != "") & (two != "") & (one != two))).select(*scope, F.col("id").alias("a"), F.col("_id").alias("a2"), one.alias("step"), F.trim(F.concat_ws(" ", T.without_step(F.col("text")), T.without_step(F.col("_text")))).alias("joined"))
    wanted = choose(known.withColumn("q", T.compact(F.col("q_text")))).where("not conflict").select("q", T.compact(F.col("target")).alias("form")).where("form <> ''")
    rows = rows.withColumn("q", T.compact(F.col("joined"))).join(wanted, "q")
    others = units.where("side <> 'source'").select(*scope, F.col("id").alias("b"), "at", F.coalesce(T.step_number(F.col("text")), F.lit("")).alias("other"), T.compact(F.col("text")).alias("c")).where("c <> ''")
    met = rows.join(others, scope).where((F.col("step") == "") | (F.col("other") == "") | (F.col("step") == F.col("other")))
    met = met.where(F.col("c").contains(F.col("form")) | F.col("form").contains(F.col("c")))
    return met.groupBy(*scope, "a", "a2", "joined").agg(F.min_by("b", F.struct("at", "b")).alias("b")).select(*scope, "a", "a2", "b", "joined")


def inherited_pairs(units: DataFrame, pairs: DataFrame, fits: Column, scope: list[str], longest: int = 60) -> DataFrame:
    """(scope, a, b): an unpaired source takes its paired neighbour's partner if both together fit it.

    pairs: scope, a, b, target (b's text); fits: a Column over ``joined`` and ``target``. In order: what a unit takes, the next may take of it."""
    order = Window.partitionBy(*scope).orderBy("at", "id")
    rows = units.join(pairs.select(*scope, F.col("a").alias("id"), "b", "target"), [*scope, "id"], "left")
    rows = rows.withColumns({f"_{c}": F.lead(c).over(order) for c in ("id", "text", "side", "b", "target")} | {"_n": F.row_number().over(order)})
    one, two = (F.coalesce(T.step_number(F.col(c)), F.lit("")) for c in ("text", "_text"))
    near = (F.col("side") == "source") & (F.col("_side") == "source") & (F.length(F.trim("text")) <= longest) & (F.length(F.trim("_text")) <= longest) & ~((one != "") & (two != "") & (one != two))
    joined = F.trim(F.concat_ws(" ", T.without_step(F.col("text")), T.without_step(F.col("_text"))))
    forward = rows.where(near & F.col("b").isNotNull() & F.col("_b").isNull()).select(*scope, F.col("_id").alias("a"), "b", "target", joined.alias("joined"), F.lit(0).alias("_first"))
    back = rows.where(near & F.col("b").isNull() & F.col("_b").isNotNull()).select(*scope, F.col("id").alias("a"), F.col("_b").alias("b"), F.col("_target").alias("target"), joined.alias("joined"), F.lit(1).alias("_first"))
    return forward.unionByName(back).where(fits).groupBy(*scope, "a").agg(F.min_by("b", F.struct("_first", "b")).alias("b"))
