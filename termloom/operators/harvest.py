"""Terms that the glossary lacks, found in decks and documents, with suggested targets.

The glossary, the map of domain terms and the dictionary are tables. Domain terms meet the units by containment, so their
number is bounded; the glossary and the dictionary meet candidates by keys. What is kept of a slide or document is chosen
by aggregates and ranks that Spark limits before it shuffles.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions import language as L
from ..functions import predicates as P
from ..functions import terms
from ..functions import text as T
from ..functions.vocabulary import ACRONYMS
from ..session import cut
from .rules import _few

# fixed values: headings, headers of criteria, parts of shapes, pairs of a line, categories
HEADING = r"^\*\s*([^:\n\r]+)(?::|$)"
CRITERION = r"(?iu)^(?:hình\s*dạng|độ\s*bo|độ\s*sâu|chất\s*lượng|khoảng\s*cách|mức\s*độ|tiêu\s*chuẩn)(?![A-Za-z0-9_])"
SHAPE = r"(?iu)^(?:hình\s*dạng|độ\s*bo)\s+(.+)$"
SHAPES = [("mũi", "Tip / Toe"), ("gót", "Heel"), (r"vòng\s*cổ", "Collar"), ("lưỡi", "Tongue")]
PAIR = r"^([A-Za-zÀ-ỹ0-9\s/\-]{2,40})\s*[:\-=–—]\s*([A-Za-zÀ-ỹ0-9\s/\-]{2,50})$"
PROCESS, DEFECT, GENERAL = "Quy trình (Process)", "Lỗi chất lượng (CTQ Defect)", "Thuật ngữ chung (General)"
MOST_FED = 100
MARKS, BEGIN, END = T.VIETNAMESE, P.B, P.E


#: Tip-quarter's forms in ASCII, and what they become.
SPACED = [
    (BEGIN + "Tipquarter" + END, "Tip-quarter"), (BEGIN + "tipquarter" + END, "tip-quarter"), (BEGIN + "TIPQUARTER" + END, "TIP-QUARTER"),
    (BEGIN + r"T(?i:ip\s+quarter)" + END, "Tip-quarter"), (BEGIN + r"t(?i:ip\s+quarter)" + END, "tip-quarter"),
]


def spaced(term: Column) -> Column:
    """Tip-quarter with its hyphen, in the case that it has."""
    for pattern, to in SPACED:
        term = F.regexp_replace(term, pattern, to)
    return term


def one_target(table: DataFrame, key: str, target: str, order: str) -> DataFrame:
    """(k, t): the first target of each key."""
    return table.groupBy(T.word_key(F.col(key)).alias("k")).agg(F.min_by(target, F.struct(order, target)).alias("t"))


def suggested(candidates: DataFrame, term: str, current: str, glossary: DataFrame, domain: DataFrame, dictionary: DataFrame) -> DataFrame:
    """candidates with ``options``: up to three targets, the recommended one first.

    The first source that has the term counts: the glossary (id, source_term, target_term), the domain's map (term, category,
    options), the dictionary (position, en, vi), the order of "shape of a part", the translation at hand. Options that have
    Vietnamese letters, repeat the source or another option, or are shorter than two letters go."""
    k = T.word_key(F.col(term))
    rows = candidates.withColumn("_k", k)
    known = one_target(glossary.where("target_term is not null"), "source_term", "target_term", "id").select(F.col("k").alias("_k"), F.col("t").alias("_g"))
    map_ = domain.select(T.word_key(F.col("term")).alias("_k"), F.col("options").alias("_d")).dropDuplicates(["_k"])
    words = one_target(dictionary, "vi", "en", "position").select(F.col("k").alias("_k"), F.col("t").alias("_w"))
    rows = rows.join(known, "_k", "left").join(_few(map_), "_k", "left").join(words, "_k", "left")
    now = F.coalesce(F.trim(F.col(current)), F.lit(""))

    def of_known(target: Column) -> Column:
        best = L.cased(terms.clean_target(target), F.lit(True))
        return F.array(best, F.when((now != "") & (now != best), now).otherwise(F.concat(best, F.lit(" (Process Variant)"))), F.concat(F.lit("Standard "), best))

    part = F.regexp_extract(F.col(term), SHAPE, 1)
    named = F.lit("Component")
    for pattern, english in reversed(SHAPES):
        named = F.when(part.rlike(f"(?iu){pattern}"), english).otherwise(named)
    shape = F.array(*(F.concat(named, F.lit(x)) for x in (" shape", " contour / profile", " symmetry")))
    primary = F.when(now != "", terms.stitch_density(now)).otherwise(L.cased(F.col(term), F.lit(True)))
    fallback = F.array(primary, F.concat(primary, F.lit(" standard")), F.concat(primary, F.lit(" specification")))
    raw = F.when(F.coalesce(terms.clean_target(F.col("_g")), F.lit("")) != "", of_known(F.col("_g"))).when(F.col("_d").isNotNull(), F.slice("_d", 1, 3)).when(F.col("_w").isNotNull(), of_known(F.col("_w"))).when(part != "", shape).otherwise(fallback)
    clean = F.filter(F.transform(raw, lambda o: F.trim(terms.clean_target(o))), lambda o: (F.length(o) >= 2) & (T.word_key(o) != F.col("_k")) & ~P.has_marks(o))
    # each option with its key, told once
    keyed = F.transform(clean, lambda o: F.struct(o.alias("o"), T.word_key(o).alias("k")))
    kept = T.let(keyed, lambda x: F.transform(F.filter(x, lambda o, i: F.array_position(x["k"], o["k"]) == i + 1), lambda o: o["o"]))
    return rows.withColumn("options", kept).drop("_k", "_g", "_d", "_w")


def unmapped(units: DataFrame, glossary: DataFrame, domain: DataFrame, dictionary: DataFrame, slide: list[str]) -> DataFrame:
    """(slide, term, key, pattern, category, at, current, snippet, options): terms of a slide that the glossary lacks, each once.

    units: slide, at, text, target, is_item. Three patterns, in this order within a unit: headings after '*', clauses of criteria
    and inspection items, and terms of the domain's map (position, term, category, options) anywhere in the text."""
    text, target = F.trim("text"), F.trim(F.coalesce("target", F.lit("")))
    rows = units.where(F.length(text) >= 3)
    domain_keys = _few(domain.select(T.word_key(F.col("term")).alias("key"), F.lit(True).alias("_mapped")).distinct())
    vietnamese = lambda t: P.is_special_term(t) & (P.has_marks(t) | F.coalesce("_mapped", F.lit(False)))
    first = lambda t: F.trim(F.split(t, r"[:\-–\n]")[0])
    said = F.trim(F.regexp_extract(target, HEADING, 1))
    columns = [*slide, "at", F.col("text"), F.lit(0).alias("position")]
    heads = rows.where(text.startswith("*")).select(*columns, F.trim(F.regexp_extract(text, HEADING, 1)).alias("term"), F.when(said != "", said).otherwise(F.substring(target, 1, 40)).alias("now"), F.lit("heading").alias("pattern"), F.lit(0).alias("rank"), F.lit(PROCESS).alias("category"))
    items = rows.where(F.coalesce("is_item", F.lit(False)) | text.rlike(CRITERION)).select(*columns, first(text).alias("term"), first(target).alias("now"), F.lit("criterion").alias("pattern"), F.lit(1).alias("rank"), F.lit(DEFECT).alias("category"))
    own = heads.unionByName(items).withColumn("key", T.word_key(F.col("term"))).join(domain_keys, "key", "left")
    own = own.where(vietnamese(F.col("term")) & (F.length("key") >= 3) & ((F.col("rank") == 0) | (F.size(F.split("key", " ")) <= 4))).drop("_mapped")
    mapped = rows.join(_few(domain.select("position", F.lower("term").alias("low"), "category", "options")), F.expr("contains(lower(text), low)"))
    mapped = mapped.select(*slide, "at", "text", "position", L.cased(F.col("low"), F.lit(True)).alias("term"), F.col("options")[0].alias("now"), F.lit("domain").alias("pattern"), F.lit(2).alias("rank"), "category").withColumn("key", T.word_key(F.col("term")))
    every = own.unionByName(mapped).join(glossary.select(T.word_key(F.col("source_term")).alias("key")).distinct(), "key", "left_anti")
    names = ["at", "rank", "position", "term", "now", "pattern", "category", "text"]
    one = every.groupBy(*slide, "key").agg(F.min(F.struct(*names)).alias("x")).select(*slide, "key", *(F.col(f"x.{n}").alias(n) for n in names))
    out = suggested(one, "term", "now", glossary, domain, dictionary).where(F.size("options") > 0)
    valid = (F.col("now") != "") & (T.word_key(F.col("now")) != F.col("key")) & ~P.has_marks(F.col("now"))
    whole = F.trim("text")
    snippet = F.when(F.length(whole) > 100, F.concat(F.substring(whole, 1, 97), F.lit("..."))).otherwise(whole)
    return out.select(*slide, "term", "key", "pattern", "category", "at", F.when((F.col("pattern") == "domain") | valid, F.col("now")).otherwise(F.col("options")[0]).alias("current"), snippet.alias("snippet"), "options")


def fed(lines: DataFrame, glossary: DataFrame, domain: DataFrame, dictionary: DataFrame, source: str = "vi", most: int = MOST_FED, keys: int = 1 << 18) -> DataFrame:
    """(doc_id, n, term, target, page, line_no, kind): the first ``most`` candidates of each document that the glossary lacks.

    lines: doc_id, page, line_no, text. Pairs of a line ("A : B") come first, then phrases of four to one words of lines of 5 to 250
    characters, in the order of the text; each key once, and phrases only where a target can be suggested.

    Up to ``keys`` keys of the tables are shipped, with the targets they suggest; then the lines of a document are read in their order,
    and no phrase is told behind the ``most``-th candidate. Beyond, all is joined: phrases of the first ``most`` words of a document
    (its first line at least) are told first, and later ones only for documents that have fewer than ``most`` candidates by then."""
    text = F.when(F.lower("text").contains("quarter"), spaced(F.col("text"))).otherwise(F.col("text"))
    rows = lines.select("doc_id", "page", "line_no", F.trim(text).alias("text")).where("text <> ''")
    named = _answers(glossary, domain, dictionary)
    known = glossary.select(F.trim(F.lower("source_term")).alias("key")).where(F.length("key").between(2, 80)).distinct()
    known, named = (x.limit(keys + 1).toArrow() for x in (known, named))
    if max(known.num_rows, named.num_rows) <= keys:
        return _read(rows, set(known.column("key").to_pylist()), dict(zip(named.column("key").to_pylist(), named.column("target").to_pylist())), source, most)
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    words = F.sum(F.size(F.split("text", r"\s+"))).over(order)
    rows = cut(rows.withColumn("head", (words <= most) | (F.rank().over(order) == 1)))
    first = cut(_fed(rows, F.col("head"), glossary, domain, dictionary, source, most))
    full = first.where(F.col("n") == most).select("doc_id")
    rest = cut(rows.where(~F.col("head")).select("doc_id").distinct().join(full.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").withColumnRenamed("doc_id", "_id"))
    mine = F.col("doc_id").eqNullSafe(F.col("_id"))
    return first.join(rest, mine, "left_anti").unionByName(_fed(rows.join(rest, mine, "left_semi"), F.lit(True), glossary, domain, dictionary, source, most))


def _answers(glossary: DataFrame, domain: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(key, target): what ``suggested`` recommends for a phrase that the tables have, which only depends on its key; null for nothing."""
    known = one_target(glossary.where("target_term is not null"), "source_term", "target_term", "id").where(F.coalesce(terms.clean_target(F.col("t")), F.lit("")) != "")
    words = one_target(dictionary, "vi", "en", "position").where("t is not null")
    keys = known.select("k").unionByName(words.select("k")).unionByName(domain.where("options is not null").select(T.word_key(F.col("term")).alias("k"))).distinct()
    rows = suggested(keys.select(F.col("k").alias("term"), F.lit("").alias("target")), "term", "target", glossary, domain, dictionary)
    return rows.select(F.col("term").alias("key"), F.get(F.transform(F.slice("options", 1, 1), spaced), F.lit(0)).alias("target"))


def _suggester(named: dict) -> Callable[[str], str | None]:
    """What ``suggested`` recommends for a phrase without a translation at hand, text by text; None for nothing. named: by the tables' keys."""
    blank, held = r"[ \t\n\x0b\f\r]", "\ue000"
    other, ends, marks = re.compile(r"[^\w \t\n\x0b\f\r]|_"), re.compile(r"[ \t\n\x0b\f\r\u00a0]+"), re.compile(MARKS)
    code = re.compile(r"[0-9]|^[A-Z0-9]+-[A-Z0-9\-]+\Z")
    preferred = re.compile(rf"([A-Za-z0-9 \t\n\x0b\f\r\-]+){blank}*\({blank}*ưu{blank}*tiên{blank}*\)", re.I)
    note = re.compile(rf"{blank}*\([^)]*{MARKS}[^)]*\)")
    inch, run_off = re.compile(rf"(stitches|stitch|mũi){blank}*/{blank}*inch", re.I), re.compile(rf"run(?:{blank}|-)off{blank}+stitching\Z", re.I | re.A)
    hyphens = [(re.compile(BEGIN + p + END, re.A), to) for p, to in (("Nosew", "No-sew"), ("nosew", "no-sew"), ("NOSEW", "NO-SEW"), (r"Tip\s*quarter", "Tip-quarter"), (r"tip\s*quarter", "tip-quarter"), (r"TIP\s*QUARTER", "TIP-QUARTER"))]
    forms = [(re.compile(p, re.A), to) for p, to in SPACED]
    shape, parts = re.compile(SHAPE.removeprefix("(?iu)").replace(r"\s", blank), re.I), [(re.compile(p.replace(r"\s", blank), re.I), name) for p, name in SHAPES]
    acronyms, told, blanks = set(ACRONYMS), {}, re.compile(f"{blank}+")

    def mended(patterns: list, t: str) -> str:
        for pattern, to in patterns:
            t = pattern.sub(to, t)
        return t

    def word_key(t: str) -> str:
        return ends.sub(" ", other.sub(" ", t.lower())).strip(" ")

    def word(w: str, start: bool) -> str:
        if (w, start) not in told:
            if len(told) > 10_000:
                told.clear()
            up = w.upper()
            told[w, start] = up if up in acronyms else w if code.search(w) else w[:1].upper() + w[1:].lower() if start else w.lower()
        return told[w, start]

    def cased(t: str) -> str:
        w = blanks.split(t.strip(" "))
        return " ".join([word(w[0], True), *(word(x, False) for x in w[1:])])

    def clean(t: str) -> str | None:
        t = t.strip(" ")
        m = preferred.search(t)
        t = note.sub("", m[1].strip(" ") if m and m[1].strip(" ") else t).strip(" ")
        t = inch.sub(rf"\1{held}inch", t)
        if "/" in t:
            some = [x for x in (x.strip(" ") for x in t.split("/")) if x]
            if not some:
                return None
            t = next((x for x in some if " " in x), some[0])
        t = t.replace(held, "/")
        t = "run-off stitching" if run_off.match(t) else t
        low = t.lower()
        return mended(hyphens, t) if "nosew" in low or "quarter" in low else t

    def first(term: str) -> str | None:
        low = term.lower()
        key = low if low.replace(" ", "").isalnum() else word_key(term)
        if key in named:
            return named[key]
        m = shape.match(term)
        if m is None and "(" not in term and "/" not in term and held not in term and "nosew" not in low and "quarter" not in low:
            if marks.search(term):
                return None  # all that is made of it has its letters
            primary = cased(term)
            if primary.lower() == low:
                return primary + " standard"  # the first option repeats the term
        if m:
            name = next((name for pattern, name in parts if pattern.search(m[1])), "Component")
            options = [name + " shape", name + " contour / profile", name + " symmetry"]
        else:
            primary = cased(term)
            options = [primary, primary + " standard", primary + " specification"]
        for option in options:
            option = clean(option)
            option = option if option is None else option.strip(" ")
            if option is not None and len(option) >= 2 and word_key(option) != key and not marks.search(option):
                return mended(forms, option)
        return None

    return first


def _read(rows: DataFrame, known: set, named: dict, source: str, most: int) -> DataFrame:
    """``fed``, by reading each document's lines in their order. Only lines that are pairs or of a phrase's length are shuffled; a task
    keeps ``most`` pairs, ``most`` phrases and the phrases' keys so far of one document."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.length("text")
    told = rows.where(size.between(5, 250) | (size > 250) & F.col("text").rlike(PAIR)).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "page", "line_no")
    fields = told.schema
    schema = StructType([fields["doc_id"]]).add("n", IntegerType()).add("term", StringType()).add("target", StringType()).add(fields["page"]).add(fields["line_no"]).add("kind", StringType(), False)
    shared = rows.sparkSession.sparkContext.broadcast((known, named))
    modal, pair_of = P.MODAL.removeprefix("(?iu)"), PAIR.replace(r"\s", r" \t\n\x0b\f\r").replace(r" \t\n\x0b\f\r*", r"[ \t\n\x0b\f\r]*").removesuffix("$") + r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, named = shared.value
        first = _suggester(named)
        blanks, barred, strange = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"[.?!;\n\r]"), re.compile(r"[\t\n\x0b\f\r]|  ")
        letter, inner = re.compile("[A-Za-z0-9_À-ỹ]"), re.compile("[A-Za-z0-9_À-ỹ](?:.*[A-Za-z0-9_À-ỹ])?", re.S)
        forms = [(re.compile(p, re.A), to) for p, to in SPACED]
        sentence, couple, marks = re.compile(modal, re.I), re.compile(pair_of), re.compile(MARKS)

        def mended(term: str) -> str:
            for pattern, to in forms:
                term = pattern.sub(to, term)
            return term

        def pair(text: str) -> tuple[str, str] | None:
            m = couple.match(text)
            if m is None:
                return None
            a, b = m[1].strip(" "), m[2].strip(" ")
            va, vb = bool(marks.search(a)), bool(marks.search(b))
            if va == vb and source != "vi":
                return None
            a, b = map(mended, (b, a) if vb and not va else (a, b))
            t = a.strip(" ")
            if a and b and a.lower() != b.lower() and 2 <= len(t) <= 40 and not barred.search(t) and not sentence.search(t) and len(blanks.split(t)) <= 4:
                return a, b
            return None

        def phrases(text: str) -> Iterator[tuple[int, int, str]]:
            words = blanks.split(text) if strange.search(text) else text.split(" ")
            begins, ends = [bool(w and letter.match(w[0])) for w in words], [bool(w and letter.match(w[-1])) for w in words]
            free = not barred.search(text) and not sentence.search(" ".join(words))
            mend = "quarter" in text.lower()
            for size, n in enumerate((4, 3, 2, 1)):
                for i in range(len(words) - n + 1):
                    term = " ".join(words[i : i + n])
                    if not (begins[i] and ends[i + n - 1]):
                        m = inner.search(term)
                        term = m[0] if m else ""
                    if mend:
                        term = mended(term)
                    if 2 <= len(term) <= 40 and (free or not barred.search(term) and not sentence.search(term)):
                        yield size, i + 1, term

        out: list[tuple] = []
        for doc, of_doc in itertools.groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0]):
            pairs, found, seen = {}, {}, set()
            for place, here in itertools.groupby(of_doc, key=lambda r: r[1:3]):
                texts = [r[3] for r in here]
                for term, target in sorted(filter(None, map(pair, texts))):
                    key = term.lower().strip(" ")
                    if len(pairs) < most and key not in known and key not in pairs:
                        pairs[key] = (term, target, *place, "pair")
                texts = [t for t in texts if len(t) <= 250]
                if len(found) == most or not texts:
                    continue
                for _, _, term in phrases(texts[0]) if len(texts) == 1 else sorted(x for t in texts for x in phrases(t)):
                    key = term.lower().strip(" ")
                    if key not in seen:
                        seen.add(key)
                        target = None if key in known else first(term)
                        if target is not None:
                            found[key] = (term, target, *place, "phrase")
                            if len(found) == most:
                                break
            kept = [*pairs.values(), *(x for key, x in found.items() if key not in pairs)][:most]
            out += [(doc, n, *x) for n, x in enumerate(kept, 1)]
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], schema.names)

    types = rows.select("doc_id", "page", "line_no").limit(0).toArrow().schema.types
    types = [types[0], pa.int32(), pa.string(), pa.string(), types[1], types[2], pa.string()]
    return told.mapInArrow(run, schema)


def _fed(rows: DataFrame, told: Column, glossary: DataFrame, domain: DataFrame, dictionary: DataFrame, source: str, most: int) -> DataFrame:
    """Candidates of rows, with phrases of those lines only for which told holds."""
    known = glossary.select(F.trim(F.lower("source_term")).alias("key")).distinct()
    a, b = (F.trim(F.regexp_extract("text", PAIR, i)) for i in (1, 2))
    rows_a = rows.where(F.col("text").rlike(PAIR)).withColumns({"a": a, "b": b})
    va, vb = P.has_marks(F.col("a")), P.has_marks(F.col("b"))
    turn = F.when(va & ~vb, 1).when(~va & vb, 2).when(F.lit(source == "vi"), 1)
    pairs = rows_a.withColumn("turn", turn).where("turn is not null").select("doc_id", "page", "line_no", spaced(F.when(F.col("turn") == 1, F.col("a")).otherwise(F.col("b"))).alias("term"), spaced(F.when(F.col("turn") == 1, F.col("b")).otherwise(F.col("a"))).alias("target"), F.lit(0).alias("kind"), F.lit(0).alias("size"), F.lit(0).alias("place"))
    pairs = pairs.where((F.col("term") != "") & (F.col("target") != "") & (F.lower("term") != F.lower("target")) & P.is_special_term(F.col("term")))
    words = rows.where(told & F.length("text").between(5, 250)).select("doc_id", "page", "line_no", F.split("text", r"\s+").alias("w"))
    of = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.lit(4 - n).alias("size"), i.alias("place"), F.regexp_replace(F.array_join(F.slice("w", i, n), " "), r"^[^A-Za-z0-9_À-ỹ]+|[^A-Za-z0-9_À-ỹ]+$", "").alias("term")))).otherwise(F.array().cast("array<struct<size: int, place: int, term: string>>"))
    phrases = words.select("doc_id", "page", "line_no", F.explode(F.flatten(F.array(*map(of, (4, 3, 2, 1))))).alias("g")).select("doc_id", "page", "line_no", spaced(F.col("g.term")).alias("term"), F.lit("").alias("target"), F.lit(1).alias("kind"), "g.size", "g.place").where(P.is_special_term(F.col("term")))
    order = ["kind", "page", "line_no", "size", "place"]
    every = pairs.unionByName(phrases).withColumn("key", F.trim(F.lower("term")))
    one = every.groupBy("doc_id", "key").agg(F.min(F.struct(*order, "term", "target")).alias("x")).join(known, "key", "left_anti").select("doc_id", *(F.col(f"x.{c}").alias(c) for c in (*order, "term", "target")))
    out = suggested(one, "term", "target", glossary, domain, dictionary)
    one_or_none = F.when(F.col("kind") == 0, F.array("target")).otherwise(F.transform(F.slice("options", 1, 1), spaced))
    out = out.withColumn("target", F.explode(one_or_none))
    best = out.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "term"))).where(F.col("n") <= most)
    return best.select("doc_id", "n", "term", "target", "page", "line_no", F.when(F.col("kind") == 0, "pair").otherwise("phrase").alias("kind"))
