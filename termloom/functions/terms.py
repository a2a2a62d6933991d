"""Rewriting of terms and translations: targets, stitch density, hyphens, enforcement, splitting, spelling."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import predicates as P
from . import text as T
from .language import is_model_name  # noqa: F401  (a predicate of terms, too)

RANGE = r"\d+(?:[.,]\d+)?\s*-\s*\d+(?:[.,]\d+)?"
PER_INCH = r"stitches\s*(?:/|\s*per\s*)\s*inch"
def clean_target(term: Column) -> Column:
    """a glossary target without notes; the preferred variant, else the first alternative with a space, else the first."""

    def chosen(locked: Column) -> Column:
        parts = F.array_remove(F.transform(F.split(locked, "/"), lambda x: F.trim(x)), "")
        first = T.let(parts, lambda p: F.coalesce(F.get(F.filter(p, lambda x: x.contains(" ")), F.lit(0)), F.get(p, F.lit(0))))
        return F.replace(F.when(locked.contains("/"), first).otherwise(locked), F.lit(""), F.lit("/"))

    # bodies of lambdas are interpreted: what is used twice is told once
    preferred = F.array(F.trim(term), F.trim(F.regexp_extract(F.trim(term), r"(?iu)([A-Za-z0-9\s\-]+)\s*\(\s*ưu\s*tiên\s*\)", 1)))
    t = T.let(preferred, lambda p: F.when(p[1] != "", p[1]).otherwise(p[0]))
    t = F.trim(F.regexp_replace(t, rf"\s*\([^)]*{T.VIETNAMESE}[^)]*\)", ""))
    t = T.let(F.regexp_replace(t, r"(?iu)(stitches|stitch|mũi)\s*/\s*inch", "$1inch"), chosen)
    return hyphenated(T.let(t, lambda x: F.when(x.rlike(r"(?i)^run[\s-]off\s+stitching$"), "run-off stitching").otherwise(x)))


def _where(text: Column, parts: Sequence[str], mend) -> Column:
    """mend(text) where one of some parts, in lower case, stands in a text, which its patterns need; else the text."""
    held = lambda t: T.let(F.lower(t), lambda low: functools.reduce(operator.or_, (low.contains(p) for p in parts)))
    return T.let(text, lambda t: F.when(held(t), mend(t)).otherwise(t))


def hyphenated(text: Column) -> Column:
    """no-sew and tip-quarter with their hyphens, in the case they have."""

    def mend(text: Column) -> Column:
        for pattern, to in (("Nosew", "No-sew"), ("nosew", "no-sew"), ("NOSEW", "NO-SEW"), (r"Tip\s*quarter", "Tip-quarter"), (r"tip\s*quarter", "tip-quarter"), (r"TIP\s*QUARTER", "TIP-QUARTER")):
            text = F.regexp_replace(text, P.B + pattern + P.E, to)
        return text

    return _where(text, ["nosew", "quarter"], mend)


def reordered(text: Column) -> Column:
    """"Shape toe" as "Toe shape"."""

    def mend(text: Column) -> Column:
        for part in ("tip", "toe", "collar", "heel", "vamp", "tongue"):
            text = F.regexp_replace(text, rf"(?i){P.B}Shape\s+{part}{P.E}", f"{part.capitalize()} shape")
        return text

    return _where(text, ["shape"], mend)


def stitch_density(text: Column) -> Column:
    """every way to write a stitch density as "SPI 9-10 stitches/inch"; counts of back stitches stay."""
    return _where(text, ["spi", "stiches", "inch", "ũ"], _stitch_density)


def _stitch_density(text: Column) -> Column:
    out = F.regexp_replace(text, rf"(?i){P.B}stiches{P.E}", "stitches")
    out = F.regexp_replace(out, rf"(?i){P.B}({RANGE})\s+{RANGE}\s*(?:SPI|{PER_INCH}){P.E}", "SPI $1 stitches/inch")
    back = r"(?<!(?:lùi|lại|khóa)\s{0,3})(?<!(?:lùi|lại|khóa) mũi )"
    out = F.regexp_replace(out, rf"(?iu){P.B}{back}({RANGE})\s*mũi(?:\s*/\s*inch)?(?![\p{{L}}\p{{N}}])", "SPI $1 stitches/inch")
    out = F.regexp_replace(out, r"(?iu)(?<![A-Za-z0-9_])(\d+(?:[.,]\d+)?)\s*mũi\s*/\s*inch", "SPI $1 stitches/inch")
    out = F.regexp_replace(out, rf"(?i){P.B}SPI\s*[:\-]?\s*({RANGE}|\d+(?:[.,]\d+)?)(?:\s*(?:SPI|{PER_INCH}))?{P.E}", "SPI $1 stitches/inch")
    out = F.regexp_replace(out, rf"(?i){P.B}(?<!SPI )(?<!-)({RANGE}|\d+(?:[.,]\d+)?)\s*(?:SPI|{PER_INCH}){P.E}", "SPI $1 stitches/inch")
    out = F.regexp_replace(out, rf"(?i){P.B}SPI\s+SPI{P.E}", "SPI")
    out = F.regexp_replace(out, r"(?i)(stitches\s*/\s*inch)(?:\s+stitches\s*/\s*inch)+", "$1")
    return F.regexp_replace(out, rf"(?i){P.B}spi{P.E}", "SPI")


def split_bilingual(text: Column, is_item: Column | None = None) -> Column:
    """(en, vi) of a bilingual text, else null: two lines, lines that take turns, two blocks of lines; and of an inspection item two parts around a dash, or glued words."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.array_remove(F.transform(F.split(t, "\n"), strip), "")
    vi = lambda x: P.has_marks(x)
    en = lambda x: ~P.has_marks(x) & x.rlike("[a-zA-Z]{2,}")
    pair = lambda a, b: F.struct(a.alias("en"), b.alias("vi"))
    joined = lambda x: F.array_join(x, "\n")
    step = T.step_number
    same = lambda a, b: F.coalesce(step(a) == step(b), F.lit(False))
    differ = lambda a, b: F.coalesce(step(a) != step(b), F.lit(False))

    def of_lines(l: Column) -> Column:
        a, b, n = F.get(l, F.lit(0)), F.get(l, F.lit(1)), F.size(l)
        two = F.when(en(a) & vi(b), pair(a, b)).when(vi(a) & en(b), pair(b, a))
        turn = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: F.struct(F.get(l, i * 2).alias("a"), F.get(l, i * 2 + 1).alias("b")))
        sides = F.transform(turn, lambda p: F.when((en(p["a"]) & vi(p["b"])) | (same(p["a"], p["b"]) & en(p["a"]) & ~vi(p["b"])), pair(p["a"], p["b"])).when((vi(p["a"]) & en(p["b"])) | (same(p["a"], p["b"]) & ~vi(p["a"]) & en(p["b"])), pair(p["b"], p["a"])))
        turns = F.when((n % 2 == 0) & F.forall(sides, lambda p: p.isNotNull()), pair(joined(F.transform(sides, lambda p: p["en"])), joined(F.transform(sides, lambda p: p["vi"]))))
        other = F.transform(l, lambda x: F.when(vi(a), en(x)).otherwise(vi(x)))
        cut = F.array_position(other, True).cast("int") - 1  # where the second block begins
        one, rest = F.slice(l, 1, F.greatest(cut, F.lit(0))), F.slice(l, F.greatest(cut, F.lit(0)) + 1, n)
        valid = (cut > 0) & F.forall(one, lambda x: F.when(vi(a), vi(x)).otherwise(en(x))) & F.forall(rest, lambda x: F.when(vi(a), en(x)).otherwise(vi(x)))
        sized = (F.size(one) == F.size(rest)) | ((F.size(one) >= 2) & (F.size(rest) >= 2))
        apart = (F.size(one) == F.size(rest)) & F.exists(F.arrays_zip(one.alias("x"), rest.alias("y")), lambda p: differ(p["x"], p["y"]))
        blocks = F.when(valid & sized & ~apart, F.when(vi(a), pair(joined(rest), joined(one))).otherwise(pair(joined(one), joined(rest))))
        return F.when(n == 2, two).when(n >= 4, F.coalesce(turns, blocks))

    # fixed values: patterns of the parts around a dash, of what they must not be, and of glued words
    dash = r"^([A-Za-z0-9\s/&,'()]+?)\s*[-–—]\s*([^\-–—]+)$"
    left, right = strip(F.regexp_extract(t, dash, 1)), strip(F.regexp_extract(t, dash, 2))
    barred = (
        left.rlike(r"(?iu)^(ctq|step|item|qam|pfc|note|ghi\s*chú|\d+[.)]?)\s*\d*$") | left.rlike(r"^\d+[.,]?\d*$") | right.rlike(r"^\d+[.,]?\d*$") | left.rlike(r"(?iu)^(inch|cm2|mm|kg|size|eo|phom|đế|mũi|gót)$") | right.rlike(r"(?i)^(inch|cm2|mm|kg|size|eo)$")
        | right.rlike(rf"(?iu){P.EDGE}(bị|được|sau\s*khi|khi|để|phải|không|cần|làm|theo|như|các){P.EDGE}") | (~t.rlike(r"\s[-–—]|[-–—]\s") & right.rlike("^[a-zA-Z0-9]") & ~P.has_marks(F.split(right, r"\s+")[0]))
    )
    said = P.has_marks(right) | right.rlike(rf"(?iu){P.EDGE}(keo|mai|mài|dan|dán|vong|vòng|mui|mũi|cao|got|gót|com|cộm|ve|vệ|de|đế|bo|bộ|nhan|nhăn|ho|hở|meo|méo|lot|lót|chặt|may|định|vệ|sinh|lỗ|đục){P.EDGE}")
    dashed = t.rlike(dash)
    by_dash = F.when(dashed & ~barred & ~P.has_marks(left) & (F.length(left) >= 3) & left.rlike("[a-zA-Z]{3,}") & said & (F.length(right) >= 3), pair(left, right))
    glued = r"^([A-Za-z0-9\s/&,'()]*?[a-z0-9])([A-Z][\s\S]*)$"
    first, last = strip(F.regexp_extract(t, glued, 1)), strip(F.regexp_extract(t, glued, 2))
    plain = ~first.rlike(rf"(?i){P.EDGE}(ghi|chu|may|dan|mai|keo|got|de|mui|lot|nhan|chay|rap|phom|khuon|bien|chi|lon|dap|cuon|xo|cot|day|ban|lo|dinh|quet|vien|bao|trung|eo){P.EDGE}")
    by_case = F.when(t.rlike(glued) & ~P.has_marks(first) & plain & (F.size(F.split(first, r"\s+")) >= 2) & first.rlike("[a-zA-Z]{3,}") & P.has_marks(last), pair(first, last))
    item = F.coalesce(is_item, F.lit(False)) if is_item is not None else F.lit(False)
    return F.coalesce(F.when(t.contains("\n"), T.let(lines, of_lines)), F.when(item & ~(dashed & barred), F.coalesce(by_dash, by_case)))


def unique_names(names: Column, suffix: str = "", longest: int = 31) -> Column:
    """array of names that differ whatever their case, cut so that a number and the suffix fit; the first free number is taken, in order."""

    def add(done: Column, name: Column) -> Column:
        tail = lambda i: F.concat(F.when(i > 0, F.concat(F.lit(" "), i.cast("string"))).otherwise(""), F.lit(suffix))
        made = F.transform(F.sequence(F.lit(0), F.size(done)), lambda i: F.concat(F.substr(name, F.lit(1), F.lit(longest) - F.length(tail(i))), tail(i)))
        used = F.transform(done, F.lower)
        return F.concat(done, F.array(F.filter(made, lambda x: ~F.array_contains(used, F.lower(x)))[0]))

    return F.aggregate(F.coalesce(names, F.array().cast("array<string>")), F.array().cast("array<string>"), add)


def spelling(text: Column, phrases: Sequence[str]) -> Column:
    """known phrases whose accents are wrong or missing, as they should be; capitals at the start are kept."""
    variants = {"a": "aàáạảãâầấậẩẫăằắặẳẵ", "e": "eèéẹẻẽêềếệểễ", "i": "iìíịỉĩ", "o": "oòóọỏõôồốộổỗơờớợởỡ", "u": "uùúụủũưừứựửữ", "y": "yỳýỵỷỹ", "d": "dđ"}
    fold = str.maketrans(T.MARKED, T.PLAIN)
    for phrase in phrases:
        body = r"\s*".join("".join(f"[{variants[c]}]" if c in variants else c for c in w) for w in phrase.translate(fold).split())
        for found, to in ((phrase, phrase), (phrase[0].upper() + phrase[1:], phrase[0].upper() + phrase[1:])):
            first = f"(?=[{found[0]}{found[0].translate(fold) if found[0].islower() else found[0].lower().translate(fold).upper()}])"
            text = F.regexp_replace(text, rf"(?<!\p{{L}}){first}(?iu:{body})(?!\p{{L}})", to)
    return text


def enforced(pairs: DataFrame, key: str, rules: list[dict]) -> DataFrame:
    """F16: (key, target, replaced): where a source holds a rule's term and its target lacks the approved form, known synonyms become it.

    rules: term, target, synonyms; longer terms first. A sentence's start keeps its capital.
    """
    import re

    order = sorted(rules, key=lambda r: (-len(r["term"]), r["term"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = lambda x: re.compile(rf"(?<![^\W_]){r'[\s-]+'.join(map(re.escape, x.split()))}(?:es|s)?(?![^\W_])", re.IGNORECASE)
        compiled = [(word(r["term"]), r["target"], [word(s) for s in r["synonyms"]]) for r in order]
        for b in batches:
            out = []
            for source, target in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                target, n = target or "", 0
                for term, approved, synonyms in compiled:
                    if not term.search(source or "") or approved.lower() in target.lower():
                        continue
                    for s in synonyms:
                        target, k = s.subn(lambda m, a=approved: a[0].upper() + a[1:] if m[0][0].isupper() else a, target)
                        n += k
                out.append((target, n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], [key, "target", "replaced"])

    return pairs.select(F.col(key).cast("long").alias(key), "source", "target").mapInArrow(run, f"{key} long, target string, replaced long")
