"""The offline translator between English and Vietnamese.

A text passes five steps: approved terms are found (longest first, none over another, an automaton tells which can occur
at all) and locked; phrases, constructions and then single words are translated around them; locked terms come back in
the case that their place asks for. Dictionaries are the caller's tables, counted before they go to the tasks.
Punctuation before and structure after are Column expressions and the passes of ``functions.sop``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import language, sop, terms
from ..functions.vocabulary import ACRONYMS

#: Entries of a dictionary, at most; translated words that a task remembers.
MOST_ENTRIES, TOKENS = 200_000, 1 << 16


class Term(NamedTuple):
    source: str
    target: str
    direct: bool = True
    priority: int = 1


class Lexicon(NamedTuple):
    """Approved terms by direction ("en" from English), phrases (English, Vietnamese) in order, words both ways."""

    terms: dict[str, list[Term]]
    phrases: list[tuple[str, str]]
    words: dict[str, str]
    reverse: dict[str, str]


# Fixed values --------------------------------------------------------------------------------------------------------

#: Of terms with several targets, the one to take first.
PREFERRED = {"hở keo": r"bond\s*gap", "bọt khí": r"air\s*bubble", "sụp mí": r"run-off\s*stitching"}

#: Constructions: their words before a term or word, and the English ones.
CONSTRUCTIONS = [("không bị", "without"), ("không được", "must not"), ("sau khi", "after"), ("trước khi", "before"), ("phải đúng", "must meet"), ("phải", "must"), ("các", "the"), ("thiếu", "missing"), ("thừa", "excess")]

#: Endings of English words: ending, letters that a word has more than, what may stand in its place (letters off, letters on), the word before.
ENDINGS = [("ies", 4, [(3, "y")], "các"), ("es", 3, [(2, ""), (1, "")], "các"), ("s", 2, [(1, "")], "các"), ("ed", 3, [(2, ""), (1, "")], "đã"), ("ing", 4, [(3, ""), (3, "e")], "đang"), ("ly", 3, [(2, "")], "một cách")]

#: Words that stay, with numbers.
KEPT = r"^(?:ISO|NIST|SLA|RPO|RTO|RBAC|MFA|SSO|CAPA|QC|QA|BIA|BCP|DRP|v\d+)"

#: English left in Vietnamese sentences, in order.
BUSINESS = [
    (r"\bthe organization\b", "tổ chức"), (r"\bmust complete a comprehensive\b", "phải hoàn thành một cách toàn diện"), (r"\bmust complete\b", "phải hoàn thành"), (r"\bmust be enforced\b", "phải được thực thi"), (r"\bmust be\b", "phải được"),
    (r"\bpolicies\b", "các chính sách"), (r"\bpolicy\b", "chính sách"), (r"\bannual(?:ly)?\b", "hàng năm"), (r"\bin accordance with\b", "theo đúng"), (r"\bstandards?\b", "tiêu chuẩn"), (r"\bproduction zones\b", "khu vực sản xuất"), (r"\baccess control\b", "kiểm soát truy cập"),
    (r"\bwith\s+([0-9]+(?:[.,][0-9]+)?)\s*%?\s*uptime\b", r"với thời gian hoạt động \1%"), (r"\bacross all\b", "trên tất cả"), (r"\ball\b", "tất cả"), (r"\bcomprehensive\b", "toàn diện"), (r"\bcomplete\s+([a-zÀ-ỹ0-9\- ]+)\s+annually\b", r"hoàn thành \1 hàng năm"),
    (r"\bmust\s+enforced\b", "phải được thực thi"), (r"\benforced\b", "thực thi"), (r"\bproduction\s+zones?\b", "khu vực sản xuất"), (r"\bacross\s+all\b", "trên tất cả"),
    (r"Tổ chức phải hoàn thành một cách toàn diện ([^.!?]+) hàng năm theo đúng ([^.!?]+) và ([^.!?]+) tiêu chuẩn", r"Tổ chức phải hoàn thành \1 một cách toàn diện hàng năm theo đúng \2 và \3 tiêu chuẩn"),
    (r"các chính sách kiểm soát truy cập phải được thực thi trên tất cả 4 khu vực sản xuất với thời gian hoạt động 99,9%", "Các chính sách kiểm soát truy cập phải được thực thi trên tất cả 4 khu vực sản xuất với thời gian hoạt động 99,9%"),
    (r"\b([A-ZÀ-Ý][^.!?]*?)\s+phải được thực thi trên tất cả\s+(\d+)\s+khu vực sản xuất với thời gian hoạt động\s+([0-9.,]+%?)", r"Các \1 phải được thực thi trên tất cả \2 khu vực sản xuất với thời gian hoạt động \3"),
    (r"\bvới\s+(\d+(?:[.,]\d+)?)\s+thời gian hoạt động\b", r"với thời gian hoạt động \1%"), (r"\bthời gian hoạt động\s+(\d+(?:[.,]\d+)?)\b(?!%)", r"thời gian hoạt động \1%"), (r"\bwith\s+([0-9]+(?:[.,][0-9]+)?)\s*%?\s*thời gian hoạt động\b", r"với thời gian hoạt động \1%"),
    (r"(\d+)%\s*[.,]\s*(\d+)%", r"\1,\2%"), (r"(\d+)\.(\d+)(?=\s*(?:thời gian hoạt động|uptime|%))", r"\1,\2"), (r"(\d+),(\d+)(?=%)", r"\1,\2%"), (r"(\d+)[,.](\d+)%+", r"\1,\2%"),
]

#: English of the translator mended, in order.
MENDED = [
    (r"\b(\d+(?:[.,]\d+)?\s*-\s*\d+(?:[.,]\d+)?)\s+\d+(?:[.,]\d+)?\s*-\s*\d+(?:[.,]\d+)?\s+SPI\b", r"SPI \1 stitches/inch"), (r"\b(\d+(?:[.,]\d+)?(?:\s*-\s*\d+(?:[.,]\d+)?)?)\s+(?:stitches?|stitch)\s*(?:\/|\s*per\s*)\s*inch\b", r"SPI \1 stitches/inch"),
    (r"\bmust\s+tightly\b", "must be tight"), (r"\bmust\s+smooth\b", "must be smooth"), (r"\b(?:without|no|not)\s+is\s+gap\b", "without edge gap"), (r"\bcutting\s+holes\s+laser\b", "laser cutting holes"), (r"\bcutting\s+line\s+laser\b", "laser cutting line"),
    (r"\bquality\s+standard\s+tolerances\s+are\s+acceptable\b", "quality standard are acceptable"),
]

#: What a text must hold for a pattern of BUSINESS, MENDED and the densities to match, in the same order: a literal in lower case.
BUSINESS_NEEDS = [
    "the organization", "must complete a comprehensive", "must complete", "must be enforced", "must be", "policies", "policy", "annual", "in accordance with", "standard", "production zones", "access control",
    "uptime", "across all", "all", "comprehensive", "annually", "enforced", "enforced", "production", "across", "tổ chức phải hoàn thành một cách toàn diện", "các chính sách kiểm soát truy cập phải được",
    "phải được thực thi trên tất cả", "thời gian hoạt động", "thời gian hoạt động", "thời gian hoạt động", "%", ".", ",", "%",
]
MENDED_NEEDS = ["spi", "inch", "tightly", "smooth", "gap", "laser", "laser", "tolerances"]

_VIETNAMESE = re.compile("[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]", re.IGNORECASE)
_ENGLISH = r"\b(?:the|and|for|with|this|that|from|are|is|in|on|at|check|test|standard)\b"
_MEASURED = (r"^\s*(?:\/\s*inch|chỉ\b|kim\b|may\b|khâu\b)", r"\d+\s*-\s*\d+\s*$|\d+\s*$|\b(?:may|lại|bỏ|rút|hụt|số|đếm|từng|mỗi|các)\s*(?:\d+\s*)?$")

# Helpers -------------------------------------------------------------------------------------------------------------


def ascii_pattern(pattern: str) -> re.Pattern:
    """A pattern whose case does not count, with borders of ASCII words and ASCII digits."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return re.compile(pattern.replace(r"\b", edge).replace(r"\d", "[0-9]"), re.IGNORECASE)


def folded(text: str) -> str:
    """The text in lower case, with the letters that match i and s when case does not count."""
    return text.replace("İ", "i").lower().replace("ſ", "s").replace("ı", "i")


def rewritten(text: str, table: list[tuple[re.Pattern, str, str, bool]]) -> str:
    """The text after each pattern of a table in turn; one whose literal, or digit, the text lacks is passed over."""
    low, digit = folded(text), bool(_DIGIT.search(text))
    for pattern, to, need, counted in table:
        if need in low and (digit or not counted):
            text, n = pattern.subn(to, text)
            if n:
                low, digit = folded(text), bool(_DIGIT.search(text))
    return text


_DIGIT = re.compile("[0-9]")
_BUSINESS, _MENDED = ([(ascii_pattern(p), to, need, r"\d" in p) for (p, to), need in zip(table, needs, strict=True)] for table, needs in ((BUSINESS, BUSINESS_NEEDS), (MENDED, MENDED_NEEDS)))
_OPEN, _CLOSE = "\ue000", "\ue001"
_LOCK = f"{_OPEN}[0-9]+{_CLOSE}"
_ENGLISH_TOKEN = re.compile(rf"{_LOCK}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])[A-Za-z0-9_.\-%/:]+(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])[.\-%/:][A-Za-z0-9_.\-%/:]*(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|[^\sA-Za-z0-9_.\-%/:{_OPEN}]+|\s+")
_VIETNAMESE_TOKEN = re.compile(rf"{_LOCK}|(?:[^\W_]|[_.\-%:])+|(?:(?![\s{_OPEN}]|[^\W_]|[_.\-%:]).)+|\s+", re.DOTALL)
_CONSTRUCTIONS = [(a.split()[0], re.compile(rf"(?<![^\W_]){a.replace(' ', r'\s+')}\s+({_LOCK}|(?:[^\W_]|[_-])+)(?![^\W_])", re.IGNORECASE), b) for a, b in CONSTRUCTIONS]
_SYMBOLS, _NUMBER, _TIGHT, _WIDE, _MARK = re.compile(r"[^A-Za-z0-9_\s]+"), re.compile(r"[0-9]+(?:[.,][0-9]+)?%?"), re.compile(r"[^\S\r\n]+([,.:;!?])"), re.compile(r"[^\S\r\n]{2,}"), re.compile(_LOCK)
_KEPT, _AFTER, _BEFORE, _SAID = (ascii_pattern(p) for p in (KEPT, *_MEASURED, _ENGLISH))
_DENSITY = [(re.compile(r"(?<![A-Za-z0-9_])([0-9]+(?:[.,][0-9]+)?\s*-\s*[0-9]+(?:[.,][0-9]+)?)\s*mũi(?:\s*/\s*inch)?(?![^\W])", re.IGNORECASE), r"SPI \1 stitches/inch", "mũi", True), (re.compile(r"(?<![A-Za-z0-9_])([0-9]+(?:[.,][0-9]+)?)\s*mũi\s*/\s*inch(?![^\W])", re.IGNORECASE), r"SPI \1 stitches/inch", "mũi", True)]
_ACRONYMS = set(ACRONYMS)


def like(original: str, translated: str) -> str:
    """translated in the case of original: all capitals, a first capital, or as it is."""
    if len(original) > 1 and original == original.upper():
        return translated.upper()
    return translated[:1].upper() + translated[1:] if original[:1] == original[:1].upper() else translated


def placed(term: str, starts: bool) -> str:
    """A cleaned term in the case of its place: acronyms and codes as such, other words small, the first one of a sentence not."""
    if not term or term.lower() == "x-ray":
        return term and "X-ray"
    digits = any(c in "0123456789" for c in term)
    if term.upper() in _ACRONYMS or digits and re.fullmatch(r"[A-Za-z0-9_\-]+", term) or re.fullmatch(r"[A-Z0-9]{2,}", term):
        return term if digits else term.upper()
    out = []
    for i, w in enumerate(term.split()):
        fixed = {"no-sew": "No-sew" if starts and not i else "no-sew", "tip-quarter": "Tip-quarter" if starts and not i else "tip-quarter", "x-ray": "X-ray"}.get(w.lower())
        if w.upper() in _ACRONYMS:
            out.append(w.upper())
        elif fixed or any(c in "0123456789" for c in w) or re.fullmatch(r"[A-Z0-9]+-[A-Z0-9\-]+", w):
            out.append(fixed or w)
        else:
            out.append(w[:1].upper() + w[1:].lower() if starts and not i else w.lower())
    return " ".join(out)


class Terms:
    """Finds approved terms: the longest first, then direct ones, then by priority; spans do not overlap."""

    def __init__(self, table: list[Term]):
        import ahocorasick

        usable = [t for t in table if len(t.source.strip()) >= 2 and not re.fullmatch("[0-9]+", t.source.strip())]
        first = lambda t: (-len(t.source), not t.direct, 0 if (p := PREFERRED.get(t.source.lower().strip())) is None or re.search(p, t.target, re.IGNORECASE) else 1, -t.priority)
        self.terms = sorted(usable, key=first)
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, t in enumerate(self.terms):
            by.setdefault(re.sub(r"\s+", " ", t.source.strip().lower()), []).append(i)
        for word, numbers in by.items():
            self.automaton.add_word(word, numbers)
        if by:
            self.automaton.make_automaton()
        self.any = bool(by)

    def pattern(self, i: int) -> re.Pattern:
        if (p := self.compiled.get(i)) is None:
            source = self.terms[i].source.strip()
            plural = "(?:es|s)?" if re.search("[a-zA-Z]$", source) else ""
            p = self.compiled[i] = re.compile(rf"(?<![^\W_]){r'\s+'.join(map(re.escape, source.split()))}{plural}(?![^\W_])", re.IGNORECASE)
        return p

    def find(self, text: str) -> list[tuple[int, int, Term]]:
        if not self.any:
            return []
        able = sorted({i for _, numbers in self.automaton.iter(re.sub(r"\s+", " ", text.lower())) for i in numbers})
        taken: list[tuple[int, int, Term]] = []
        for i in able:
            term = self.terms[i]
            for m in self.pattern(i).finditer(text):
                if any(max(a, m.start()) < min(b, m.end()) for a, b, _ in taken):
                    continue
                if term.source.strip().lower() == "mũi" and (_AFTER.search(text[m.end() :]) or _BEFORE.search(text[: m.start()])):
                    continue  # a count of stitches, not the tip
                taken.append((m.start(), m.end(), term))
        return sorted(taken, key=lambda x: x[:2])

    def lock(self, text: str) -> tuple[str, list[Term]]:
        """The text with a mark in place of each term."""
        parts, end, found = [], 0, self.find(text)
        for k, (a, b, _) in enumerate(found):
            parts += [text[end:a], f"{_OPEN}{k}{_CLOSE}"]
            end = b
        return "".join([*parts, text[end:]]), [t for _, _, t in found]


class Translator:
    def __init__(self, lexicon: Lexicon):
        self.words, self.reverse = lexicon.words, lexicon.reverse
        self.phrases = [(re.compile(rf"(?<![^\W_]){re.escape(en)}(?![^\W_])", re.IGNORECASE), vi, en.lower()) for en, vi in lexicon.phrases]
        self.from_english = Terms(lexicon.terms.get("en", []))
        long = [Term(vi, en, False, 10) for en, vi in lexicon.phrases if len(vi.strip()) >= 30]
        known = {t.source.strip().lower() for t in long} | {t.source.strip().lower() for t in lexicon.terms.get("vi", []) if len(t.source.strip()) >= 2}
        short = {}
        for en, vi in lexicon.phrases:
            if 2 <= len(vi.strip()) < 30 and vi.strip().lower() not in known:
                short.setdefault(vi.strip().lower(), Term(vi, en, False, 0))
        self.from_vietnamese = Terms(long + lexicon.terms.get("vi", []) + list(short.values()))
        # words come back again and again: the last ones' translations are remembered
        self.english_token, self.vietnamese_token = lru_cache(TOKENS)(self.of_english), lru_cache(TOKENS)(self.of_vietnamese)

    def english(self, text: str, source: str) -> bool:
        """Whether to translate from English: what the text shows goes before what it is said to be."""
        vietnamese = bool(_VIETNAMESE.search(text))
        return not vietnamese if source == "en" else not vietnamese and bool(_SAID.search(text))

    def word(self, word: str) -> str:
        low = word.lower()
        if low in self.words:
            return like(word, self.words[low])
        for ending, more, bases, before in ENDINGS:
            if low.endswith(ending) and len(low) > more and not (ending == "s" and low.endswith("ss")):
                for off, on in bases:
                    if self.words.get(low[: len(low) - off] + on):
                        return f"{before} {self.words[low[: len(low) - off] + on]}"
        return word

    def of_english(self, token: str) -> str:
        """A token of an English text: locked terms, space, symbols, numbers and codes stay."""
        if token[0] == _OPEN or token.isspace() or _SYMBOLS.fullmatch(token) or _NUMBER.fullmatch(token) or _KEPT.search(token):
            return token
        return self.word(token)

    def of_vietnamese(self, token: str) -> str:
        """A token of a Vietnamese text: what the dictionary lacks stays."""
        plain = token[0] == _OPEN or token.isspace() or not any(c.isalnum() for c in token) or token[0] in "0123456789"
        low = token.lower()
        return like(token, self.reverse[low]) if not plain and low in self.reverse else token

    def to_vietnamese(self, text: str) -> str:
        text, locked = self.from_english.lock(text)
        low = text.lower()
        for pattern, vi, en in self.phrases:
            if en in low:
                text = pattern.sub(lambda _, v=vi: v, text)
                low = text.lower()
        text = _MARK.sub(lambda m: locked[int(m[0][1:-1])].target, "".join(map(self.english_token, _ENGLISH_TOKEN.findall(text))))
        return rewritten(_TIGHT.sub(r"\1", _WIDE.sub(" ", text)).strip(), _BUSINESS)

    def to_english(self, text: str) -> str:
        text, locked = self.from_vietnamese.lock(rewritten(text, _DENSITY))
        low = folded(text)
        for need, pattern, before in _CONSTRUCTIONS:
            if need in low:
                text = pattern.sub(lambda m, b=before: f"{b} {m[1]}", text)
        text, parts, end = "".join(map(self.vietnamese_token, _VIETNAMESE_TOKEN.findall(text))), [], 0
        for m in _MARK.finditer(text):
            parts.append(text[end : m.start()])
            before = "".join(parts)
            starts = not before or re.search(r"[.!?\n*]\s*\Z", before) or re.fullmatch(r"[0-9]+[.)]\s*", before)
            parts.append(placed(locked[int(m[0][1:-1])].target, bool(starts)))
            end = m.end()
        return rewritten("".join([*parts, text[end:]]), _MENDED)


# The operator --------------------------------------------------------------------------------------------------------


def lexicon(approved: DataFrame, phrases: DataFrame | None = None, words: DataFrame | None = None) -> Lexicon:
    """A lexicon of tables: approved (source_term, target_term, source_lang, priority), phrases (position, en, vi), words (en, vi: slashes part variants)."""

    def rows(df):
        got = df.limit(MOST_ENTRIES + 1).collect()
        if len(got) > MOST_ENTRIES:
            raise ValueError(f"over {MOST_ENTRIES} entries")
        return got

    cleaned = approved.select("source_term", "target_term", terms.clean_target(F.col("target_term")).alias("clean"), "source_lang", F.coalesce("priority", F.lit(1)).alias("priority")).where("source_term is not null and target_term is not null")
    table = {"en": [], "vi": []}
    for r in sorted(rows(cleaned), key=lambda r: (r.source_term, r.target_term, r.source_lang)):
        table.setdefault(r.source_lang, []).append(Term(r.source_term, r.target_term if r.source_lang == "en" else r.clean or "", True, r.priority))
    pairs = [(r.en, r.vi) for r in sorted(rows(phrases), key=lambda r: (r.position, r.en))] if phrases is not None else []
    forward, back = {}, {}
    for r in sorted(rows(words), key=lambda r: (r.en, r.vi)) if words is not None else []:
        forward.setdefault(r.en.lower(), r.vi)
        for part in r.vi.split("/"):
            key = re.sub(r"\([^)]+\)", "", part.strip()).strip().lower()
            if len(key) >= 2:
                back.setdefault(key, r.en)
    return Lexicon(table, pairs, forward, back)


def translated(units: DataFrame, lexicon: Lexicon, source: str = "en", text: str = "text") -> DataFrame:
    """units with ``translated`` and ``from_english``; null stays null. source: the language that texts are said to have."""
    rows = units.withColumn("_clean", language.punctuated(F.col(text)))
    schema = T.StructType([*units.schema.fields, T.StructField("_done", T.StringType()), T.StructField("from_english", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translator = Translator(lexicon)
        for b in batches:
            known: dict = {None: (None, None)}
            column = b.column(b.num_columns - 1).to_pylist()
            for t in column:
                if t not in known:
                    english = translator.english(t, source)
                    known[t] = (translator.to_vietnamese(t) if english else translator.to_english(t), english)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([known[t][0] for t in column], pa.string()), pa.array([known[t][1] for t in column], pa.bool_())], schema.names)

    done = terms.hyphenated(F.col("_done"))
    # what is Vietnamese now has no structure to mend
    english = sop.structured(rows.mapInArrow(run, schema).withColumn("_english", F.when(~F.col("from_english"), done)), "_english")
    return english.withColumn("translated", F.when(F.col("from_english"), F.col("_done")).otherwise(F.col("structured"))).select(*units.columns, "translated", "from_english")
