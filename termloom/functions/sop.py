"""the house style of work instructions, as an ordered program of rewrites.

A program is a list of rules (pattern, replacement); a space in a pattern stands for white space of any kind, and
``exact`` tells a pattern whose case counts. Rules run in order, each over what the ones before left. An
automaton over the words that a rule cannot do without tells in one pass which rules can fire; it runs again only over
a text that a rule has changed, so a program costs little more than the rules that fire, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule(NamedTuple):
    pattern: str
    to: str
    exact: bool = False


# Rewrites, in their order ------------------------------------------------------------------------------

POLISH = [
    Rule(r"\b(minimi[sz]e|limit|reduce) (?:the )?thread expose\b", r"\1 exposed threads"),
    # tolerances and quality standards
    Rule(r"\bquality standard tolerances are acceptable\b", "quality standards are acceptable"),
    Rule(r"\blevel Color migration is acceptable\b", "color migration is acceptable"),
    # machines
    Rule(r"\bCheck machine have is to align temperature\s*/time/\s*pressure machine nosew correct PFC\s*:", "Check if no-sew machine temperature/time/pressure settings comply with PFC:"),
    Rule(r"\bCheck machine have is to\b", "Check if machine is adjusted to"),
    Rule(r"\bCheck machine have been adjusted\b", "Check if machine is adjusted for"),
    Rule(r"\bCheck (?:the )?time and temp of heating oven follow PFC\s*:", "Check if oven time and temperature follow PFC:"),
    Rule(r"\bTime/temperature of heating oven follow PFC\b", "Check if oven time and temperature follow PFC"),
    # actions without fillers
    Rule(r"\b(?:Carry out|Conduct|Proceed to) (?:sweeping glue|cementing)\b", "Apply cement"),
    Rule(r"\b(?:Carry out|Conduct|Proceed to) priming\b", "Apply primer"),
    Rule(r"\b(?:Carry out|Conduct|Proceed to) (?:nosew|no-sew)\b", "Press nosew"),
    Rule(r"\b(?:Carry out|Conduct|Perform) inspection\b", "Inspect"),
    # lean phrases
    Rule(r"\b(?:The operator (?:must use|uses) scissors to trim)\b", "Trim"),
    Rule(r"\b(?:The operator must use a hammer to flatten)\b", "Hammer and flatten"),
    Rule(r"\b(?:The operator must|Operator must) ", ""),
    Rule(r"\bThe lasting operation must pull the upper edge\b", "Pull upper edge"),
    Rule(r"\bavoiding a wrinkle upper or bulging that is not smooth on the finished shoe\b", "to prevent upper wrinkles or bulging"),
    Rule(r"\bAcceptance quality standard for hole margin deviation is 0\.5mm according to the updated QA manual\b", "Standard: Hole margin deviation <= 0.5mm per updated QA manual"),
    Rule(r"\b(?:according to the updated QA manual|according to QA manual update)\b", "per updated QA manual"),
    Rule(r"\bCheck that the finished shoe has no\b", "Check if the finished shoe has no"),
    Rule(r"\bThe backside after lasting must be\b", "Lasting backside must be"),
    Rule(r"\bCheck if the heel seam of the upper is centered\b", "Check if the upper heel seam is centered"),
    Rule(r"\bto avoid X-ray at the tip during tip lasting\b", "to prevent tip bunion/X-ray during lasting"),
    Rule(r"\bThe notches after stitching must fit tightly together, not too tight or too loose\b", "Ensure notches fit snugly without gap/tightness"),
    Rule(r"\bthe stitching must be smoothly and evenly applied following the notches\b", "stitch smoothly and evenly following notches"),
    Rule(r"\bThe outsole is placed accurately according to\b", "Align outsole accurately with"),
    # defects and components
    Rule(r"\b(?:not bag empty|bag empty|no envelope|no empty bag)\b", "no air bubbles"),
    Rule(r"\b(?:The front face|Front face) is (?:color migration|hidden color)\b", "Vamp component has color migration"),
    Rule(r"\bshoe face after press nosew\b", "upper after nosew pressing"),
    Rule(r"\bcheck component vamp\b", "check vamp component"),
    # headers and damaged acronyms
    Rule(r"(\b(?:IPQC|QA|QC|OQC)?\s*(?:Cutting|Stitching|Assembly|Stockfit|HFPA)?\s*Inspection Focuses\s*:\s*)inspection focuses\s*", r"\1"),
    Rule(r"\bf press vamp/F upper\b", "H/F upper pressing"),
    Rule(r"\bf press vamp\b", "H/F upper pressing"),
    Rule(r"\bf press\b", "H/F press"),
    # conditions begin with "Check if"
    Rule(r"\bCheck (?:with|if) real temp(?:erature)? (\d+[-–]\d+(?:[-–]\d+)?°?\s*C?) of (?:hold|hot) mold,\s*time\s*(\d+s?),\s*pressure\s*([0-9\-]+(?:kg)?)", r"Check if hot mold temp is \1, time \2, pressure \3"),
    Rule(r"\bCheck (?:with|if) real temp(?:erature)? (\d+[-–]\d+(?:[-–]\d+)?°?\s*C?) of (?:hold|hot) mold,\s*time\s*(\d+s?)", r"Check if hot mold temp is \1, time \2"),
    Rule(r"\bCheck (?:with|if) real temp(?:erature)? (\d+[-–]\d+(?:[-–]\d+)?°?\s*C?) of (?:hold|hot) mold", r"Check if hot mold temp is \1"),
    Rule(r"\bCheck (?:with|if) real temp(?:erature)? (\d+[-–]\d+(?:[-–]\d+)?°?\s*C?)\b", r"Check if actual temp is \1"),
    Rule(r"\bCheck (?:with|if) real temp(?:erature)?\b", "Check if actual temp is"),
    Rule(r"\bCheck (?:with|if) putting upper onto hot mold must edge-even with mold\b", "Check if upper is edge-even with hot mold"),
    Rule(r"\bputting upper onto hot mold must edge-even with mold\b", "upper is edge-even with hot mold"),
    Rule(r"\bBOM sight with be at center of Heel\b", "projector light centered on heel"),
    Rule(r"\bBOM sight with be at center\b", "projector light centered"),
    Rule(r"\bespecially at Qtr not to tight that cause scratch,\s*mark on logo\b", "quarter not too tight to avoid logo marks/scratches"),
    Rule(r"\bAdjust the pull to avoid crack on cosmetic\b", "Adjust pull to avoid cracking under logo"),
    Rule(r"\bCheck after BPM,?\s*logo is not scratch,\s*mark on logo,?\s*no cracking under logo\b", "Check if logo has no marks, scratches, or under-paint cracks after BPM"),
    Rule(r"\blogo is not scratch,\s*mark on logo,?\s*no cracking under logo\b", "logo has no marks, scratches, or under-paint cracks"),
    Rule(r"\bCheck (?:with|if) upper match with BPM\b", "Check if upper matches BPM"),
    Rule(r"\bCheck (?:with|if) upper match\b", "Check if upper matches"),
    Rule(r"\bmark on mold must match with mark on machine to avoid mark on logo\b", "mold mark matches machine to avoid mark on logo"),
    Rule(r"\bCheck (?:with|if) logo and Qtr must have same size\b", "Check if logo and Qtr have same size"),
    Rule(r"\bCheck (?:with|if) spraying cement on upper\b", "Check if cement is sprayed on upper"),
    Rule(r"\bCheck (?:with|if) finished shoe must not have\b", "Check if finished shoe has no"),
    Rule(r"\bCheck (?:with|if) collar shape must (?:be )?consistent\b", "Check if collar shape is consistent"),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must edge-even with\b", r"Check if \1 is edge-even with"),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must be ", r"Check if \1 is "),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must match\b", r"Check if \1 matches"),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must have\b", r"Check if \1 has"),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must not have\b", r"Check if \1 does not have"),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must fit\b", r"Check if \1 fits"),
    Rule(r"\bCheck (?:with|if) ([A-Za-z0-9\s\-_/]+?) must align\b", r"Check if \1 aligns"),
    Rule(r"\bCheck with\b", "Check if", True),
    Rule(r"\bcheck with\b", "check if", True),
    Rule(r"\bCheck (?:that|whether)\b", "Check if"),
    Rule(r"\bVerify (?:that|if)\b", "Check if"),
    Rule(r"\bVerify apply MEK\b", "Check if MEK is applied"),
    Rule(r"\bVerify applying ", "Check if "),
    Rule(r"\bVerify the operator uses a hammer to flatten\b", "Check if hammer is used to flatten"),
    Rule(r"\bVerify the brush is used\b", "Check if brush is used"),
    Rule(r"\bVerify the operation\b", "Check operation"),
    Rule(r"\bVerify finished shoe\b", "Check if finished shoe"),
    Rule(r"\bVerify components are fixed\b", "Check if components are fixed"),
    Rule(r"\bVerify temperature,\s*time,\s*and\s*pressure\b", "Check temperature, time, and pressure"),
    Rule(r"\bVerify deco holes depth\b", "Check if deco hole depth"),
    Rule(r"\bVerify toe lasting operation\b", "Check toe lasting operation"),
    Rule(r"\bVerify material and pressing mold\b", "Check if material and pressing mold"),
    Rule(r"\bVerify upper quality\b", "Check upper quality"),
    Rule(r"\bVerify strobel is stitched\b", "Check if strobel is stitched"),
    Rule(r"\bVerify pressing mold\b", "Check if pressing mold"),
    Rule(r"\bVerify gauge marking pressure\b", "Check gauge marking pressure"),
    Rule(r"\bVerify upper fits\b", "Check if upper fits"),
    Rule(r"\bVerify bottom attaching\b", "Check bottom attachment"),
    Rule(r"\bVerify no-sew shape\b", "Check if no-sew shape"),
    Rule(r"\bVerify stitching collar\b", "Check if stitching collar"),
    Rule(r"\bVerify\b", "Check if", True),
    Rule(r"\bverify\b", "check if", True),
    Rule(r"\bCheck if if\b", "Check if"),
    # hyphens and densities
    Rule(r"\bTip\s*quarter\b", "Tip-quarter"),
    Rule(r"\b(\d+-\d+|\d+) SPI\b", r"SPI \1 stitches/inch"),
]

#: Rules of a stage of production, after the others.
STAGES = {"nosew": [Rule(r"\bfilm protect\b", "protective film")], "stitching": [Rule(r"\bmargin mudguard\b", "stitch mudguard")], "assembly": [Rule(r"\bupper with sole\b", "upper to bottom")]}
STAGES["no-sew"] = STAGES["nosew"]

#: The last rules, whatever the stage.
HYPHENS = [Rule(r"\bNosew\b", "No-sew", True), Rule(r"\bnosew\b", "no-sew", True), Rule(r"\bNOSEW\b", "NO-SEW", True)]

#: A note that was once translated wrongly, as a whole, and the approved one.
WRONG_NOTE = "due to the surface tip quarter design, flat does not accept the quality standard swoosh paint printing level, it is not smooth, the base paint flows after nosew as shown in the updated qa manual"
RIGHT_NOTE = "Due to the uneven surface design of the Tip-quarter, quality standard are acceptable for non-smooth screen-printed logos and base paint bleeding after no-sew, as shown in the updated QA manual"

#: Terms that are written small within a sentence.
SMALL = """
finished shoe|finished shoes|finished shoe product|finished goods
color bleeding|color migration|color shade variation|color shade|color different|color contamination
collar lining|collar opening|collar pad|collar shape|heel shape|heel counter|heel seam|toe shape|toe lasting|toe curve|toe cap|toe box|vamp shape|vamp component|tongue shape
shoelaces|shoelace|laces|lace|eyestay|eyestays|mudguard|mudguards|foxing|foxings
hot mold|cold mold|hold mold|top plate|bottom plate|press mold|pressing mold|press machine|pressing machine|molding machine|measuring jig|marking line|jig fitting
strobel stitching|strobel stitch|strobel|stitch density|stitch spacing|run-off stitching|run off stitching|crooked stitching|uneven stitching|gathering stitching|airbag thread line drawing|thread line drawing
projector light|bond gap|bond failure|lack of cement|cement overflow|glue overflow|excess cement|over cement|cement line|visible mark|visible marks|demolding mark|demolding marks|indentation|dent
material edge|flashing|scratches|scratch|marks|mark|oil stain|oil stains|dirt|dirty|stain|stains|broken thread|broken threads|thread breakage|exposed threads|thread expose
wrinkle upper|deformation|deformed|air bubble|air bubbles|rocking|over buffing|swapped feet|pin holes|cosmetic layer|perforation holes|inspection quantity|hammering flat|sole heating|stop line|hot/cool shaping
upper|uppers|outsole|outsoles|midsole|midsoles|insole|insoles
""".replace("\n", "|").strip("|").split("|")  # fmt: skip

#: Acronyms of the trade: full name, meaning, what they must not become.
ACRONYMS = [
    ("O/S", "Outsole", "Đế ngoài", ["Operating System", "Open Source", "OS"]),
    ("M/S", "Midsole", "Đế trung", ["Microsoft", "MS", "Milliseconds"]),
    ("BTM", "Bottom", "Cụm đế", ["Bitcoin", "ATM", "Bathroom"]),
    ("WB", "Water-based cement", "Keo gốc nước", ["Warner Bros", "Warner Brothers", "World Bank"]),
    ("HFW", "High-Frequency Welding", "Ép cao tần", ["Heavy Forged Weapon", "Hardware"]),
    ("OB", "Over buffing", "Mài cao / Mài quá mức", ["Obstetrics", "Out of Bounds"]),
    ("UB", "Under buffing", "Mài thiếu", ["University of Buffalo", "Ultra Boost"]),
    ("CF", "Color fastness", "Độ bền màu", ["CrossFit", "CompactFlash", "Carbon Fiber"]),
    ("TLM", "Thermal lasting machine", "Máy gò nhiệt", ["Telemetry", "Too Long Moved"]),
    ("CTQ", "Critical To Quality", "Điểm chất lượng then chốt", ["CTQ", "City of"]),
    ("ISQ", "In-Station Quality", "Chất lượng tại trạm", ["Information Systems Quality"]),
    ("IPQC", "In-Process Quality Control", "Kiểm soát chất lượng trên chuyền", ["IP Quality"]),
    ("EVA", "Ethylene-Vinyl Acetate (EVA)", "Vật liệu đế EVA", ["Eva", "Extravehicular"]),
    ("PU", "Polyurethane (PU)", "Nhựa PU", ["Public Unit", "Plutonium"]),
    ("TPU", "Thermoplastic Polyurethane (TPU)", "Nhựa TPU", ["Tensor Processing Unit"]),
]

#: Wrong expansions of acronyms.
ACRONYM_REPAIRS = [Rule(r"\boperating systems?\b", "Outsole"), Rule(r"\bwarner bro(?:ther)?s?\b", "Water-based cement"), Rule(r"\btensor processing units?\b", "TPU")]

# The program ---------------------------------------------------------------------------------------------------------

_SPACE = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def compiled(rule: Rule) -> re.Pattern:
    """The rule's pattern: classes and word borders are those of ASCII, white space is of any kind."""
    text, inside = [], False
    for part in re.split(r"(\\.|[\[\] ])", rule.pattern):
        inside = part == "[" or inside and part != "]"
        text.append((_SPACE if inside else f"[{_SPACE}]") if part == r"\s" else f"[{_SPACE}]+" if part == " " and not inside else part)
    return re.compile("".join(text), re.ASCII | (0 if rule.exact else re.IGNORECASE))


def needed(rule: Rule) -> str:
    """The longest word outside groups and classes that every match of the rule holds, in lower case; '' if none is sure."""
    plain = re.sub(r"\\[bsd]|\\.", " ", rule.pattern)
    while (less := re.sub(r"\((?:\?:)?[^()]*\)[*+?]*|\[[^\]]*\][*+?]*", " ", plain)) != plain:
        plain = less
    if "|" in plain or "(" in plain:
        return ""
    plain = re.sub(r".[*?]", " ", plain)
    return max(re.findall(r"[A-Za-z]+(?:-[A-Za-z]+)*", plain), key=len, default="").lower()


class Program:
    """Ordered rewrites with an automaton over the words that they need."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = [(compiled(r), r.to) for r in rules]
        words: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            words.setdefault(needed(r), []).append(i)
        self.always = words.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for word, numbers in words.items():
            self.automaton.add_word(word, numbers)
        self.automaton.make_automaton()
        self.some = bool(words)

    def able(self, text: str, after: int) -> list[int]:
        """Numbers of rules beyond after that may match, in order."""
        found = set(self.always)
        if self.some:
            for _, numbers in self.automaton.iter(text.lower()):
                found.update(numbers)
        return sorted(i for i in found if i > after)

    def run(self, text: str) -> tuple[str, list[int]]:
        """The rewritten text and the numbers of the rules that changed it."""
        fired: list[int] = []
        todo = self.able(text, -1)
        while todo:
            i = todo.pop(0)
            pattern, to = self.rules[i]
            new = pattern.sub(to, text)
            if new != text:
                text = new
                fired.append(i)
                todo = self.able(text, i)
        return text, fired


_START = re.compile(rf"(?:(?:^|\n)[{_SPACE}]*[*•\-#]*[{_SPACE}]*(?:[0-9]+[.)]|[a-zA-Z][.)])?[{_SPACE}]*[\"'(\[{{]*|[.!?][{_SPACE}]*[\"')\]}}]*[{_SPACE}]*|[:(\-][{_SPACE}]*)\Z")


class SmallTerms:
    """Writes terms small unless they begin a sentence, an item or what follows a colon."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in terms:
            self.automaton.add_word(t.lower(), len(t))
        self.automaton.make_automaton()

    def run(self, text: str) -> str:
        low = text.lower()
        if len(low) != len(text) or "ſ" in low:
            low = "".join(("s" if c == "ſ" else c.lower()) if len(c.lower()) == 1 else c for c in text)
        out, n = list(text), len(text)
        for last, size in self.automaton.iter(low):
            start = last - size + 1
            if start and text[start - 1].isalnum() or last + 1 < n and text[last + 1].isalnum():
                continue
            back = start  # what decides is no farther than one letter behind the last letters
            while back and not text[back - 1].isalpha():
                back -= 1
            if not _START.search(text, max(0, back - 2), start):
                out[start : last + 1] = low[start : last + 1]
        return "".join(out)


def polish(stage: str | None = None) -> tuple[Program, SmallTerms]:
    return Program(POLISH + STAGES.get((stage or "").lower(), []) + HYPHENS), SmallTerms(SMALL)


def polish_text(text: str | None, program: Program, small: SmallTerms | None) -> tuple[str | None, list[int]]:
    """(text in house style, rules that changed it); blank and null texts stay."""
    if not text or not text.strip():
        return text, []
    plain = re.sub(r"\s+", " ", re.sub("(?i)no-sew", "nosew", re.sub("(?i)tip-quarter", "tip quarter", re.sub("[.]$", "", text.strip())))).lower()
    if plain == WRONG_NOTE:
        text = RIGHT_NOTE + "." * text.strip().endswith(".")
    text, fired = program.run(text)
    return (small.run(text) if small else text), fired


def polished(units: DataFrame, text: str = "text", stage: str | None = None, rules: list[Rule] | None = None, casing: bool = True) -> DataFrame:
    """units with ``polished`` and ``fired`` (numbers of the rules that changed the text); rules: another program."""
    schema = T.StructType([*units.schema.fields, T.StructField("polished", T.StringType()), T.StructField("fired", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, small = polish(stage)
        program = program if rules is None else Program(rules)
        for b in batches:
            known: dict = {}
            for t in b.column(b.schema.names.index(text)).to_pylist():
                if t not in known:
                    known[t] = polish_text(t, program, small if casing else None)
            out = [known[t] for t in b.column(b.schema.names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32()))], [*b.schema.names, "polished", "fired"])

    return units.mapInArrow(run, schema)


_SENTENCE = re.compile(rf"([.!?][{_SPACE}]+)([^\W\d_])")
_ITEM = rf"[{_SPACE}]*[*•\-#]*[{_SPACE}]*(?:[0-9]+[.)]|[a-zA-Z][.)])?[{_SPACE}]*)([^\W\d_])"
_FIRST, _LATER = re.compile(f"({_ITEM}"), re.compile(rf"(\n{_ITEM}")


def capitals(text: str) -> str:
    """small letters at the start of sentences, lines and items as capitals."""
    raise_ = lambda m: m[1] + (m[2].upper() if m[2].islower() else m[2])
    text = _SENTENCE.sub(raise_, text)
    first = _FIRST.match(text)
    start, rest = (raise_(first), text[first.end() :]) if first else ("", text)
    return start + (_LATER.sub(raise_, rest) if "\n" in rest else rest)


def structured(units: DataFrame, text: str = "text") -> DataFrame:
    """units with ``structured``: punctuation, densities, noun order and hyphens mended, terms small, starts with capitals."""
    from . import language, terms

    mended = terms.hyphenated(terms.reordered(terms.stitch_density(language.punctuated(F.col(text)))))
    rows = units.withColumn("structured", mended)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = SmallTerms(SMALL)
        for b in batches:
            out = [None if t is None else capitals(small.run(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def acronym_notes(units: DataFrame, acronyms: list[tuple] | None = None, text: str = "text") -> DataFrame:
    """units with ``notes``: a line for each acronym that stands in the text as a word, in the table's order."""
    found = []
    for short, full, meaning, barred in acronyms or ACRONYMS:
        never = f" (NEVER translate to: {', '.join(f'"{b}"' for b in barred)})" if barred else ""
        here = F.col(text).rlike(rf"(?i)(?:^|[^A-Za-z0-9_]){re.escape(short)}(?:[^A-Za-z0-9_]|$)")
        found.append(F.when(here, f'- "{short}" refers to footwear "{full}" ({meaning}){never}'))
    return units.withColumn("notes", F.concat_ws("\n", *found))


def auto_repaired(units: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """units with ``repaired`` and ``repairs``: what enabled rules (``operators.rules.RULE``) prohibit, as patterns whose
    case does not count, becomes their replacement, rule by rule in the table's order of priority and id; what is no pattern is taken literally."""
    from ..operators.rules import MOST_PATTERNS

    rows = rules.where("enabled and replacement is not null").orderBy(F.desc("priority"), "id").limit(MOST_PATTERNS + 1).collect()
    flat = [(r["id"], p, r["replacement"]) for r in rows for p in r["prohibited"] or []]
    if len(rows) > MOST_PATTERNS or len(flat) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns")
    program = []
    for _, pattern, to in flat:
        try:
            re.compile(pattern)
            exact = False
        except re.error:
            pattern, exact = "".join(" " if c == " " else re.escape(c) for c in pattern), True
        program.append(Rule(pattern.replace(" ", "[ ]"), to.replace("\\", r"\\"), exact))
    out = polished(units, text, rules=program, casing=False)
    names = F.array(*(F.lit(f"{i}: {p}") for i, p, _ in flat)) if flat else F.array().cast("array<string>")
    return out.withColumn("repairs", F.transform("fired", lambda i: F.get(names, i))).withColumnRenamed("polished", "repaired").drop("fired")
