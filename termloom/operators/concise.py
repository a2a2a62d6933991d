"""Concise instructions: what a text's rewriting must keep, whether it may be shortened, and whether it kept it.

All are Column expressions over a text. Null texts hold no entities and are too short to shorten.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.predicates import EDGE

#: Patterns of measurements, of ranges of stitch densities, of listed items, and of conditions.
MEASUREMENT = rf"(?i){EDGE}(\d+(?:[.,]\d+)?\s*(?:mm|cm|m|s|sec|seconds?|°C|°F|kg(?:/cm(?:²|2)?)?|%|inch|in{EDGE}))"
RANGE = rf"(?iu){EDGE}(?:SPI\s*)?(\d+)\s*[-–]\s*(\d+)\s*(?:stitches?/inch|mũi/inch|SPI|mũi)?"
LISTED = rf"(?iu)([,;]\s*(?:không\s+)?[a-z{T.MARKED}\s]{{3,25}}(?=[,;]))"
CONDITION = rf"(?iu)({EDGE}(?:nếu|trong trường hợp|khi|nhưng|ngoại trừ|chấp nhận|tolera|accept){EDGE})"
#: Points of complexity for each measurement, range, defect, listed item, standard and condition.
POINTS = {"measurement": 10, "range": 5, "defect": 15, "listed": 20, "standard": 8, "condition": 12}
#: Shortest text and shortest worth shortening; complexity and defects from which a text is kept; acceptance clauses.
SHORT, WORTH, COMPLEX, MANY_DEFECTS = 30, 80, 65, 3
ACCEPTANCE = r"(?iu)chấp nhận mức độ|tiêu chuẩn chấp nhận|accept.*QA"


def _entity(kind: str, value: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), key.alias("key"))


def _distinct(items: Column) -> Column:
    """The first of each key."""
    keys = F.transform(items, lambda x: x["key"])
    return F.filter(items, lambda x, i: F.array_position(keys, x["key"]) == i + 1)


def _named(low: Column, kind: str, names: list[str]) -> Column:
    return F.filter(F.array(*(F.when(low.contains(n), _entity(kind, F.lit(n), F.lit(n))) for n in names)), lambda x: x.isNotNull())


def entities(text: Column) -> Column:
    """Array of (type, value, key): measurements, ranges, components, defects and standards, each key once."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    found = lambda p, kind, key: _distinct(F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda v: _entity(kind, v, key(v))))
    measures = found(MEASUREMENT, "measurement", lambda v: F.lower(F.regexp_replace(v, r"\s+", "")))
    ends = F.zip_with(F.regexp_extract_all(text, F.lit(RANGE), 1), F.regexp_extract_all(text, F.lit(RANGE), 2), lambda a, b: F.concat_ws("-", a, b))
    ranges = _distinct(F.transform(ends, lambda v: _entity("range", v, v)))
    components = _named(low, "component", list(dict.fromkeys([*V.COMPONENTS_VI, *V.COMPONENTS_EN])))
    defects = _named(low, "defect", V.DEFECTS)
    standards = F.flatten(F.array(*(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)({EDGE}{p}{EDGE})"), 1), lambda v: _entity("standard", v, F.lower(F.regexp_replace(v, r"[\s-]", "")))) for p in V.STANDARDS)))
    return F.concat(measures, ranges, components, defects, _distinct(standards))


def complexity(text: Column, found: Column) -> Column:
    """Points of a text with its entities, at most 100."""
    text = F.coalesce(text, F.lit(""))
    n = lambda kind: F.size(F.filter(found, lambda x: x["type"] == kind)) * POINTS[kind]
    m = lambda p, kind: F.size(F.regexp_extract_all(text, F.lit(p), 1)) * POINTS[kind]
    return F.least(F.lit(100), n("measurement") + n("range") + n("defect") + n("standard") + m(LISTED, "listed") + m(CONDITION, "condition"))


def eligibility(text: Column, found: Column) -> Column:
    """FIL26: "eligible", or why a text is not to be shortened."""
    t = T.squeeze(F.coalesce(text, F.lit("")))
    defects = F.size(F.filter(found, lambda x: x["type"] == "defect"))
    return (
        F.when(F.length(t) < SHORT, "too short").when(complexity(text, found) >= COMPLEX, "complex").when(defects >= MANY_DEFECTS, "defect list")
        .when(t.rlike(ACCEPTANCE), "acceptance clause").when(F.length(t) < WORTH, "short enough").otherwise("eligible")
    )


def missing(target: Column, found: Column) -> Column:
    """Entities that a translation does not hold: numbers of measures, ranges in any writing, English names of parts and defects, standards."""
    low = T.squeeze(F.lower(F.coalesce(target, F.lit(""))))
    table = lambda names: F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, "|".join(v))))
    any_of = lambda names, key: F.coalesce(low.rlike("$^") if not names else F.exists(F.split(F.element_at(table(names), key), r"\|"), lambda p: low.contains(p)), F.lit(False))

    def kept(x: Column) -> Column:
        key, low_end, high_end = x["key"], F.split(x["key"], "-")[0], F.element_at(F.split(x["key"], "-"), -1)
        between = lambda mark: low.contains(F.concat(low_end, F.lit(mark), high_end))
        return (
            F.when(x["type"] == "measurement", low.contains(F.regexp_extract(x["value"], r"\d+(?:[.,]\d+)?", 0)))
            .when(x["type"] == "range", between("-") | between(" - ") | between(" to "))
            .when(x["type"] == "component", any_of(V.COMPONENTS_AS_EN, key) | low.contains(key))
            .when(x["type"] == "defect", any_of(V.DEFECTS_EN, key))
            .otherwise(low.contains(key) | low.contains(F.lower(x["value"])))
        )

    return F.filter(found, lambda x: ~kept(x))


def coverage(found: Column, lost: Column) -> Column:
    """Per cent of the entities that are kept, halves up; 100 without any."""
    return F.when(F.size(found) == 0, 100).otherwise(T.half_up((F.size(found) - F.size(lost)) * 100.0 / F.size(found))).cast("int")


def rolls_back(lost: Column) -> Column:
    """Whether the full translation is to be used: something other than a component is lost."""
    return F.exists(lost, lambda x: x["type"] != "component")


def must_keep(found: Column, most: int = 12) -> Column:
    """the first entities as a prompt lists them."""
    line = lambda x: (
        F.when(x["type"] == "measurement", F.concat(F.lit('"'), x["value"], F.lit('" (exact number+unit)'))).when(x["type"] == "range", F.concat(F.lit('SPI range "'), x["key"], F.lit('" stitches/inch')))
        .when(x["type"] == "component", F.concat(F.lit('component "'), x["value"], F.lit('"'))).when(x["type"] == "defect", F.concat(F.lit('defect term for "'), x["value"], F.lit('"')))
        .otherwise(F.concat(F.lit('standard "'), x["value"], F.lit('"')))
    )
    return F.array_join(F.transform(F.slice(found, 1, most), line), ", ")
