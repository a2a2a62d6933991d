"""Queries of the house style of work instructions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import sop
from ..operators import rules as R
from . import base as B

QUERIES, ORACLES = {}, {}

#: What lines of the tables get before or behind them, so that rules meet them.
PHRASES = [
    "Check with real temp 75-80°C of hot mold, time 20s, pressure 3-4kg", "Conduct cementing and carry out inspection", "The operator must use scissors to trim", "Verify that upper must match with BPM", "Check with logo must be clean", "IPQC Inspection Focuses: inspection focuses here",
    "minimize the thread expose", "9-10 SPI on Tipquarter", "nosew Finished Shoe", "verify the Outsole", "Check machine have is to run", "f press vamp/F upper and f press", "operating systems and Warner Bros", "Verify if if margin mudguard", "BOM sight with be at center of Heel", "no phrase",
    "Check component vamp after BPM", "O/S and TPU, EVA (CTQ)", "the tip quarter was Nosew", "Check whether Collar Lining must fit",
]


def styled(s, d):
    """(doc_id, line_no, text): whole lines with a phrase."""
    n = F.pmod(F.col("doc_id") * 7 + F.col("line_no"), F.lit(len(PHRASES))).cast("int")
    phrase = F.get(F.array(*map(F.lit, PHRASES)), n)
    return catalog.units(s, d).select("doc_id", "line_no", F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", phrase, "text")).otherwise(F.concat_ws(" ", "text", phrase)).alias("text"))


_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
STYLED = f"""styled AS (SELECT doc_id, line_no, CASE WHEN doc_id % 2 = 0 THEN p || ' ' || text ELSE text || ' ' || p END AS text
  FROM (SELECT *, {_LIST}[CAST((doc_id * 7 + line_no) % {len(PHRASES)} AS INTEGER) + 1] AS p FROM units))"""


def _replaced(column: str, rules: list[sop.Rule]) -> str:
    for r in rules:
        pattern = r.pattern.replace(" ", r"\s+").replace("'", "''")
        column = f"regexp_replace({column}, '{pattern}', '{r.to.replace(chr(39), chr(39) * 2)}', '{'g' if r.exact else 'gi'}')"
    return column


# every rule in order, by another engine of patterns and without the automaton
QUERIES["f14_polish"] = lambda s, d: sop.polished(styled(s, d), stage="stitching", casing=False).select("doc_id", "line_no", F.md5("polished").alias("polished"))
ORACLES["f14_polish"] = B.with_(B.UNITS, STYLED) + f"SELECT doc_id, line_no, md5({_replaced('text', sop.POLISH + sop.STAGES['stitching'] + sop.HYPHENS)}) AS polished FROM styled"

QUERIES["f14_polish_and_casing"] = lambda s, d: sop.polished(styled(s, d)).select("doc_id", "line_no", "polished", F.size("fired").alias("fired"))
QUERIES["f11_structure"] = lambda s, d: sop.structured(styled(s, d)).select("doc_id", "line_no", "structured")

QUERIES["f15_acronym_repair"] = lambda s, d: sop.polished(styled(s, d), rules=sop.ACRONYM_REPAIRS, casing=False).select("doc_id", "line_no", F.md5("polished").alias("repaired"), F.size("fired").alias("fired"))
ORACLES["f15_acronym_repair"] = B.with_(B.UNITS, STYLED) + rf"""SELECT doc_id, line_no, md5(t3) AS repaired, CAST((t1 <> text)::INT + (t2 <> t1)::INT + (t3 <> t2)::INT AS INTEGER) AS fired FROM (
  SELECT *, regexp_replace(t2, '\btensor\s+processing\s+units?\b', 'TPU', 'gi') AS t3 FROM (SELECT *, regexp_replace(t1, '\bwarner\s+bro(?:ther)?s?\b', 'Water-based cement', 'gi') AS t2 FROM (SELECT *, regexp_replace(text, '\boperating\s+systems?\b', 'Outsole', 'gi') AS t1 FROM styled)))"""

QUERIES["f15_acronym_notes"] = lambda s, d: sop.acronym_notes(styled(s, d)).where("notes <> ''").select("doc_id", "line_no", F.size(F.split("notes", "\n")).alias("notes"), F.md5("notes").alias("digest"))
ORACLES["f15_acronym_notes"] = B.with_(B.UNITS, STYLED) + """SELECT doc_id, line_no, CAST(len(n) AS INTEGER) AS notes, md5(array_to_string(n, chr(10))) AS digest FROM (SELECT doc_id, line_no, list_filter([""" + ",\n".join(
    f"""CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){short}([^A-Za-z0-9_]|$)') THEN '{note}' END""" for short, note in [
        ("O/S", '- "O/S" refers to footwear "Outsole" (Đế ngoài) (NEVER translate to: "Operating System", "Open Source", "OS")'), ("M/S", '- "M/S" refers to footwear "Midsole" (Đế trung) (NEVER translate to: "Microsoft", "MS", "Milliseconds")'),
        ("BTM", '- "BTM" refers to footwear "Bottom" (Cụm đế) (NEVER translate to: "Bitcoin", "ATM", "Bathroom")'), ("WB", '- "WB" refers to footwear "Water-based cement" (Keo gốc nước) (NEVER translate to: "Warner Bros", "Warner Brothers", "World Bank")'),
        ("HFW", '- "HFW" refers to footwear "High-Frequency Welding" (Ép cao tần) (NEVER translate to: "Heavy Forged Weapon", "Hardware")'), ("OB", '- "OB" refers to footwear "Over buffing" (Mài cao / Mài quá mức) (NEVER translate to: "Obstetrics", "Out of Bounds")'),
        ("UB", '- "UB" refers to footwear "Under buffing" (Mài thiếu) (NEVER translate to: "University of Buffalo", "Ultra Boost")'), ("CF", '- "CF" refers to footwear "Color fastness" (Độ bền màu) (NEVER translate to: "CrossFit", "CompactFlash", "Carbon Fiber")'),
        ("TLM", '- "TLM" refers to footwear "Thermal lasting machine" (Máy gò nhiệt) (NEVER translate to: "Telemetry", "Too Long Moved")'), ("CTQ", '- "CTQ" refers to footwear "Critical To Quality" (Điểm chất lượng then chốt) (NEVER translate to: "CTQ", "City of")'),
        ("ISQ", '- "ISQ" refers to footwear "In-Station Quality" (Chất lượng tại trạm) (NEVER translate to: "Information Systems Quality")'), ("IPQC", '- "IPQC" refers to footwear "In-Process Quality Control" (Kiểm soát chất lượng trên chuyền) (NEVER translate to: "IP Quality")'),
        ("EVA", '- "EVA" refers to footwear "Ethylene-Vinyl Acetate (EVA)" (Vật liệu đế EVA) (NEVER translate to: "Eva", "Extravehicular")'), ("PU", '- "PU" refers to footwear "Polyurethane (PU)" (Nhựa PU) (NEVER translate to: "Public Unit", "Plutonium")'),
        ("TPU", '- "TPU" refers to footwear "Thermoplastic Polyurethane (TPU)" (Nhựa TPU) (NEVER translate to: "Tensor Processing Unit")'),
    ]
) + "], lambda x: x IS NOT NULL) AS n FROM styled) WHERE len(n) > 0"

#: Rules of words that the tables' lines hold.
REPAIRS = [
    ("a", "articles", "style", ["the"], [r"\bof the\b", "the of"], "of that", True, 5), ("b", "german", "style", ["und"], [r"\bund die\b"], "und jene", True, 9), ("c", "off", "style", ["de"], ["de la"], "du", False, 7),
    ("d", "no pattern", "style", ["("], ["[the ("], "-", True, 3), ("e", "later", "style", ["that"], ["of that"], "of these", True, 1), ("f", "nothing", "style", ["a"], None, "x", True, 2),
]
QUERIES["f17_auto_repair"] = lambda s, d: sop.auto_repaired(catalog.units(s, d), R.table(s, REPAIRS)).select("doc_id", "line_no", F.md5("repaired").alias("repaired"), F.size("repairs").alias("repairs"))
ORACLES["f17_auto_repair"] = B.with_(B.UNITS) + r"""SELECT doc_id, line_no, md5(t4) AS repaired, CAST((t1 <> text)::INT + (t2 <> t1)::INT + (t3 <> t2)::INT + (t4 <> t3)::INT AS INTEGER) AS repairs FROM (
  SELECT *, regexp_replace(t3, 'of that', 'of these', 'gi') AS t4 FROM (SELECT *, regexp_replace(t2, 'the of', 'of that', 'gi') AS t3 FROM (SELECT *, regexp_replace(t1, '\bof the\b', 'of that', 'gi') AS t2 FROM (SELECT *, regexp_replace(text, '\bund die\b', 'und jene', 'gi') AS t1 FROM units))))"""
