"""Operators whose semantics are sequential: formulas and damaged JSON answers, row by row in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REFERENCE = re.compile(r"((?:'(?:[^']|'')+'|[^\W\d][\w.]*)!)?(\$?)([A-Za-z]{1,3})(\$?\d+)?")
_FIELDS = ("translatedText", "text", "translation", "targetText", "translated", "en")


def _number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def references(formula: str):
    """Pieces of a formula: (text, None), or for a reference (text, (sheet with its mark, own sheet or None, $, letters, row)). Strings, functions and brackets are plain pieces; the second end of a range has its first end's sheet."""
    i, sheet = 0, None
    while i < len(formula):
        c, end = formula[i], i + 1
        if c == '"':
            while end < len(formula) and not (formula[end] == '"' and formula[end + 1 : end + 2] != '"'):
                end += 2 if formula[end] == '"' else 1
            yield formula[i : end + 1], None
            i, sheet = end + 1, None
            continue
        before = formula[i - 1] if i else ""
        m = None if before and (before.isalnum() or before in "_.") else _REFERENCE.match(formula, i)
        if m:
            after = formula[m.end() :]
            whole_column = not m[4] and (after.startswith(":") or before == ":")
            if (m[4] or whole_column) and not re.match(r"[\w.\[]|\s*\(", after):
                own = m[1][:-1].strip("'").replace("''", "'") if m[1] else sheet if before == ":" else None
                yield m[0], (m[1] or "", own, m[2], m[3], m[4] or "")
                sheet = own if after.startswith(":") else None
                i = m.end()
                continue
        if c == "[":
            depth = 1
            while end < len(formula) and depth:
                depth += {"[": 1, "]": -1}.get(formula[end], 0)
                end += 1
        yield formula[i:end], None
        if formula[end - 1] != ":":
            sheet = None
        i = end


def shift_columns(formula: str | None, first: int, by: int = 1, own_sheet: str | None = None, shifted_sheet: str | None = None) -> str | None:
    """references to columns from ``first`` (1 is A) moved right; other sheets' references stay. With both sheets named, those to the shifted sheet move."""
    if not formula:
        return formula
    out = []
    for text, ref in references(formula):
        if ref:
            mark, sheet, dollar, letters, row = ref
            applies = (sheet or own_sheet or "").lower() == shifted_sheet.lower() if shifted_sheet else sheet is None
            n = _number(letters)
            text = mark + dollar + (_letters(n + by) if applies and n >= first else letters) + row
        out.append(text)
    return "".join(out)


def rename_sheets(formula: str | None, names: dict[str, str]) -> str | None:
    """sheets of references renamed, whatever their case; the new name is quoted."""
    if not formula:
        return formula
    new, out = {k.lower(): v for k, v in names.items()}, []
    for text, ref in references(formula):
        if ref and ref[0] and ref[1] is not None and ref[1].lower() in new:
            quoted = new[ref[1].lower()].replace("'", "''")
            text = f"'{quoted}'!" + "".join(ref[2:])
        out.append(text)
    return "".join(out)


def objects(raw: str) -> list[dict]:
    """the objects of an answer: an array, a wrapped array, either in a code fence or cut off; else every whole object in the text."""
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", raw)
    decoder = json.JSONDecoder()
    try:
        found = decoder.decode(text.strip())
    except ValueError:
        found = None
    if isinstance(found, dict):
        found = next((v for v in found.values() if isinstance(v, list)), [found])
    if isinstance(found, list):
        return [x for x in found if isinstance(x, dict)]
    out, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            lists = [v for v in value.values() if isinstance(v, list)]
            out += [x for v in lists for x in v if isinstance(x, dict)] if lists and "id" not in value else [value]
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return out


def answers(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """(batch, id, text) of the answers that belong to expected (batch, id): the first of each id with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("id", pa.string()), ("text", pa.string()), ("pos", pa.int64())])
        for b in batches:
            rows = []
            for batch, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for pos, x in enumerate(objects(raw or "")):
                    text = next((x[f] for f in _FIELDS if x.get(f) is not None), None)
                    if isinstance(text, str) and text.strip():
                        rows.append({"batch": batch, "id": str(x.get("id", "")).strip(), "text": text.strip(), "pos": pos})
            yield pa.RecordBatch.from_pylist(rows, schema)

    parsed = responses.select(F.col("batch").cast("long").alias("batch"), "raw").mapInArrow(run, "batch long, id string, text string, pos long")
    valid = parsed.join(expected.select("batch", "id"), ["batch", "id"], "left_semi")
    return valid.groupBy("batch", "id").agg(F.min_by("text", "pos").alias("text"))


def shifted(formulas: DataFrame, key: str, first: int, by: int = 1) -> DataFrame:
    """F34 over a table (key, formula)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shift_columns(f, first, by) for f in b.column(1).to_pylist()], pa.string())], [key, "formula"])

    return formulas.select(F.col(key).cast("long").alias(key), "formula").mapInArrow(run, f"{key} long, formula string")
