"""Readers and writers of files: signatures, session logs, dispatch by format, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 25 MB, as uploads are limited.
LARGEST = 25 << 20
#: First bytes by file kind.
SIGNATURES = {"pdf": "25504446", "docx": "504B0304", "pptx": "504B0304", "xlsx": "504B0304", "xls": "D0CF11E0"}
SESSION = "session_id string, file_name string, created_at string, slides array<struct<slide_index:int,title:string,pairs:array<struct<id:string,source:string,target:string>>>>"


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def signature(content: Column, name: Column) -> Column:
    """SRC01, SRC02: the kind of a file by extension and first bytes; null: refused."""
    head = F.hex(F.substring(content, 1, 4))
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.lit(False)
    for kind, first in SIGNATURES.items():
        known = known | ((extension == kind) & (head == first))
    return F.when((F.octet_length(content) <= LARGEST) & (known | extension.isin("csv", "txt")), extension)


def documents(files: DataFrame) -> DataFrame:
    """SRC06: text files as sections, cut at form feeds and blank line triples."""
    text = F.decode("content", "utf-8")
    parts = files.where(F.col("path").rlike(r"\.(txt|csv)$")).select("path", F.posexplode(F.split(text, "\f|\n\\s*\n\\s*\n")).alias("section", "text"))
    return parts.where("trim(text) <> ''")


def sessions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC16: session logs, a JSON document per file (or per line), as (session_id, slide_index, pos, source, target)."""
    rows = spark.read.schema(SESSION).option("multiLine", str(not lines).lower()).json(path)
    slides = rows.select("session_id", "file_name", F.explode("slides").alias("s"))
    return slides.select("session_id", "file_name", "s.slide_index", F.posexplode("s.pairs").alias("pos", "p")).select("session_id", "file_name", "slide_index", "pos", "p.source", "p.target")


def write_sessions(pairs: DataFrame, path: str) -> None:
    """SNK04: (session_id, file_name, slide_index, pos, source, target) nested by session and slide; image-like strings are left out. A session per line."""
    clean = pairs.where("source not like 'data:image%'")
    slides = clean.groupBy("session_id", "file_name", "slide_index").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("pos").cast("string").alias("id"), "source", "target"))).alias("p"))
    slides = slides.select("session_id", "file_name", F.struct("slide_index", F.lit("").alias("title"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["target"].alias("target"))).alias("pairs")).alias("slide"))
    slides.groupBy("session_id", "file_name").agg(F.sort_array(F.collect_list("slide")).alias("slides")).write.mode("overwrite").json(path)


def apply_changes(before: DataFrame, changes: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """SNK01, SNK02: the table that a change set (key, op) makes of its old version, rows of inserts and updates from after."""
    gone = changes.where("op in ('delete', 'update')").select(key)
    new = after.join(changes.where("op in ('insert', 'update')").select(key), key, "left_semi")
    return before.join(gone, key, "left_anti").unionByName(new)


def text_runs(xml: Column, tag: str = "a:t") -> Column:
    """SRC05, SRC10: text runs of a slide's XML in order."""
    return F.regexp_extract_all(xml, F.lit(f"<{tag}(?:\\s[^>]*)?>([^<]*)</{tag}>"), 1)


def header_roles(rows: DataFrame, key: str) -> DataFrame:
    """SRC03, SRC17: (key, col, role) of header cells (row 0: col, text) by keyword, else by position."""
    t = F.lower(F.trim("text"))
    role = F.when(t.rlike("english|^en$|source"), "source").when(t.rlike("viet|^vi$|target"), "target").when(t.rlike("definition|meaning"), "definition").when(t.rlike("context|note"), "context")
    found = rows.withColumn("role", role)
    any_ = F.count("role").over(Window.partitionBy(key)) > 0
    place = F.when(F.col("col") == 0, "source").when(F.col("col") == 1, "target")
    return found.withColumn("role", F.when(any_, F.col("role")).otherwise(place)).select(key, "col", "role")
