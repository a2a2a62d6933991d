"""Tables of a folder, and views of them in the shape of the engine's collections.

units: lines of documents; terms: parts as glossary rows; pairs: a user's turn and the answer;
log: events as audit records; memory: benchmark texts as approved sentences; runs: text runs of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables and derived collections, for SQL."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for view in (units, terms, pairs, log, memory, runs):
        view(spark, sf_dir).createOrReplaceTempView(view.__name__)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text, lang): non-blank lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.where(F.trim("text") != "").select("doc_id", "line_no", "text", "lang")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary rows; statuses, directions and times follow from the key."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.col("p_name").alias("source_term"),
        F.col("p_type").alias("target_term"),
        F.when(k % 3 == 0, "vi").otherwise("en").alias("source_lang"),
        F.when(k % 3 == 0, "en").otherwise("vi").alias("target_lang"),
        F.when(k % 5 == 0, "review").when(k % 5 == 1, "quarantined").otherwise("approved").alias("status"),
        F.col("p_size").alias("priority"),
        F.col("p_brand").alias("category"),
        F.when(k % 7 == 0, "Auto-Harvester").otherwise("user").alias("created_by"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(k % 30).cast("int"))).alias("updated_at"),
        (F.col("p_retailprice") / 1000).alias("confidence"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, source, target): each user turn with the answer that follows it at once."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(order)).withColumn("target", F.lead("text").over(order))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), "target")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records: operation, user, duration, details as a map."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("operation"), F.col("value").alias("duration"), F.from_json("props", "map<string,string>").alias("details"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, sentence_no, sentence): approved sentences, cut at full stops."""
    cut = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("sentence_no", "sentence"))
    return cut.where(F.trim("sentence") != "")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, run_no, tag, text): paragraph and list item texts of pages in order."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(<(?:p|li)>[^<]*)<"), 1)).alias("run_no", "run"))
    return found.select("page_id", "run_no", F.regexp_extract("run", "^<(p|li)>", 1).alias("tag"), F.regexp_replace("run", "^<(p|li)>", "").alias("text"))
