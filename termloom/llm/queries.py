"""Registered queries of the corpus operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, embeddings, jaccard, language, language_model, licenses, packing, secrets, sharding, suffixes, warc, whitening
from .common import table


#: Shards of the sharding query.
SHARDS = [f"shard-{k:02d}" for k in range(48)]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.all_templates(), inside=True))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, index = warc.archive_and_index(pages)
    return warc.find_captures(spark, index, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language.remainder(F.col("doc_id"), 7) == 2
    model, counts = language_model.train(documents.where(~held_out))
    return language_model.scores(documents, model, counts).withColumn("held_out", held_out)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language.remainder(F.col("doc_id"), 4) == 2
    model = language.fit(documents.where(~held_out))
    return language.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=decontamination.NEAR)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    fits = whitening.fit(embeddings)
    return whitening.whiten(embeddings, fits, whitening.identity_error(embeddings, fits))


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summary(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_language_model": op5_language_model,
    "op6_jaccard": op6_jaccard,
    "op7_language": op7_language,
    "op8_embeddings": op8_embeddings,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_suffixes": op12_suffixes,
    "op13_alignment": op13_alignment,
}
