"""Small documents with the awkward cases that every operator must answer."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(9000))


def documents(spark, texts, extra=False):
    """texts: list of text or (doc_id, text); extra adds columns whose names operators use themselves."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCUMENTS).repartition(3)
    if extra:
        for name in ("n", "bucket", "term", "pos", "score", "length", "_row", "_salt", "_rank", "start", "phrase", "text_key", "win", "id", "spans", "item", "first", "label", "sig", "hash", "component_id", "u", "v", "value", "bytes", "digest", "key", "words", "k_doc", "k_key", "r", "bad_id", "bad_key", "row"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


AWKWARD = [None, "", " \n\t ", "a", "a", "...!!!", "12345", "x\x00y \x1c z", "Ünïcödé ſ K 漢字 🙂 İ", LONG, LONG, (7, "twice the same id"), (7, "twice the same id"), (None, "no id"), (None, None)]
