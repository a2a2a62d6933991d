import math
import re

from pyspark.sql import functions as F
from termloom.llm import language

from .cases import AWKWARD, documents


def fitted(spark, sf="sf0.01"):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    return docs, language.fit(docs.where(language.remainder(F.col("doc_id"), 4) != 2))


def test_held_out_accuracy(spark):
    docs, model = fitted(spark)
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language.remainder(F.col("doc_id"), 4) == 2)
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_scores_do_not_depend_on_neighbours(spark):
    docs, model = fitted(spark)
    texts = [r.text for r in docs.limit(40).collect()] + ["", "é", "..."]
    letters = language._Letters()
    names, scores = language.score(model, texts, letters)
    for t, name, s in zip(texts, names, scores):
        (alone,), (p,) = language.score(model, [t], letters)
        assert (alone, p) == (name, s)


def test_brute_force(spark):
    """The same model computed naively, text by text, gives the same sums."""
    _, model = fitted(spark)
    letters, text = language._Letters(), "Ça va, the ÜBER-größe 42 años"
    plain = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", text.lower())
    plain = "  " + re.sub(" +", " ", plain) + "  "
    starts, grams, n = language.hashed_grams([text], letters)
    assert n[0] == sum(c.isalpha() for c in text.lower()) and len(grams[0]) == len(plain) - 2 and starts[0] == 0
    by_gram = {}
    for k in range(3):
        for i, h in enumerate(grams[k].tolist()):
            assert by_gram.setdefault((k, plain[i : i + k + 1]), h) == h


def plain_buckets(text):
    """Buckets of a text's 1- to 3-grams, gram by gram."""
    out, run, low = [], "  ", text.lower()
    for i, c in enumerate(low):
        if c.isalpha():
            run += c
        elif i and low[i - 1].isalpha():  # other characters after a letter are one boundary
            run += " "
    run += "  "
    for k in range(1, 4):
        for i in range(len(run) - 2):
            m = 0
            for j, c in enumerate(run[i : i + k]):
                m = ((m ^ ord(c)) * 2654435761 + j + 1) % (1 << 32)
            out.append((m ^ m >> 15) * 2246822519 % (1 << 32) >> 17)
    return out


def test_naive_bayes_by_hand(spark):
    """Counts, log probabilities, posteriors and labels computed gram by gram."""
    rows = [(1, "the cat sat", "en"), (2, "The dog! 12 ran", "en"), (3, "el gato", "es"), (4, "", "es"), (5, "perro", "es"), (6, None, "es"), (7, "x", None), (5, "perro", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as part", "'x' as n", "'x' as bucket")
    model = language.fit(df)
    counts, docs = {}, {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] = docs.get(lang, 0) + 1
            for b in plain_buckets(text):
                counts.setdefault(lang, {}).setdefault(b, 0)
                counts[lang][b] += 1
    size = 1 << 15
    def expected(text):
        sums = {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + 0.5 * size
            sums[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang].get(b, 0) + 0.5) / total) for b in plain_buckets(text))
        best = max(sorted(sums), key=sums.get)
        return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())

    texts = ["the rat", "gatos y perros", "Zz", "cat el"]
    for r in language.predict(documents(spark, texts), model).collect():
        lang, p = expected(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - p) < 1e-4


def test_ties_and_rare_languages(spark):
    same = [(1, "abc", "b"), (2, "abc", "a")]
    model = language.fit(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    (r,) = language.predict(documents(spark, ["abc"]), model).collect()
    assert r.lang_pred == "a" and r.score == 0.5
    # one row among thousands is learned under a small sample
    many = [(i, "the house and the garden", "en") for i in range(3000)] + [(9999, "proszę bardzo dziękuję wszystko zawsze szczęście " * 8, "pl")]
    model = language.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), sample_rows=100)
    assert model.languages == ["en", "pl"]
    assert [r.lang_pred for r in language.predict(documents(spark, ["proszę wszystko dziękuję zawsze szczęście"]), model).collect()] == ["pl"]


def test_awkward(spark):
    _, model = fitted(spark)
    df = documents(spark, AWKWARD, extra=True)
    rows = language.predict(df, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    unknown = sum(t is None or not any(c.isalpha() for c in t) for t in [x[1] if isinstance(x, tuple) else x for x in AWKWARD])
    assert sum(r.lang_pred == "und" for r in rows) == unknown
    kept = language.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(AWKWARD) - unknown
    empty = language.fit(df)
    assert {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"}
    assert language.predict(documents(spark, []), model).collect() == []
