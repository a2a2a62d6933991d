"""Benchmark decontamination through a distributed positional inverted index.

Only built-in expressions run on executors. The plan:

1. ``item_windows`` cuts every test item into windows.
2. ``positional_index`` tokenises the training texts once and stores, where they lie, postings
   (term, document, position) of every term that a window holds, and one of ``END`` behind each text.
3. ``query_windows`` orders each window's terms by their postings' number, rarest first.
4. ``intersected`` adjusts the list of a window's second rarest term by the two terms' distance and keeps the
   postings of the rarest term that it holds, too. ``phrase_matches`` compares the whole window where both meet.
5. ``proximity_matches`` merges the same two lists by position and finds where they come near each other.

Windows that share their two rarest terms at one distance share an intersection. What is shuffled are postings
of rare terms, by document and position, so a hot term meets in no task; the test side is broadcast only while
its counted rows stay under ``BROADCAST_ROWS`` (the same joins shuffle above that), and so are the documents in
which lists meet.

Edge cases: null or empty text has no words and no hits; items that are null, empty or without an id are
ignored; repeated documents (same id and text) each get a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ascii_lower, cut, stored, text_key

WINDOW = 13
#: Test-side rows (a term with its window, a few hundred bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Words between a window's two rarest terms, at most, for a proximity match.
NEAR = 13
#: The term behind a text's last word; its position is the text's number of words.
END = ""
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is proven small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(phrase, win, item_id): each distinct window of each item; a shorter item is one window."""
    w = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return (
        w.select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), width).alias("win"))
        .select(F.concat_ws(" ", "win").alias("phrase"), "win", "item_id")
        .distinct()
    )


def positional_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, text_key, pos): postings of the given distinct terms, and of END for every row."""
    w = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w"))
    tokens = w.select("doc_id", "text_key", F.posexplode("w").alias("pos", "term"))
    end = documents.sparkSession.range(1).select(F.lit(END).alias("term"))
    return tokens.join(_bounded(terms.select("term").union(end)), "term", "left_semi").select("term", "doc_id", "text_key", "pos")


def term_frequencies(index: DataFrame) -> DataFrame:
    """(term, cf): how often each term occurs."""
    return index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("cf"))


def query_windows(windows: DataFrame, cf: DataFrame) -> DataFrame:
    """(phrase, win, term, off, term2, off2): the two rarest terms of each window all of whose terms occur."""
    terms = windows.select("phrase", "win").distinct().select("phrase", "win", F.posexplode("win").alias("off", "term"))
    ranked = (
        terms.join(_bounded(cf), "term", "left")
        .groupBy("phrase")
        .agg(F.first("win").alias("win"), F.sort_array(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "off", "term"))).alias("by"))  # a window's few terms
        .where("by[0].cf > 0")
    )
    second = F.when(F.size("by") > 1, F.col("by")[1])
    return ranked.select("phrase", "win", F.expr("by[0].term as term"), F.expr("by[0].off as off"), second["term"].alias("term2"), second["off"].alias("off2"))


def _second_lists(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc2, key2, pos2, other): postings of the second rarest terms."""
    terms = pairs.where("term2 is not null").select(F.col("term2").alias("term")).distinct()
    return index.join(_bounded(terms), "term", "left_semi").select(F.col("doc_id").alias("doc2"), F.col("text_key").alias("key2"), F.col("pos").alias("pos2"), F.col("term").alias("other"))


def intersected(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, term, term2, delta): postings of rarest terms that have the second rarest one delta words on; all of windows of one word."""
    pairs = cut(queries.select("term", "term2", (F.col("off2") - F.col("off")).alias("delta")).distinct())
    first = index.join(_bounded(pairs), "term").select("doc_id", "text_key", "pos", "term", "term2", "delta").distinct()
    on = F.expr("doc_id <=> doc2 and text_key = key2 and term2 = other and pos + delta = pos2")
    return first.where("term2 is not null").join(_second_lists(index, pairs), on, "left_semi").union(first.where("term2 is null"))


def phrase_matches(documents: DataFrame, anchors: DataFrame, queries: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, phrase, start, end): each occurrence of each window; start in words from 0, end exclusive."""
    key = ["doc_id", "text_key"]
    docs = documents.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    there = anchors.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
    same = F.expr("doc_id <=> _doc_id and text_key = _text_key")
    docs = docs.join(_bounded(there), same, "left_semi").select(*key, words(F.col("text")).alias("w"))
    lists = anchors.groupBy(*(F.col(c).alias(f"_{c}") for c in key)).agg(F.collect_list(F.struct("pos", "term", "term2", "delta")).alias("at"))  # no longer than the text
    first = lambda x: F.greatest(x["pos"] - (width - 1), F.lit(0))
    around = lambda x: F.struct(*(x[c].alias(c) for c in ("pos", "term", "term2", "delta")), first(x).alias("ctx_from"), F.slice("w", first(x) + 1, F.lit(2 * width)).alias("ctx"))
    met = docs.join(lists, same).select(*key, F.explode(F.transform("at", around)).alias("x")).select(*key, "x.*")
    asked = queries.select("phrase", "win", "off", F.col("term").alias("q"), F.col("term2").alias("q2"), (F.col("off2") - F.col("off")).alias("q_delta"))
    return (
        met.join(_bounded(asked), F.expr("term = q and term2 <=> q2 and delta <=> q_delta"))
        .withColumn("start", F.col("pos") - F.col("off"))
        .where("start >= 0")
        .where(F.expr("slice(ctx, start - ctx_from + 1, size(win)) = win"))
        .select(*key, "phrase", "start", (F.col("start") + F.size("win")).alias("end"))
    )


def proximity_matches(index: DataFrame, queries: DataFrame, within: int = NEAR) -> DataFrame:
    """(doc_id, text_key, term, term2, distance): where a window's two rarest terms stand at most ``within`` words apart, in any order, the least distance."""
    pairs = cut(queries.where("term2 is not null").select("term", "term2").distinct())
    columns = ["doc_id", "text_key", "pos", "term", "term2"]
    one = index.join(_bounded(pairs), "term").select(*columns, F.lit(True).alias("rarest"))
    two = index.withColumnRenamed("term", "term2").join(_bounded(pairs.where("term <> term2")), "term2").select(*columns, F.lit(False).alias("rarest"))
    before = Window.partitionBy("doc_id", "text_key", "term", "term2").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda flag: F.last(F.when(F.col("rarest") == flag, F.col("pos")), ignorenulls=True).over(before)
    merged = one.union(two).distinct().withColumn("distance", F.col("pos") - F.when(F.col("rarest") & (F.col("term") != F.col("term2")), past(False)).otherwise(past(True)))
    return merged.where(F.col("distance") <= within).groupBy("doc_id", "text_key", "term", "term2").agg(F.min("distance").alias("distance"))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, near: int | None = None) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and text_key; with near also n_near, the number of items with a proximity match."""
    windows = cut(item_windows(benchmark, width))
    index = stored(positional_index(documents, windows.select(F.explode("win").alias("term")).distinct()), "postings")
    queries = cut(query_windows(windows, cut(term_frequencies(index))))
    # of the whole index only the lists of the windows' two rarest terms are read again, and the texts' ends
    wanted = queries.select("term").union(queries.where("term2 is not null").select("term2")).union(windows.sparkSession.range(1).select(F.lit(END))).distinct()
    index = stored(index.join(_bounded(cut(wanted)), "term", "left_semi"), "lists")
    found = stored(phrase_matches(documents, cut(intersected(index, queries)), queries, width), "phrases")

    key = ["doc_id", "text_key"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.select(*key, "start", "end")
        .distinct()
        .withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy(*key)
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("n_hit"))
    )
    items = (
        found.select(*key, "phrase")
        .distinct()
        .join(_bounded(windows.select("phrase", "item_id")), "phrase")
        .select(*key, F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy(*key)
        .agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256"))
    )
    hits = covered.join(items, (covered.doc_id.eqNullSafe(items.doc_id)) & (covered.text_key == items.text_key)).select(covered.doc_id.alias("hit_id"), covered.text_key.alias("hit_key"), "n_hit", "n_items", "items_sha256")
    docs = index.where(F.col("term") == END).select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    out = docs.join(hits, (docs.doc_id.eqNullSafe(hits.hit_id)) & (docs.text_key == hits.hit_key), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    more = []
    if near is not None:
        asked = queries.join(_bounded(windows.select("phrase", "item_id")), "phrase").select(F.col("term").alias("q"), F.col("term2").alias("q2"), "item_id").distinct()
        close = proximity_matches(index, queries, near).join(_bounded(cut(asked)), F.expr("term = q and term2 = q2"))
        close = close.groupBy(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key")).agg(F.countDistinct("item_id").alias("n_near"))
        out = out.join(close, F.expr("doc_id <=> near_id and text_key = near_key"), "left")
        more = [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")]
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        *more,
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """documents, with their columns, without the contaminated ones."""
    bad = cut(contamination(documents, benchmark, width).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct())
    on = documents["doc_id"].eqNullSafe(bad["bad_id"]) & (text_key(documents["text"]) == bad["bad_key"])
    return documents.join(_bounded(bad), on, "left_anti")
