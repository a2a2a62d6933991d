"""Translation memory: lookup by exact and canonical key, fuzzy retrieval, conflicts, consistency."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: Priority of a memory entry's status, and of a match's origin.
STATUS_RANK = {"LOCKED": 5, "APPROVED": 4, "ESTABLISHED": 3, "SUGGESTED": 2, "CONFLICT": 1}
ORIGIN_RANK = {"approved": 5, "review": 4, "correction": 3, "presentation": 2, "history": 1}
#: Fixed value: characters of the longest compact form that is compared fuzzily.
LONGEST = 350


def rank_of(column: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), column), F.lit(0))


def plan(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Units (text) with their target from memory (source, target): by exact key, else by canonical key with the unit's prefix put back."""
    exact = memory.groupBy(T.exact_key(F.col("source")).alias("e_key")).agg(F.min("target").alias("e_target"))
    canonical = memory.groupBy(T.canonical_key(F.col("source")).alias("c_key")).agg(F.min("target").alias("c_target"))
    rows = units.withColumns({"e_key": T.exact_key(F.col("text")), "c_key": T.canonical_key(F.col("text"))}).join(exact, "e_key", "left").join(canonical, "c_key", "left")
    target = F.coalesce("e_target", F.concat(T.prefix(F.col("text")), "c_target"))
    how = F.when(F.col("e_target").isNotNull(), "exact").when(F.col("c_target").isNotNull(), "canonical").otherwise("pending")
    return rows.withColumns({"target": target, "how": how}).drop("e_target", "c_target", "e_key", "c_key")


def resolve(events: DataFrame) -> DataFrame:
    """W03, DML10, ST08: from (seq, source, target, status) per exact key the winner - highest status, then earliest - and its conflicts."""
    rows = events.withColumns({"key": T.exact_key(F.col("source")), "norm": T.exact_key(F.col("target")), "rank": rank_of(F.col("status"), STATUS_RANK)}).where("key <> '' and norm <> '' and key <> norm")
    order = F.struct(-F.col("rank"), F.col("seq"))
    best = rows.groupBy("key").agg(F.min_by(F.struct("target", "norm", "status", "seq"), order).alias("w"), F.count("*").alias("n"))
    lost = rows.join(best.select("key", "w"), "key").where("norm <> w.norm").groupBy("key").agg(F.count("*").alias("conflicts"))
    by = F.when(F.col("w.status") == "LOCKED", "LOCKED_GLOSSARY").when(F.col("w.status") == "APPROVED", "APPROVED_MEMORY").otherwise("EARLIEST")
    return best.join(lost, "key", "left").select("key", F.col("w.target").alias("target"), F.col("w.status").alias("status"), "n", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.when(F.col("conflicts") > 0, by).alias("resolved_by"))


def reuse(units: DataFrame) -> DataFrame:
    """The first slice: per unit (doc_id, line_no, text) whether an earlier line has its exact key."""
    keyed = units.withColumn("key", T.exact_key(F.col("text")))
    place = F.struct("doc_id", "line_no")
    first = keyed.groupBy("key").agg(F.min(place).alias("_first"))  # combined before the shuffle, so a common line meets in no task
    return keyed.join(first, "key").withColumn("status", F.when(place == F.col("_first"), "NEEDS_TRANSLATION").otherwise("TM_REUSE")).drop("_first")


def first_of(rows: DataFrame, key: str, order: str, most: int, salts: int = 16) -> DataFrame:
    """The first ``most`` rows of each key in order: chosen in salted groups, then among what those keep, so a hot key is dealt over tasks."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    kept = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(order))).where(F.col("_r") <= most)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= most).drop("_r", "_salt")


def consistency(pairs: DataFrame) -> DataFrame:
    """Sources with two or more normalised targets, their variants and the most frequent one."""
    variants = pairs.groupBy(T.normalised(F.col("source")).alias("source_key"), T.normalised(F.col("target")).alias("target_key")).agg(F.count("*").alias("n"))
    groups = variants.groupBy("source_key").agg(F.count("*").alias("variants"), F.sum("n").alias("occurrences"), F.min_by("target_key", F.struct(-F.col("n"), F.col("target_key"))).alias("preferred"))
    return groups.where("variants >= 2")


def grams_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram): distinct trigrams of the compact form."""
    return rows.select(key, F.explode(T.trigrams(T.compact(F.col(text)))).alias("gram"))


def exact_matches(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """J09's stage before the fuzzy one: (q, e, confidence) of (q, q_text) and (e, e_text) of the same compact form and the same numbers.

    Such texts differ by spaces, accents and punctuation only, so neither word counts nor contrast words part them, however short they are."""
    form = lambda c: F.struct(T.normalised(F.col(c)).alias("normalised"), T.folded(F.col(c)).alias("folded"), T.compact(F.col(c)).alias("compact"), F.array_join(T.numbers(F.col(c)), "|").alias("numbers"))
    q, e = queries.select("q", form("q_text").alias("qf")), entries.select("e", form("e_text").alias("ef"))
    same = q.join(e, (F.col("qf.compact") == F.col("ef.compact")) & (F.col("qf.numbers") == F.col("ef.numbers")))
    confidence = F.when(F.col("qf.normalised") == F.col("ef.normalised"), 0.99).when(F.col("qf.folded") == F.col("ef.folded"), 0.97).when(F.length("qf.compact") >= 8, 0.96).otherwise(0.92)
    return same.select("q", "e", confidence.alias("confidence"))


def fuzzy_matches(queries: DataFrame, entries: DataFrame, threshold: float = 0.78, postings: int | None = None, candidates: int | None = None, most: int = 1 << 20) -> DataFrame:
    """For (q, q_text) the entries (e, e_text) of guarded similarity at least threshold, which is above 0.

    Entries of the same compact form match; queries of several words without one get all entries that are similar enough: those
    of as many words, the same numbers and the same contrast words are found by what a similar text must share, and compared.
    ``postings`` and ``candidates``, bounds of the reference's index, are taken and drop nothing.
    Up to ``most`` trigrams of entries are shipped as an index and every query is looked up where it stands; more are joined.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    e = entries.select("e", T.forms(F.col("e_text")).alias("ef"))
    posting = e.select(F.explode(T.trigrams(F.col("ef.compact"))))
    if max(posting.limit(most + 1).count(), entries.limit(most + 1).count()) <= most:
        pairs = _looked_up(queries, e, threshold).select("q", "e", T.forms(F.col("q_text")).alias("qf")).join(F.broadcast(e), "e")
    else:
        pairs = _joined(queries.select("q", T.forms(F.col("q_text")).alias("qf")), e, threshold)
    return pairs.withColumn("confidence", T.similarity(F.col("qf"), F.col("ef"))).where(F.col("confidence") >= threshold).select("q", "e", "confidence")


def _joined(q: DataFrame, e: DataFrame, threshold: float) -> DataFrame:
    """(q, e, qf, ef): candidates of ``fuzzy_matches`` by joins. A similar text has half of a text's words, and so one of any so many
    of them, the rarest; or it has less, so that its edits are few, and it has one of the rarest trigrams, of which an edit changes
    at most three. Where there are too few trigrams, all entries of as many words, the same numbers and contrast words are met."""
    kept = ["folded", "numbers"]
    fuzzy = lambda f: (F.size(f"{f}.tokens") > 1) & (F.length(f"{f}.compact") <= LONGEST)
    same = q.join(e, F.col("qf.compact") == F.col("ef.compact")).select("q", "e", "qf", "ef")
    known = e.select(F.col("ef.compact").alias("k")).distinct()
    rest = q.where(fuzzy("qf")).join(known, F.col("qf.compact") == F.col("k"), "left_anti")
    item = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    group = lambda f: [F.size(f"{f}.tokens").alias("n"), F.col(f"{f}.numbers").alias("numbers"), F.col(f"{f}.contrast").alias("contrast")]
    every = F.array(F.lit(""))
    there = e.where(fuzzy("ef")).select("e", *group("ef"), F.explode(F.concat(item(0, F.array_distinct("ef.tokens")), item(1, T.trigrams(F.col("ef.compact"))), item(2, every))).alias("x")).select("e", "n", "numbers", "contrast", "x.*")
    frequency = there.groupBy("kind", "item").agg(F.count("*").alias("df"))

    texts = rest.select(F.col("qf.folded").alias("folded"), *group("qf"), F.col("qf.tokens").alias("tokens"), F.col("qf.compact").alias("compact")).dropDuplicates(kept).withColumn("grams", T.trigrams(F.col("compact")))
    half = F.floor((F.col("n") + 1) / 2)
    share = 1 - (threshold - T.WORDS * (half - 1) / F.col("n")) / T.EDITS
    size = F.length("compact")
    edits = F.when(share >= 1, LONGEST).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(share * LONGEST, share * size / (1 - share))) + 1e-6))
    texts = texts.withColumns({"words": F.col("n") - half + 1, "edits": edits})
    wide = (F.col("edits") > 0) & (3 * F.col("edits") >= F.size("grams"))
    items = F.concat(item(0, F.col("tokens")), F.when(wide, item(2, every)).when(F.col("edits") > 0, item(1, F.col("grams"))).otherwise(F.array().cast("array<struct<kind:int,item:string>>")))
    wanted = texts.withColumn("bound", F.array("words", 3 * F.col("edits") + 1, F.lit(1))).select(*kept, "n", "contrast", "bound", F.explode(items).alias("x")).select(*kept, "n", "contrast", "bound", "x.*").join(frequency, ["kind", "item"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    wanted = wanted.withColumn("r", F.row_number().over(Window.partitionBy(*kept, "kind").orderBy("df", "item"))).where(F.col("r") <= F.get("bound", F.col("kind"))).where("df > 0")
    near = wanted.join(there, ["n", "numbers", "contrast", "kind", "item"]).select(*kept, "e").distinct()
    near = near.join(rest.select("q", "qf", F.col("qf.folded").alias("folded"), F.col("qf.numbers").alias("numbers")), kept).join(e, "e").select("q", "e", "qf", "ef")
    return same.unionByName(near)


def _looked_up(queries: DataFrame, e: DataFrame, threshold: float) -> DataFrame:
    """(q, q_text, e): candidates of ``fuzzy_matches``, without those that counts of words, numbers, contrast words, lengths,
    shared words or shared trigrams keep below the threshold: an edit changes at most three trigrams."""
    index = e.select("e", "ef.compact", "ef.tokens", "ef.numbers", "ef.contrast").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(index)
    schema = StructType([queries.schema["q"], queries.schema["q_text"], e.schema["e"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        texts, words, numbers, contrasts = (index.column(c).to_pylist() for c in ("compact", "tokens", "numbers", "contrast"))
        lengths = [len(t) for t in texts]
        parts = [{t[j : j + 3] for j in range(len(t) - 2)} if len(t) <= LONGEST else None for t in texts]
        known: dict = {}
        groups: dict = {}  # entries of as many words, the same numbers and the same contrast words: their lengths, they, those that hold a word
        for i in sorted(range(len(texts)), key=lengths.__getitem__):
            known.setdefault(texts[i], []).append(i)
            if lengths[i] <= LONGEST:
                sizes, every, by_word = groups.setdefault((len(words[i]), numbers[i], contrasts[i]), ([], [], {}))
                sizes.append(lengths[i])
                every.append(i)
                for w in set(words[i]):
                    by_word.setdefault(w, []).append(i)
        alike = {key[:2] for key in groups}
        rare = 1 - threshold / T.EDITS  # edits of texts without common words, as a share of the longer one

        def near(folded: str, own: str) -> list[int]:
            text = folded.replace(" ", "")
            if text in known:
                return known[text]
            tokens = [t for t in folded.split(" ") if t]
            size, n = len(text), len(tokens)
            if n < 2 or size > LONGEST or (n, own) not in alike:
                return []
            group = groups.get((n, own, "|".join(sorted(t for t in tokens if t in T.CONTRAST))))
            if group is None:
                return []
            sizes, every, by_word = group
            hits: dict = {}
            for t in tokens:
                for i in by_word.get(t, ()):
                    hits[i] = hits.get(i, 0) + 1
            edits = LONGEST if rare >= 1 else max(0.0, min(rare * LONGEST, rare * size / (1 - rare))) + 1e-6
            if edits >= 1:
                for i in every[bisect.bisect_left(sizes, size - edits) : bisect.bisect_right(sizes, size + edits)]:
                    hits.setdefault(i, 0)
            each, out, grams = T.WORDS / T.EDITS / n, [], None
            for i, k in hits.items():
                length = lengths[i]
                edits = (size if size > length else length) * (rare + each * k) + 1e-6
                if edits >= 1 and -edits <= size - length <= edits:
                    grams = {text[j : j + 3] for j in range(size - 2)} if grams is None else grams
                    if len(grams - parts[i]) <= 3 * edits:
                        out.append(i)
            return out

        def paired(b: pa.RecordBatch, rows: list[int], entries: list[int]) -> pa.RecordBatch:
            there = index.column("e").take(pa.array(entries)).combine_chunks()
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), there], ["q", "q_text", "e"])

        for b in batches:
            done: dict = {}
            rows, entries = [], []
            for n, key in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if key not in done:
                    done[key] = near(*key)
                for start in range(0, len(done[key]), 1 << 16):
                    part = done[key][start : start + (1 << 16)]
                    rows += [n] * len(part)
                    entries += part
                    if len(rows) >= 1 << 16:
                        yield paired(b, rows, entries)
                        rows, entries = [], []
            if rows:
                yield paired(b, rows, entries)

    return queries.select("q", "q_text", T.folded(F.col("q_text")).alias("folded"), F.array_join(T.numbers(F.col("q_text")), "|").alias("numbers")).mapInArrow(run, schema)


def choose(matches: DataFrame, margin: float = 0.06, reuse_from: float = 0.94, rows: int = 1 << 20) -> DataFrame:
    """Of (q, origin, target, confidence, exact, words) the preferred match within the margin; conflict if equal or better origins differ in target.

    Matches are dealt over as many tasks as give each some ``rows``, and sorted by q once for all steps."""
    tasks = max(matches.sparkSession.sparkContext.defaultParallelism, matches.count() // rows + 1)
    m = matches.withColumn("rank", rank_of(F.col("origin"), ORIGIN_RANK)).repartition(tasks, "q").withColumn("top", F.max("confidence").over(Window.partitionBy("q")))
    near = m.where(F.col("top") - F.col("confidence") < margin).withColumn("best", F.max("rank").over(Window.partitionBy("q")))
    order = F.struct(-F.col("rank"), -F.col("confidence"), F.col("target"))
    rival = F.when(F.col("rank") >= F.col("best"), T.normalised(F.col("target")))
    out = near.groupBy("q").agg(F.min_by(F.struct("target", "origin", "confidence", "exact", "words"), order).alias("m"), F.min(rival).alias("least"), F.max(rival).alias("most"))
    conflict = F.coalesce(F.col("least") != F.col("most"), F.lit(False))
    single = (F.col("m.words") == 1) & ~F.col("m.origin").isin("approved", "correction")
    safe = ~conflict & ~single & F.col("m.exact") & (F.col("m.confidence") >= reuse_from) & (F.col("m.origin") != "history")
    return out.select("q", F.col("m.target").alias("target"), F.col("m.origin").alias("origin"), F.col("m.confidence").alias("confidence"), conflict.alias("conflict"), safe.alias("safe"))


def sentences_known(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Units (unit_id, text) all of whose sentences are approved (memory: sentence); n of them."""
    keys = memory.select(T.exact_key(F.col("sentence")).alias("key")).distinct()
    parts = units.select("unit_id", F.explode(F.split("text", r"\. ")).alias("sentence")).where(F.trim("sentence") != "").withColumn("key", T.exact_key(F.col("sentence")))
    known = parts.join(keys.withColumn("known", F.lit(1)), "key", "left")
    return known.groupBy("unit_id").agg(F.count("*").alias("sentences"), F.count("known").alias("found")).where("found > 0").withColumn("complete", F.col("found") == F.col("sentences"))


def style_examples(texts: DataFrame, examples: DataFrame, k: int = 2, least: float = 0.3, rows: int = 100_000) -> DataFrame:
    """For (q, q_text) the k examples (e, e_text) of highest word overlap coefficient.

    Pairs come from the words they share, so texts without common words never meet.
    """
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("word"))
    size = lambda df, key, text, name: df.select(key, F.size(F.array_distinct(T.tokens(F.col(text)))).alias(name))
    inner = words(examples, "e", "e_text")
    inner = F.broadcast(inner) if inner.limit(rows + 1).count() <= rows else inner
    shared = words(texts, "q", "q_text").join(inner, "word").groupBy("q", "e").agg(F.count("*").alias("shared"))
    scored = shared.join(size(texts, "q", "q_text", "nq"), "q").join(size(examples, "e", "e_text", "ne"), "e").withColumn("overlap", F.col("shared") / F.least("nq", "ne"))
    best = Window.partitionBy("q").orderBy(F.desc("overlap"), "e")
    return scored.where(F.col("overlap") >= least).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "e", "overlap", "r")


def search_segments(pairs: DataFrame, query: str, limit: int) -> DataFrame:
    """FIL04: the first segments in order whose source or target holds the query."""
    hit = F.lower("source").contains(query.lower()) | F.lower("target").contains(query.lower())
    return pairs.where(hit).orderBy("conv_id", "turn").limit(limit)


def history(*origins: tuple[str, DataFrame]) -> DataFrame:
    """All (source, target) of several origins, each once per origin."""
    out = None
    for name, df in origins:
        rows = df.select("source", "target").withColumn("origin", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["source", "target", "origin"])
