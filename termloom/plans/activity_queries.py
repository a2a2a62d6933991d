"""Queries of logs, quality rules, harvesting and sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions import predicates as P
from ..functions import text as T
from ..operators import activity as V
from ..operators import glossary as G
from ..operators import quality as Q
from ..operators import rules as R
from . import base as B
from . import language_queries as LQ

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = (B.with_(*ctes) if ctes else "") + sql


log, units, pairs = catalog.log, catalog.units, catalog.pairs
uid = lambda: (F.col("doc_id") * 10_000 + F.col("line_no")).alias("unit_id")
DAY = 86_400

# --- logs
add("w08_sliding_count", lambda s, d: V.sliding_count(log(s, d), "user_id", DAY).select("id", "n"), "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM log", B.LOG)
add("st01_rate_threshold", lambda s, d: V.sliding_count(log(s, d), "user_id", DAY).groupBy("user_id").agg(F.max("n").alias("peak"), F.count_if(F.col("n") > 5).alias("over")), "SELECT user_id, max(n) AS peak, count(*) FILTER (n > 5) AS over FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM log) GROUP BY user_id", B.LOG)
#: Each user's events one after another: the times of at most three admitted ones are carried on.
ADMITTED = """numbered AS (SELECT user_id, id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM log),
admitted AS (
  SELECT user_id, id, n, [t] AS times, TRUE AS ok FROM numbered WHERE n = 1
  UNION ALL
  SELECT user_id, id, n, CASE WHEN len(open) < 3 THEN list_append(open, t) ELSE open END, len(open) < 3
  FROM (SELECT e.*, list_filter(a.times, lambda x: e.t - x < 86400000000) AS open FROM admitted a JOIN numbered e ON e.user_id = a.user_id AND e.n = a.n + 1)
)"""
add("w09_admission", lambda s, d: V.admitted(log(s, d), "user_id", 3, DAY), "WITH RECURSIVE " + B.LOG + ",\n" + ADMITTED + "\nSELECT user_id, id, ok FROM admitted")
add("st04_identifier_limit", lambda s, d: V.admitted(log(s, d), "user_id", 3, DAY).groupBy("user_id").agg(F.count_if("ok").alias("admitted"), F.count_if(~F.col("ok")).alias("refused")), "WITH RECURSIVE " + B.LOG + ",\n" + ADMITTED + "\nSELECT user_id, count(*) FILTER (ok) AS admitted, count(*) FILTER (NOT ok) AS refused FROM admitted GROUP BY user_id")
add("st02_daily_quota", lambda s, d: V.daily_quota(log(s, d), "user_id", 5), "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, greatest(0, 5 - count(*)) AS \"left\", CAST(floor(100 * greatest(0, 5 - count(*)) / 5 + 0.5) AS INTEGER) AS percent, count(*) >= 5 AS exhausted FROM log GROUP BY 1, 2", B.LOG)
add("a23_quota_percent", lambda s, d: V.daily_quota(log(s, d), "user_id", 7).groupBy("percent").agg(F.count("*").alias("days")), "SELECT CAST(floor(100 * greatest(0, 7 - u) / 7 + 0.5) AS INTEGER) AS percent, count(*) AS days FROM (SELECT count(*) AS u FROM log GROUP BY user_id, CAST(ts AS DATE)) GROUP BY 1", B.LOG)
add("st03_circuit_breaker", lambda s, d: V.breaker(log(s, d).withColumn("ok", F.col("operation") != "error"), "user_id", 2, DAY).select("user_id", "id", "state"), "WITH RECURSIVE " + B.LOG + """,
numbered AS (SELECT user_id, id, epoch_us(ts) AS t, operation <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM log),
met AS (
  SELECT user_id, id, n, CASE WHEN ok THEN 0 ELSE 1 END AS bad, CAST(NULL AS BIGINT) AS until, 'CLOSED' AS state FROM numbered WHERE n = 1
  UNION ALL
  SELECT user_id, id, n, CASE WHEN state = 'OPEN' THEN bad WHEN ok THEN 0 ELSE bad + 1 END, CASE WHEN state = 'OPEN' THEN until WHEN ok THEN NULL WHEN state = 'HALF_OPEN' OR bad + 1 >= 2 THEN t + 86400000000 ELSE until END, state
  FROM (SELECT e.*, m.bad, m.until, CASE WHEN m.until IS NOT NULL AND e.t < m.until THEN 'OPEN' WHEN m.until IS NULL THEN 'CLOSED' ELSE 'HALF_OPEN' END AS state FROM met m JOIN numbered e ON e.user_id = m.user_id AND e.n = m.n + 1)
)
SELECT user_id, id, state FROM met""")
add("w12_newest_logs", lambda s, d: V.newest(log(s, d), 1000, [F.desc("ts"), F.desc("id")]).select("id", "operation"), "SELECT id, operation FROM log ORDER BY ts DESC, id DESC LIMIT 1000", B.LOG)
add("w12_newest_per_user", lambda s, d: V.newest(log(s, d), 20, [F.desc("ts"), F.desc("id")], ["user_id"]).select("user_id", "id"), "SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM log) WHERE r <= 20", B.LOG)
add("snk13_debug_ring", lambda s, d: V.newest(log(s, d), 100, [F.desc("ts"), F.desc("id")]).agg(F.count("*").alias("kept"), F.count_if(F.col("operation") == "error").alias("errors")), "SELECT count(*) AS kept, count(*) FILTER (operation = 'error') AS errors FROM (SELECT * FROM log ORDER BY ts DESC, id DESC LIMIT 100)", B.LOG)
add("st07_latest_wins", lambda s, d: V.latest(log(s, d).select("user_id", "id", "ts", "operation"), "user_id", ["ts", "id"]).select("user_id", "id", "operation"), "SELECT user_id, id, operation FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM log) WHERE r = 1", B.LOG)
add("w05_zones", lambda s, d: V.zones(log(s, d), "user_id", "operation"), "SELECT user_id, zone, operation, count(*) AS n, min(id) AS first_id FROM (SELECT *, CAST(sum(CASE WHEN p = operation THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, id) AS BIGINT) AS zone FROM (SELECT *, lag(operation) OVER (PARTITION BY user_id ORDER BY ts, id) AS p FROM log)) GROUP BY 1, 2, 3", B.LOG)
add("w07_seen_so_far", lambda s, d: V.seen_so_far(log(s, d), "user_id", F.col("operation") == "purchase").select("id", "seen", "after_last"), "SELECT id, coalesce(max(f) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen, r > coalesce(max(CASE WHEN f = 1 THEN r END) OVER (PARTITION BY user_id), 0) AS after_last FROM (SELECT *, CASE WHEN operation = 'purchase' THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS r FROM log)", B.LOG)
add("w04_neighbour_tests", lambda s, d: log(s, d).withColumn("gap", F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "id"))), F.lit(-1))).select("id", "gap"), "SELECT id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id)), -1) AS gap FROM log", B.LOG)
add("a15_error_metrics", lambda s, d: log(s, d).groupBy("operation").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 2).alias("duration")), "SELECT operation, count(*) AS n, round(sum(duration), 2) AS duration FROM log GROUP BY operation", B.LOG)
add("fil30_pruned_details", lambda s, d: log(s, d).select("id", F.size(F.map_filter("details", lambda k, v: ~k.isin("password", "k"))).alias("kept"), F.element_at("details", "k").alias("k")), "SELECT id, CAST(0 AS INTEGER) AS kept, json_extract_string(props, '$.k') AS k FROM log", B.LOG)
add("src14_log_scan", lambda s, d: log(s, d).orderBy(F.desc("ts"), F.desc("id")).limit(1000).select("id", "user_id", F.element_at("details", "k").cast("int").alias("k")), "SELECT id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM log ORDER BY ts DESC, id DESC LIMIT 1000", B.LOG)
add("st09_batches", lambda s, d: V.batches(units(s, d).select("doc_id", "line_no"), ["doc_id", "line_no"]).groupBy("batch").agg(F.count("*").alias("n")), "SELECT CAST(CASE WHEN r < e THEN r // 25 ELSE e // 25 + (r - e) // 15 END AS BIGINT) AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r, CAST(ceil(floor(count(*) OVER () * 0.7) / 25) * 25 AS BIGINT) AS e FROM units) GROUP BY 1", B.UNITS)
add("f36_time_with_fallback", lambda s, d: log(s, d).select("id", F.coalesce(F.when(F.col("id") % 3 == 0, F.col("ts")), F.when(F.col("id") % 3 == 1, F.to_timestamp(F.lit("2024-01-05"))), F.lit("1970-01-01").cast("timestamp")).alias("t")), "SELECT id, CASE id % 3 WHEN 0 THEN ts WHEN 1 THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '1970-01-01' END AS t FROM log", B.LOG)
add("a13_hit_ratio", lambda s, d: log(s, d).agg(F.round(F.count_if(F.col("operation") == "view") / F.count("*"), 3).alias("ratio")), "SELECT round(count(*) FILTER (operation = 'view') / count(*)::DOUBLE, 3) AS ratio FROM log", B.LOG)

# --- quality
PAIR_CASES = [("Set 12.5 mm and 98% at https://x.org, mail a@b.org, ISO", "Set 12,5 mm and 98 %"), ("3.14 API", "3,14"), ("Check 5 mm", "Check"), ("no numbers", "none")]
quality_pairs = lambda s, d: pairs(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("p"), "source", "target").union(s.createDataFrame([(-i - 1, a, b) for i, (a, b) in enumerate(PAIR_CASES)], "p long, source string, target string"))
QUALITY = "qp AS (SELECT conv_id * 100 + turn AS p, source, target FROM pairs UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIR_CASES)) + ") v)"
_sw = "CASE WHEN contains(x, '.') THEN regexp_replace(x, '\\.', ',') ELSE regexp_replace(x, ',', '.') END"
_raw = "trim(replace(x, '%', ''))"
_rawsw = _sw.replace("(x,", f"({_raw},")
_lost = " + ".join(rf"CASE WHEN regexp_matches(source, '(?i)\b{a}\b') AND NOT regexp_matches(target, '(?i)\b{a}\b') THEN 1 ELSE 0 END" for a in Q.KEPT)
add(
    "a08_quality_score",
    lambda s, d: quality_pairs(s, d).withColumns(Q.qa(F.col("source"), F.col("target"))).drop("source", "target"),
    rf"""SELECT p, CAST(n AS INTEGER) AS missing_numbers, CAST(c AS INTEGER) AS missing_percentages, CAST(u AS INTEGER) AS missing_urls, CAST(m AS INTEGER) AS missing_emails, CAST(a AS INTEGER) AS missing_acronyms,
      CAST(score AS INTEGER) AS score, u + m = 0 AND score >= 80 AS passed
    FROM (SELECT *, CASE WHEN checks > 0 THEN greatest(0, floor(100 - (n + c + u + m + a) * (100 / greatest(checks, 4)::DOUBLE) + 0.5)) ELSE 100 END AS score FROM (
      SELECT p, len(list_filter(nums, lambda x: NOT contains(target, x) AND NOT contains(target, {_sw}))) AS n,
        len(list_filter(pcts, lambda x: NOT contains(target, x) AND NOT contains(target, {_raw} || '%') AND NOT contains(target, {_raw} || ' %') AND NOT contains(target, {_rawsw} || '%') AND NOT contains(target, {_rawsw} || ' %'))) AS c,
        len(list_filter(urls, lambda x: NOT contains(target, x))) AS u, len(list_filter(mails, lambda x: NOT contains(target, x))) AS m, {_lost} AS a,
        len(nums) + len(pcts) + len(urls) + len(mails) + {_lost} AS checks
      FROM (SELECT *, list_distinct(regexp_extract_all(source, '\b\d+(?:[.,]\d+)?\b')) AS nums, list_distinct(regexp_extract_all(source, '\b\d+(?:[.,]\d+)?\s*%')) AS pcts,
        list_distinct(regexp_extract_all(source, 'https?://\S+')) AS urls, list_distinct(regexp_extract_all(source, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}')) AS mails FROM qp)))""",
    B.PAIRS, QUALITY,
)
deck = lambda s, d: pairs(s, d).select((F.col("conv_id") % 40).alias("deck"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("*Buffing: "), "source")).otherwise(F.col("source")).alias("source"), F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("*Buffing: shape toe "), "target")).when(F.col("conv_id") % 9 == 1, F.concat(F.lit("10 spi "), "target")).otherwise(F.col("target")).alias("target"))
DECK = "deck AS (SELECT conv_id % 40 AS deck, CASE WHEN turn % 4 = 0 THEN '*Buffing: ' || source ELSE source END AS source, CASE conv_id % 9 WHEN 0 THEN '*Buffing: shape toe ' || target WHEN 1 THEN '10 spi ' || target ELSE target END AS target FROM pairs)"
add(
    "a07_compliance_score",
    lambda s, d: Q.compliance(deck(s, d), "deck").select("deck", "paragraphs", "leaks", "densities", "nouns", "headings", "kept_headings", "score", "grade"),
    rf"""SELECT *, CASE WHEN score >= 98 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' ELSE 'C' END AS grade FROM (
      SELECT *, CAST(floor(greatest(0, 100 - leaks * 25) * 0.4 + greatest(0, 100 - densities * 20) * 0.2 + greatest(0, 100 - nouns * 20) * 0.2 + CASE WHEN headings = 0 THEN 100 ELSE floor(kept_headings / headings * 100 + 0.5) END * 0.2 + 0.5) AS INTEGER) AS score FROM (
        SELECT deck, count(*) AS paragraphs, count(*) FILTER (trim(target) <> '' AND regexp_matches(target, '[{B.MARKED}{B.MARKED.upper()}]')) AS leaks, count(*) FILTER (regexp_matches(target, '(?i)\b\d+\s*spi\b')) AS densities,
          count(*) FILTER (regexp_matches(target, '(?i)\bshape\s+(tip|toe|collar|heel)\b')) AS nouns, count(*) FILTER (regexp_matches(trim(source), '^\s*\*[\w\s/\-]+:')) AS headings,
          count(*) FILTER (regexp_matches(trim(source), '^\s*\*[\w\s/\-]+:') AND regexp_matches(trim(target), '^\s*\*[\w\s/\-]+:')) AS kept_headings FROM deck GROUP BY deck))""",
    B.PAIRS, DECK,
)
add("u06_missing_numbers", lambda s, d: pairs(s, d).select("conv_id", "turn", F.size(F.array_except(T.numbers(F.col("source")), T.numbers(F.col("target")))).alias("missing")), r"SELECT conv_id, turn, CAST(len(list_distinct(list_filter(regexp_extract_all(source, '\d+(?:[.,]\d+)*'), lambda x: NOT list_contains(regexp_extract_all(target, '\d+(?:[.,]\d+)*'), x)))) AS INTEGER) AS missing FROM pairs", B.PAIRS)
add("u07_shared_words", lambda s, d: pairs(s, d).select("conv_id", "turn", F.size(F.array_intersect(T.tokens(F.col("source")), T.tokens(F.col("target")))).alias("shared")), f"SELECT conv_id, turn, CAST(len(list_intersect(list_distinct({B.tokens('source')}), list_distinct({B.tokens('target')}))) AS INTEGER) AS shared FROM pairs", B.PAIRS)
add("fil20_needs_recovery", lambda s, d: quality_pairs(s, d).select("p", P.needs_recovery(F.col("source"), F.when(F.col("p") % 5 == 0, F.col("source")).when(F.col("p") % 7 == 0, F.lit(" ")).otherwise(F.col("target"))).alias("again")), f"SELECT p, trim(t) = '' OR {B.exact('source')} = {B.exact('t')} OR regexp_matches(t, '[{B.MARKED}{B.MARKED.upper()}]') AS again FROM (SELECT *, CASE WHEN p % 5 = 0 THEN source WHEN p % 7 = 0 THEN ' ' ELSE target END AS t FROM qp)", B.PAIRS, QUALITY)
classified, CLASSIFIED = LQ.classified, LQ.CLASSIFIED
add("a01_status_histogram", lambda s, d: Q.status_histogram(classified(s, d)), "SELECT status, count(*) AS n, CAST(CASE WHEN status = 'NEEDS_TRANSLATION' THEN ceil(count(*) / 25) ELSE 0 END AS BIGINT) AS batches FROM classified GROUP BY status", B.UNITS, *CLASSIFIED)
add("a04_issue_buckets", lambda s, d: Q.buckets(classified(s, d).select("status", "key", (F.length("key") / 100).alias("confidence"), (F.col("doc_id") % 2 == 0).alias("safe"))), "SELECT status, key, count(*) AS n, min(length(key) / 100.0) AS confidence, bool_and(doc_id % 2 = 0) AS safe FROM classified GROUP BY 1, 2 HAVING count(*) > 1", B.UNITS, *CLASSIFIED)
add("a21_affected_documents", lambda s, d: classified(s, d).where("status = 'REVIEW_REQUIRED'").groupBy("status").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first")), "SELECT status, count(DISTINCT doc_id) AS documents, min(doc_id) AS first FROM classified WHERE status = 'REVIEW_REQUIRED' GROUP BY status", B.UNITS, *CLASSIFIED)
add("l05_group_order", lambda s, d: Q.buckets(classified(s, d).select("status", "key", (F.length("key") / 100).alias("confidence"), (F.col("doc_id") % 2 == 0).alias("safe"))).orderBy("safe", F.desc("confidence"), "status", "key").limit(30).select("status", "key", "n"), "SELECT status, key, count(*) AS n FROM classified GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY bool_and(doc_id % 2 = 0), min(length(key)) DESC, status, key LIMIT 30", B.UNITS, *CLASSIFIED)
add("a11_deck_statistics", lambda s, d: Q.deck_statistics(units(s, d), "doc_id").select("doc_id", "lines", "words", "chars", "title"), r"SELECT doc_id, count(*) AS lines, CAST(sum(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, substr(arg_min(trim(text), line_no), 1, 80) AS title FROM units GROUP BY doc_id", B.UNITS)
add("a12_slide_roll_up", lambda s, d: classified(s, d).groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if(F.col("status").isin("NEEDS_TRANSLATION", "REVIEW_REQUIRED")).alias("needs"), F.min_by("status", "line_no").alias("first")), "SELECT doc_id, count(*) AS units, count(*) FILTER (status IN ('NEEDS_TRANSLATION', 'REVIEW_REQUIRED')) AS needs, arg_min(status, line_no) AS first FROM classified GROUP BY doc_id", B.UNITS, *CLASSIFIED)
add("a14_pairs_by_session", lambda s, d: pairs(s, d).groupBy("conv_id").agg(F.count("*").alias("pairs")), "SELECT conv_id, count(*) AS pairs FROM pairs GROUP BY conv_id", B.PAIRS)
add("a16_column_profile", lambda s, d: units(s, d).where("line_no < 20").groupBy("doc_id").agg(F.count_if(P.has_marks(F.col("text"))).alias("marked"), F.count_if(F.col("text").rlike("[a-zA-Z]{2,}")).alias("latin"), F.count_if(F.col("text").rlike(r"^\d+$")).alias("numeric")).withColumn("role", F.when(F.col("marked") > 3, "vi").when((F.col("latin") > 3) & (F.col("marked") == 0), "en").when(F.col("numeric") > 10, "skip").otherwise("unknown")), rf"SELECT *, CASE WHEN marked > 3 THEN 'vi' WHEN latin > 3 AND marked = 0 THEN 'en' WHEN numeric > 10 THEN 'skip' ELSE 'unknown' END AS role FROM (SELECT doc_id, count(*) FILTER (regexp_matches(text, '[{B.MARKED}{B.MARKED.upper()}]')) AS marked, count(*) FILTER (regexp_matches(text, '[a-zA-Z]{{2,}}')) AS latin, count(*) FILTER (regexp_matches(text, '^\d+$')) AS numeric FROM units WHERE line_no < 20 GROUP BY doc_id)", B.UNITS)
add("a24_dedup_stats", lambda s, d: Q.entity_report(units(s, d).withColumn("key", T.exact_key(F.col("text")))), f"SELECT count(*) AS total, count(DISTINCT {B.exact('text')}) AS unique, count(*) - count(DISTINCT {B.exact('text')}) AS saved FROM units", B.UNITS)
add("u08_distinct_pending", lambda s, d: classified(s, d).where("status = 'NEEDS_TRANSLATION'").select("key").dropDuplicates(), "SELECT DISTINCT key FROM classified WHERE status = 'NEEDS_TRANSLATION'", B.UNITS, *CLASSIFIED)

# --- rules, rewriting, harvesting
RULES = [("r1", "the", "style", ["the\\s+the", "\\bthat\\b"], ["of of"], "", True, 2), ("r2", "table", "layout", ["\\|"], ["| |"], "", True, 1), ("r3", "off", "none", ["."], ["e"], "", False, 9)]
rules = lambda s: R.table(s, RULES)
add("fil24_rule_triggers", lambda s, d: R.triggered(units(s, d).select(uid(), "text"), rules(s), "unit_id"), r"SELECT DISTINCT doc_id * 10000 + line_no AS unit_id, rule, CAST(priority AS INTEGER) AS priority FROM units, (VALUES ('r1', 2, 'the\s+the'), ('r1', 2, '\bthat\b'), ('r2', 1, '\|')) v(rule, priority, p) WHERE regexp_matches(lower(text), p)", B.UNITS)
add("fil25_prohibited", lambda s, d: R.prohibited(units(s, d).select(uid(), "text"), rules(s), "unit_id"), "SELECT DISTINCT doc_id * 10000 + line_no AS unit_id, rule, phrase FROM units, (VALUES ('r1', 'of of'), ('r2', '| |')) v(rule, phrase) WHERE contains(lower(text), phrase)", B.UNITS)
REWRITES = [(r"\s*\|\s*", " / "), ("The the", "The"), (r"([.!?])\1+", "$1")]
add("f14_f17_rewrites", lambda s, d: units(s, d).select("doc_id", "line_no", F.md5(R.rewritten(F.col("text"), REWRITES[:2])).alias("text")), r"SELECT doc_id, line_no, md5(replace(regexp_replace(text, '\s*\|\s*', ' / ', 'g'), 'The the', 'The')) AS text FROM units", B.UNITS)
add("f23_candidate_cleaner", lambda s, d: units(s, d).select("doc_id", "line_no", R.cleaned(F.col("text")).alias("term")), r"SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(text, '^[\s*•#\-–0-9.)(]+', ''), '[\s.,:;!?)(]+$', ''), '\s+', ' ', 'g')) AS term FROM units", B.UNITS)
_clean = r"trim(regexp_replace(regexp_replace(regexp_replace(part, '^[\s*•#\-–0-9.)(]+', ''), '[\s.,:;!?)(]+$', ''), '\s+', ' ', 'g'))"
add(
    "p06_p07_harvest",
    lambda s, d: R.harvested(units(s, d), catalog.terms(s, d), 2),
    rf"""SELECT key, count(DISTINCT doc_id) AS documents, count(*) AS n, CAST(min(doc_id * 100000 + line_no) // 100000 AS BIGINT) AS doc_id, CAST(min(doc_id * 100000 + line_no) % 100000 AS INTEGER) AS line_no FROM (SELECT *, {B.word_key('term')} AS key FROM (SELECT doc_id, line_no, {_clean} AS term FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(text, '[:|]')) AS part FROM units))
      WHERE length(term) BETWEEN 3 AND 40 AND NOT regexp_matches(term, '[.?!;\n\r]') AND len(regexp_split_to_array(term, '\s+')) BETWEEN 1 AND 4) WHERE key NOT IN (SELECT {B.word_key('source_term')} FROM terms) GROUP BY key HAVING count(DISTINCT doc_id) >= 2""",
    B.UNITS, B.TERMS,
)
_grams = " UNION ALL ".join(f"SELECT doc_id, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})" for n in range(1, 5))
add("p08_gram_scan", lambda s, d: R.grams(units(s, d), 4, 5), f"SELECT gram, count(DISTINCT doc_id) AS documents, count(*) AS n FROM ({_grams}) GROUP BY gram HAVING count(DISTINCT doc_id) >= 5", B.UNITS, f"w AS (SELECT doc_id, list_filter(string_split({B.word_key('text')}, ' '), lambda x: x <> '') AS w FROM units)")
add("l04_top_candidates", lambda s, d: R.grams(units(s, d), 2, 5).orderBy(F.desc("n"), "gram").limit(100).select("gram", "n"), f"SELECT gram, count(*) AS n FROM ({' UNION ALL '.join(_grams.split(' UNION ALL ')[:2])}) GROUP BY gram HAVING count(DISTINCT doc_id) >= 5 ORDER BY n DESC, gram LIMIT 100", B.UNITS, f"w AS (SELECT doc_id, list_filter(string_split({B.word_key('text')}, ' '), lambda x: x <> '') AS w FROM units)")
DIFFS = [("Check the gap now", "Check the bond gap now"), ("a b c", "a x c"), ("same", "same"), ("one", "two three"), ("x y", "x y z")]
add("f19_word_diff", lambda s, d: s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(DIFFS)], "i long, a string, b string").select("i", R.word_diff(F.col("a"), F.col("b")).alias("w")).select("i", "w.old", "w.new"), "SELECT CAST(i AS BIGINT) AS i, old, new FROM (VALUES (0, '', 'bond'), (1, 'b', 'x'), (2, '', ''), (3, 'one', 'two three'), (4, '', 'z')) v(i, old, new)")
WORDS = {"the": "le", "and": "et", "of": "de", "in": "dans"}
add("m02_offline_translator", lambda s, d: units(s, d).where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "line_no", F.md5(R.translated(F.col("text"), {"of the": "du"}, WORDS)).alias("text")), "SELECT doc_id, line_no, md5(upper(substr(t, 1, 1)) || substr(t, 2)) AS text FROM (SELECT doc_id, line_no, array_to_string(list_transform(string_split(replace(lower(text), 'of the', 'du'), ' '), lambda w: CASE w WHEN 'the' THEN 'le' WHEN 'and' THEN 'et' WHEN 'of' THEN 'de' WHEN 'in' THEN 'dans' ELSE w END), ' ') AS t FROM units WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]'))", B.UNITS)
add("dml11_dedupe_infer_join", lambda s, d: units(s, d).withColumn("key", T.exact_key(F.col("text"))).join(units(s, d).select(T.exact_key(F.col("text")).alias("key")).distinct().withColumn("answer", F.md5("key")), "key").select("doc_id", "line_no", "answer"), f"SELECT doc_id, line_no, md5({B.exact('text')}) AS answer FROM units", B.UNITS)
add("j17_containment_count", lambda s, d: units(s, d).join(F.broadcast(s.createDataFrame([("edon",), ("thion",), ("der",)], "needle string")), F.lower("text").contains(F.col("needle"))).groupBy("needle").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")), "SELECT needle, count(*) AS n, count(DISTINCT doc_id) AS documents FROM units, (VALUES ('edon'), ('thion'), ('der')) v(needle) WHERE contains(lower(text), needle) GROUP BY needle", B.UNITS)
add("j15_corrected_pairs", lambda s, d: pairs(s, d).alias("c").join(pairs(s, d).where("conv_id % 2 = 0").select("conv_id", "turn", F.col("target").alias("base")), ["conv_id", "turn"]).join(pairs(s, d).where("turn % 4 = 0").select("conv_id", "turn", F.lit(True).alias("logged")), ["conv_id", "turn"], "left").select("conv_id", "turn", (F.coalesce("logged", F.lit(False)) | (F.col("target") != F.col("base"))).alias("corrected")), "SELECT conv_id, turn, turn % 4 = 0 AS corrected FROM pairs WHERE conv_id % 2 = 0", B.PAIRS)
add("j23_a09_term_coverage", lambda s, d: Q.term_coverage(pairs(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.explode(F.array(F.lit("the"), F.lit("la"), F.lit("der"))).alias("term"), "source").where(F.lower("source").contains(F.col("term"))).withColumn("target_form", F.col("term")), pairs(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.col("target").alias("text"))), "SELECT key, count(*) AS terms, count(*) FILTER (contains(lower(target), term)) AS present, CAST(floor(100.0 * count(*) FILTER (contains(lower(target), term)) / count(*) + 0.5) AS INTEGER) AS compliance FROM (SELECT conv_id * 100 + turn AS key, source, target FROM pairs), (VALUES ('the'), ('la'), ('der')) v(term) WHERE contains(lower(source), term) GROUP BY key", B.PAIRS)
add("src13_cell_neighbours", lambda s, d: catalog.table(s, d, "lineitem").withColumns({"next": F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")), "value": F.lead("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))}).select("l_orderkey", "l_linenumber", F.when(F.col("next") == F.col("l_linenumber") + 1, F.col("value")).alias("right")), "SELECT l_orderkey, l_linenumber, CASE WHEN lead(l_linenumber) OVER w = l_linenumber + 1 THEN lead(l_returnflag) OVER w END AS \"right\" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)")
add("fil28_table_overflow", lambda s, d: units(s, d).groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).select("doc_id", "rows", ((F.col("rows") - 1 >= 5) | ((F.col("rows") - 1 >= 4) & (F.col("chars") >= 800))).alias("split"), F.when((F.col("rows") - 1 >= 5) | ((F.col("rows") - 1 >= 4) & (F.col("chars") >= 800)), 1 + F.ceil((F.col("rows") - 1) / 2)).otherwise(F.col("rows")).alias("index")), "SELECT doc_id, rows, s AS split, CAST(CASE WHEN s THEN 1 + ceil((rows - 1) / 2) ELSE rows END AS BIGINT) AS \"index\" FROM (SELECT doc_id, count(*) AS rows, count(*) - 1 >= 5 OR (count(*) - 1 >= 4 AND sum(length(text)) >= 800) AS s FROM units GROUP BY doc_id)", B.UNITS)
add("snk04_session_log", lambda s, d: pairs(s, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "source"))).alias("pairs")).select("conv_id", F.size("pairs").alias("n"), F.col("pairs")[0]["turn"].alias("first_turn")), "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, min(turn) AS first_turn FROM pairs GROUP BY conv_id", B.PAIRS)
add("snk05_audit_trace", lambda s, d: V.newest(QUERIES["a12_slide_roll_up"](s, d), 20, [F.desc("needs"), F.col("doc_id")]), "SELECT doc_id, count(*) AS units, count(*) FILTER (status IN ('NEEDS_TRANSLATION', 'REVIEW_REQUIRED')) AS needs, arg_min(status, line_no) AS first FROM classified GROUP BY doc_id ORDER BY needs DESC, doc_id LIMIT 20", B.UNITS, *CLASSIFIED)
add("snk11_context_sections", lambda s, d: units(s, d).select("doc_id", "line_no", F.substring("text", 1, 500).alias("snippet")).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("snippet")).alias("chars")), "SELECT doc_id, count(*) AS sections, CAST(sum(length(substr(text, 1, 500))) AS BIGINT) AS chars FROM units GROUP BY doc_id", B.UNITS)
add("w14_first_occurrence", lambda s, d: units(s, d).select("doc_id", "line_no", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("doc_id", "token").agg(F.min("line_no").alias("line_no")), f"SELECT doc_id, token, min(line_no) AS line_no FROM (SELECT doc_id, line_no, unnest({B.tokens('text')}) AS token FROM units) GROUP BY 1, 2", B.UNITS)
