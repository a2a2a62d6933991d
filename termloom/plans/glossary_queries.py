"""Queries of the glossary store and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import predicates as P

from ..operators import glossary as G
from ..operators import quality
from . import base as B
from .text_queries import IS_LABEL

QUERIES, ORACLES = {}, {}
COLUMNS = ["id", "source_term", "target_term", "source_lang", "target_lang", "status", "priority"]
LIST = ", ".join(COLUMNS)


def add(name: str, query, sql: str, *ctes: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = (B.with_(*ctes) if ctes else "") + sql


def terms(s, d):
    return catalog.terms(s, d)


add("fil01_glossary_filter", lambda s, d: G.search(terms(s, d), "approved", "en", "vi", "RED").select(*COLUMNS), f"SELECT {LIST} FROM terms WHERE status = 'approved' AND source_lang = 'en' AND target_lang = 'vi' AND (contains(lower(source_term), 'red') OR contains(lower(target_term), 'red') OR contains(lower(category), 'red'))", B.TERMS)
add("fil01_auto_harvested", lambda s, d: G.search(terms(s, d), "auto_harvested").select(*COLUMNS), f"SELECT {LIST} FROM terms WHERE created_by = 'Auto-Harvester'", B.TERMS)
add("fil02_eligible", lambda s, d: G.eligible(terms(s, d), True).select(*COLUMNS), f"SELECT {LIST} FROM terms WHERE status IN ('approved', 'review')", B.TERMS)
add("fil03_page", lambda s, d: G.page(G.search(terms(s, d), target_lang="vi"), "newest", 2, 50).select(*COLUMNS), f"SELECT {LIST} FROM terms WHERE target_lang = 'vi' ORDER BY updated_at DESC, priority, length(source_term) DESC, id LIMIT 50 OFFSET 50", B.TERMS)


def _sql_safe(s: str, t: str, lang: str = "source_lang = 'vi' AND target_lang = 'en'") -> str:
    stop = ", ".join(repr(w) for w in P.STOP_WORDS)
    label = lambda c: IS_LABEL.replace("(text,", f"({c},")
    vi = f"[{B.MARKED}{B.MARKED.upper()}]"
    words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    head = r"'^\s*[*•#]\s*\S+(?:\s+\S+){0,3}\s*$'"
    source_head = r"'^\s*[*•#]\s*\S+(?:\s+\S+){0,4}\s*[:：]?\s*$'"
    step = lambda c: f"regexp_extract({c}, '^\\s*(\\d+)[.)]', 1)"
    return (
        f"(coalesce({s}, '') <> '' AND coalesce({t}, '') <> '' AND status NOT IN ('quarantined', 'rejected') AND NOT {label(s)} AND NOT {label(t)} AND length({s}) >= 2 AND length({t}) >= 2"
        f" AND lower({s}) <> lower({t}) AND lower({s}) NOT IN ({stop}) AND lower({t}) NOT IN ({stop})"
        rf" AND NOT regexp_matches({s}, '^[/\\]|[/\\]$') AND NOT regexp_matches({t}, '^[/\\]|[/\\]$') AND NOT regexp_matches({s}, '^\.{{2,}}') AND NOT regexp_matches({t}, '^\.{{2,}}')"
        f" AND NOT ({lang} AND regexp_matches({t}, '{vi}') AND NOT regexp_matches(regexp_replace({t}, '{vi}', ''), '[a-zA-Z]{{3,}}'))"
        rf" AND NOT regexp_matches({s}, '(?i)\baplly\b') AND NOT regexp_matches({t}, '(?i)\baplly\b') AND NOT regexp_matches({s}, '(?i)^(?:thứ\s*\d+|nấc\s*\d*|bước\s*\d*|\d+|trang\s*\d+)$')"
        f" AND NOT ({step(s)} <> '' AND {step(s)} <> {step(t)}) AND NOT (regexp_matches({t}, {head}) AND NOT regexp_matches({s}, {source_head})) AND NOT (regexp_matches({t}, {head}) AND {words(s)} > 4)"
        f" AND NOT ({words(s)} >= 10 AND length({t}) < length({s}) * 0.45) AND NOT ({words(s)} >= 6 AND {words(t)} = 1 AND length({t}) <= 6))"
    )


TERM_CASES = [("cắt", "cut"), ("C", "Cut"), ("same", "SAME"), ("vị trí", "at"), ("/may", "sew"), ("may", "...off"), ("3. dán đế", "dán"), ("3. dán đế", "3. attach sole"), ("thứ 6", "*Lacing"), ("còn logo nếu logo chữ thì sử dụng", "logo"), ("OK", "fine"), ("Hình mũi", "Shape toe"), ("quét keo", "aplly cement"), ("", "x"), ("đế", "đế ngoài"), ("a b c d e f g h i j", "k l"), ("* May :", "*Stitching"), ("đường may", "stitching line/seam")]


def cases(s):
    return s.createDataFrame([(i, a, b, "vi", "en", "approved") for i, (a, b) in enumerate(TERM_CASES)], "id long, source_term string, target_term string, source_lang string, target_lang string, status string")


CASES_CTE = "cases AS (SELECT *, 'vi' AS source_lang, 'en' AS target_lang, 'approved' AS status FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TERM_CASES)) + ") v(id, source_term, target_term))"


def with_cases(s, d):
    c = ["id", "source_term", "target_term", "source_lang", "target_lang", "status"]
    return terms(s, d).select(*c).unionByName(cases(s).withColumn("id", F.col("id") - 100))


ALL_CTE = "rows AS (SELECT id, source_term, target_term, source_lang, target_lang, status FROM terms UNION ALL SELECT id - 100, source_term, target_term, source_lang, target_lang, status FROM cases)"
add("fil06_safe_term", lambda s, d: with_cases(s, d).select("id", P.is_safe_term(*(F.col(c) for c in ("source_term", "target_term", "status", "source_lang", "target_lang"))).alias("safe")), f"SELECT id, {_sql_safe('trim(source_term)', 'trim(target_term)')} AS safe FROM rows", B.TERMS, CASES_CTE, ALL_CTE)
_S, _T = "trim(source_term)", "trim(target_term)"
_STOP = ", ".join(repr(w) for w in P.STOP_WORDS)
SQL_PROBLEM = rf"""CASE WHEN {_S} = '' OR {_T} = '' THEN 'empty' WHEN length({_S}) < 2 OR length({_T}) < 2 THEN 'single character' WHEN lower({_S}) = lower({_T}) THEN 'identical'
  WHEN lower({_S}) IN ({_STOP}) OR lower({_T}) IN ({_STOP}) THEN 'function word'
  WHEN regexp_matches({_S}, '^[/\\]|[/\\]$') OR regexp_matches({_T}, '^[/\\]|[/\\]$') THEN 'slash' WHEN regexp_matches({_S}, '^\.{{2,}}') OR regexp_matches({_T}, '^\.{{2,}}') THEN 'ellipsis'
  WHEN source_lang IN ('', 'vi') AND regexp_matches({_T}, '[{B.MARKED}{B.MARKED.upper()}]') THEN 'source letters in target'
  WHEN regexp_matches({_T}, '^\s*[*•#]\s*\S+') AND (len(regexp_split_to_array({_S}, '\s+')) >= 6 OR regexp_matches({_S}, '^\s*\d+[.)]')) THEN 'collapsed instruction'
  WHEN regexp_matches({_T}, '^\s*[*•#]\s*\S+') AND NOT regexp_matches({_S}, '^\s*[*•#]\s*\S+') THEN 'heading'
  WHEN regexp_matches({_S}, '(?i)^(?:thứ\s*\d+|nấc\s*\d*|bước\s*\d*|\d+|trang\s*\d+)$') THEN 'ordinal' END"""
add("fil07_sanitizer", lambda s, d: with_cases(s, d).select("id", P.term_problem(F.col("source_term"), F.col("target_term"), F.col("source_lang")).alias("problem"), P.corrected_target(F.col("target_term")).alias("target")), rf"SELECT id, {SQL_PROBLEM} AS problem, CASE WHEN regexp_matches({_T}, '(?i)^(?:\d+\.\s*)?Shape\s+(tip|toe|collar|heel|vamp|tongue|quarter)$') THEN upper(substr(regexp_extract({_T}, '(?i)Shape\s+(\w+)$', 1), 1, 1)) || lower(substr(regexp_extract({_T}, '(?i)Shape\s+(\w+)$', 1), 2)) || ' shape' ELSE regexp_replace({_T}, '(?i)\baplly\b', 'apply', 'g') END AS target FROM rows", B.TERMS, CASES_CTE, ALL_CTE)
add("a10_glossary_health", lambda s, d: G.health(with_cases(s, d)), f"SELECT {SQL_PROBLEM} AS reason, count(*) AS n FROM rows GROUP BY 1", B.TERMS, CASES_CTE, ALL_CTE)

for _name, _sql in {"newest": "updated_at DESC, priority, length(source_term) DESC, id", "oldest": "updated_at, priority, length(source_term) DESC, id", "az_en": "source_term, id", "priority": "priority, length(source_term) DESC, id"}.items():
    add(f"l01_order_{_name}", lambda s, d, n=_name: terms(s, d).orderBy(*G.ordering(n)).limit(100).select(*COLUMNS), f"SELECT {LIST} FROM terms ORDER BY {_sql} LIMIT 100", B.TERMS)
QUERIES["l01_order_az_vi"] = lambda s, d: terms(s, d).orderBy(*G.ordering("az_vi")).limit(100).select(*COLUMNS)

BOTH = "two_way AS (SELECT id, source_term, target_term, source_lang, target_lang, status, priority, updated_at, category, TRUE AS is_direct FROM terms WHERE source_lang = 'vi' AND target_lang = 'en' UNION ALL SELECT id, target_term, source_term, 'vi', 'en', status, priority, updated_at, category, FALSE FROM terms WHERE source_lang = 'en' AND target_lang = 'vi')"
both = lambda s, d: G.both_directions(terms(s, d), "vi", "en")
add("u01_both_directions", lambda s, d: both(s, d).select(*COLUMNS, "is_direct"), f"SELECT {LIST}, is_direct FROM two_way", B.TERMS, BOTH)
RANK = "is_direct DESC, status = 'approved' DESC, priority DESC, updated_at DESC, contains(target_term, '/'), id"
add("w01_first_of_pair", lambda s, d: G.first_of_each_pair(G.eligible(both(s, d), True)).select(*COLUMNS, "is_direct"), f"SELECT {LIST}, is_direct FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(source_term)), lower(trim(target_term)) ORDER BY {RANK}) AS r FROM two_way WHERE status IN ('approved', 'review')) WHERE r = 1", B.TERMS, BOTH)
add("l02_approved_order", lambda s, d: G.first_of_each_pair(G.eligible(both(s, d))).orderBy(F.length("source_term").desc(), *G.ranking()).limit(100).select(*COLUMNS), f"SELECT {LIST} FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(source_term)), lower(trim(target_term)) ORDER BY {RANK}) AS r FROM two_way WHERE status = 'approved') WHERE r = 1 ORDER BY length(source_term) DESC, {RANK} LIMIT 100", B.TERMS, BOTH)
add("w02_term_winner", lambda s, d: G.winners(G.eligible(both(s, d))), f"SELECT source_key, min(id) AS id, arg_min(target_term, id) AS target_term, count(DISTINCT target_term) AS n_targets, count(DISTINCT target_term) > 1 AS ambiguous FROM (SELECT *, {B.exact('source_term')} AS source_key, rank() OVER (PARTITION BY {B.exact('source_term')} ORDER BY is_direct DESC, priority DESC, updated_at DESC) AS r FROM two_way WHERE status = 'approved') WHERE r = 1 GROUP BY source_key", B.TERMS, BOTH)

ALIAS_CASES = [("độ gập/ổn định", "rocking"), ("lỗ đinh/lỗ định vị", "nail hole/locating hole"), ("mũi/inch", "stitches/inch"), ("Trung đế (bao)", "midsole wrap"), ("a/b", "x y/z w"), ("plain", "target")]
EDGE = r"'^[/\\,;:.\s]+|[/\\,;:.\s]+$'"
add(
    "u02_aliases",
    lambda s, d: s.createDataFrame(ALIAS_CASES, "source string, target string").union(terms(s, d).select(F.concat_ws("/", "source_term", "category"), "target_term")).distinct().select("source", "target", F.explode(G.aliases(F.col("source"), F.col("target"))).alias("a")).select("source", "target", F.col("a.source").alias("alias"), F.col("a.target").alias("alias_target")),
    rf"""SELECT DISTINCT source, target, alias, alias_target FROM (
      SELECT source, target, source AS alias, target AS alias_target FROM c
      UNION ALL SELECT source, target, p[i], q[i] FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM c WHERE NOT unit AND contains(source, '/') AND contains(target, '/') AND len(p) = len(q))
      UNION ALL SELECT source, target, unnest(p), target FROM c WHERE NOT unit AND contains(source, '/') AND NOT (contains(target, '/') AND len(p) = len(q)) AND len(p) >= 2 AND length(source) <= 35
      UNION ALL SELECT source, target, bare, target FROM c WHERE named
      UNION ALL SELECT source, target, inside || ' ' || bare, target FROM c WHERE named AND length(inside) BETWEEN 2 AND 19 AND NOT regexp_matches(inside, '^\d+$')
      UNION ALL SELECT source, target, bare || ' ' || inside, target FROM c WHERE named AND length(inside) BETWEEN 2 AND 19 AND NOT regexp_matches(inside, '^\d+$'))""",
    B.TERMS,
    "raw AS (SELECT DISTINCT source, target FROM (SELECT source_term || '/' || category AS source, target_term AS target FROM terms UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIAS_CASES) + ") v))",
    rf"""c AS (SELECT source, target, list_filter(list_transform(string_split(source, '/'), lambda x: trim(regexp_replace(x, {EDGE}, '', 'g'))), lambda x: length(x) >= 2) AS p,
      list_filter(list_transform(string_split(target, '/'), lambda x: trim(regexp_replace(x, {EDGE}, '', 'g'))), lambda x: length(x) >= 2) AS q,
      regexp_matches(source, '(?i)(mũi\s*/\s*inch|kg\s*/\s*cm2|g\s*/\s*cm2|km\s*/\s*h|\d+\s*/\s*\d+)') AS unit, regexp_matches(source, '\([^)]+\)') AS named,
      trim(regexp_replace(trim(regexp_replace(regexp_replace(source, '\([^)]+\)', '', 'g'), '\s+', ' ', 'g')), {EDGE}, '', 'g')) AS bare, trim(regexp_replace(regexp_extract(source, '\(([^)]+)\)', 1), {EDGE}, '', 'g')) AS inside FROM raw)""",
)
add("a02_facets", lambda s, d: G.facets(terms(s, d)), "SELECT category, count(*) AS total, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (created_by = 'Auto-Harvester') AS auto, count(*) FILTER (source_lang = 'vi') AS from_vi FROM terms GROUP BY category", B.TERMS)
OLD_NEW = "old AS (SELECT * FROM terms WHERE id % 2 = 0), new AS (SELECT * FROM terms WHERE id % 2 = 1)"
old, new = (lambda s, d: terms(s, d).where("id % 2 = 0")), (lambda s, d: terms(s, d).where("id % 2 = 1"))
add("j04_import_anti_join", lambda s, d: G.new_rows(new(s, d), old(s, d)).select(*COLUMNS), f"SELECT {LIST} FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(source_term)), lower(trim(target_term)) ORDER BY id) AS r FROM new) n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE lower(trim(o.source_term)) = lower(trim(n.source_term)) AND lower(trim(o.target_term)) = lower(trim(n.target_term)))", B.TERMS, OLD_NEW)
add("j05_unknown_candidates", lambda s, d: G.without_known_sources(catalog.units(s, d).where(P.is_special_term(F.col("text"))), "text", terms(s, d)).select("doc_id", "line_no", "text"), rf"SELECT doc_id, line_no, text FROM units u WHERE length(trim(text)) BETWEEN 2 AND 40 AND NOT regexp_matches(trim(text), '[.?!;\n\r]') AND len(regexp_split_to_array(trim(text), '\s+')) BETWEEN 1 AND 4 AND NOT EXISTS (SELECT 1 FROM terms t WHERE {B.word_key('t.source_term')} = {B.word_key('u.text')})", B.UNITS, B.TERMS)
KEY = "lower(trim({0}.source_term)) = lower(trim({1}.source_term)) AND lower(trim({0}.target_term)) = lower(trim({1}.target_term)) AND {0}.source_lang = {1}.source_lang AND {0}.target_lang = {1}.target_lang"
add(
    "dml01_upsert",
    lambda s, d: G.upsert(old(s, d), new(s, d)).select("id", "category", "priority", "status", "op"),
    f"""SELECT o.id, coalesce(n.category, o.category) AS category, coalesce(n.priority, o.priority) AS priority, CASE WHEN n.status = 'approved' THEN 'approved' ELSE o.status END AS status, CASE WHEN n.id IS NULL THEN 'keep' ELSE 'update' END AS op
    FROM old o LEFT JOIN best n ON {KEY.format('o', 'n')} UNION ALL SELECT id, category, priority, status, 'insert' FROM best n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {KEY.format('o', 'n')})""",
    B.TERMS, OLD_NEW, f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(source_term)), lower(trim(target_term)), source_lang, target_lang ORDER BY id DESC) AS r FROM new WHERE {SQL_PROBLEM} IS NULL) WHERE r = 1)",
)
ids = lambda s, d: terms(s, d).where("id % 10 = 3").select("id")
add("dml02_status_transition", lambda s, d: G.set_status(terms(s, d), ids(s, d), "approved").select("id", "status", "history"), "SELECT id, CASE WHEN id % 10 = 3 THEN 'approved' ELSE status END AS status, CASE WHEN id % 10 = 3 AND status <> 'approved' THEN status || '>approved' END AS history FROM terms", B.TERMS)
add("dml04_delete", lambda s, d: G.delete(terms(s, d), ids(s, d)).select(*COLUMNS), f"SELECT {LIST} FROM terms WHERE id % 10 <> 3", B.TERMS)
SNAP = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
after = lambda s, d: catalog.table(s, d, "orders").select(*SNAP).where("o_orderkey % 11 <> 4").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 2, 0.0).otherwise(F.col("o_totalprice"))).withColumn("o_orderkey", F.when(F.col("o_orderkey") % 13 == 5, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_orderkey")))
DIFF_SQL = """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN 'o_totalprice' END AS changed
FROM orders a FULL JOIN (SELECT CASE WHEN o_orderkey % 13 = 5 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 7 = 2 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 4) b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice"""
add("snk02_diff_writer", lambda s, d: G.changes(catalog.table(s, d, "orders").select(*SNAP), after(s, d), "o_orderkey"), DIFF_SQL)
QUERIES["dml03_changed_fields"] = lambda s, d: G.changes(catalog.table(s, d, "orders").select(*SNAP), after(s, d), "o_orderkey").where("op = 'update'").groupBy("changed").agg(F.count("*").alias("n"))
ORACLES["dml03_changed_fields"] = f"SELECT changed, count(*) AS n FROM ({DIFF_SQL}) WHERE op = 'update' GROUP BY changed"
add("dml05_soft_delete", lambda s, d: catalog.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "deleted").otherwise("active").alias("state")).unionByName(s.range(3).select((-F.col("id") - 1).alias("doc_id"), F.lit("active").alias("state"))), "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'deleted' ELSE 'active' END AS state FROM documents UNION ALL SELECT -i - 1, 'active' FROM range(3) t(i)")
add("dml07_settings_merge", lambda s, d: catalog.log(s, d).groupBy("user_id").agg(F.max_by("duration", F.struct("ts", "id")).alias("value"), F.count("*").alias("writes")), "SELECT user_id, arg_max(duration, (ts, id)) AS value, count(*) AS writes FROM log GROUP BY user_id", B.LOG)
add("snk03_redacted_backup", lambda s, d: catalog.table(s, d, "customer").select("c_custkey", F.lit("").alias("c_name"), "c_acctbal"), "SELECT c_custkey, '' AS c_name, c_acctbal FROM customer")
add("snk06_export", lambda s, d: G.eligible(terms(s, d)).select("source_term", "target_term", "category", "priority", "source_lang", "target_lang", "status"), "SELECT source_term, target_term, category, priority, source_lang, target_lang, status FROM terms WHERE status = 'approved'", B.TERMS)
add("fil31_masked_settings", lambda s, d: catalog.table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, "••••").otherwise("").alias("secret")), "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN '••••' ELSE '' END AS secret FROM supplier")
add("a18_snapshot_fingerprint", lambda s, d: quality.snapshot(terms(s, d), ["id", "source_term", "target_term", "status"]), "SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), source_term, target_term, status)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM terms", B.TERMS)
add("a26_search_count", lambda s, d: G.search(terms(s, d), query="bolt").agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "SELECT count(*) AS n, min(id) AS first_id FROM terms WHERE contains(lower(source_term), 'bolt') OR contains(lower(target_term), 'bolt') OR contains(lower(category), 'bolt')", B.TERMS)
STAGE_CATALOG = [(f"Brand#{i}", ("cutting", "stitching", "assembly", "stockfit", "qa")[i % 5]) for i in range(1, 20)]
add("j16_stage_lookup", lambda s, d: terms(s, d).join(F.broadcast(s.createDataFrame(STAGE_CATALOG, "category string, stage string")), "category", "left").select("id", F.coalesce("stage", F.lit("general")).alias("stage")), "SELECT id, coalesce(stage, 'general') AS stage FROM terms LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in STAGE_CATALOG) + ") v(category, stage) USING (category)", B.TERMS)
QUERIES["l07_pagination"] = lambda s, d: G.page(terms(s, d), "priority", 3, 40).select(*COLUMNS)
ORACLES["l07_pagination"] = B.with_(B.TERMS) + f"SELECT {LIST} FROM terms ORDER BY priority, length(source_term) DESC, id LIMIT 40 OFFSET 80"

