"""DuckDB SQL of the derived collections, as common table expressions, for the oracle queries."""

UNITS = r"""units AS (
  SELECT doc_id, lang, CAST(i AS INTEGER) AS line_no, l[i + 1] AS text
  FROM (SELECT doc_id, lang, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))
  WHERE trim(l[i + 1]) <> ''
)"""

TERMS = """terms AS (
  SELECT p_partkey AS id, p_name AS source_term, p_type AS target_term,
    CASE WHEN p_partkey % 3 = 0 THEN 'vi' ELSE 'en' END AS source_lang, CASE WHEN p_partkey % 3 = 0 THEN 'en' ELSE 'vi' END AS target_lang,
    CASE WHEN p_partkey % 5 = 0 THEN 'review' WHEN p_partkey % 5 = 1 THEN 'quarantined' ELSE 'approved' END AS status,
    p_size AS priority, p_brand AS category, CASE WHEN p_partkey % 7 = 0 THEN 'Auto-Harvester' ELSE 'user' END AS created_by,
    TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 30 AS INTEGER)) AS updated_at, p_retailprice / 1000 AS confidence
  FROM part
)"""

PAIRS = """pairs AS (
  SELECT conv_id, turn, text AS source, target FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE role = 'user' AND next_role = 'assistant'
)"""

LOG = "log AS (SELECT event_id AS id, ts, user_id, event_type AS operation, value AS duration, props FROM events)"

MEMORY = """memory AS (
  SELECT item_id, CAST(i AS INTEGER) AS sentence_no, l[i + 1] AS sentence
  FROM (SELECT item_id, l, unnest(range(0, len(l))) AS i FROM (SELECT item_id, string_split(text, '. ') AS l FROM benchmark)) WHERE trim(l[i + 1]) <> ''
)"""

RUNS = r"""runs AS (
  SELECT page_id, CAST(i AS INTEGER) AS run_no, regexp_extract(l[i + 1], '^<(p|li)>', 1) AS tag, regexp_replace(l[i + 1], '^<(p|li)>', '') AS text
  FROM (SELECT page_id, l, unnest(range(0, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(<(?:p|li)>[^<]*)<', 1) AS l FROM pages))
)"""

BULLET = r"^\s*(?:[*•#]|[-–—]\s+|\d{1,3}[.)]\s*)"
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"


def exact(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


def canonical(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(trim(coalesce({c}, '')), '{BULLET}', ''), '\\s+', ' ', 'g'))"


def normalised(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({canonical(c)}, '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def folded(c: str) -> str:
    return f"replace(strip_accents({normalised(c)}), 'đ', 'd')"


def compact(c: str) -> str:
    return f"replace({folded(c)}, ' ', '')"


def tokens(c: str) -> str:
    return f"list_filter(string_split({folded(c)}, ' '), lambda t: t <> '')"


def word_key(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
