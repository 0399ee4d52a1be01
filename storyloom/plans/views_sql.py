"""The views as SQL common table expressions, and the registry of queries with their SQL."""

from __future__ import annotations

from .. import vocab
from .views import ASOF, SECTIONS


def lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"list_extract({lst(values)}, cast(({index}) % {len(values)} + 1 as int))"


T = f"TIMESTAMP '{ASOF}'"
ARTICLES = f"""articles AS (SELECT doc_id, source, lang, n_chars, coalesce(text, '') AS text, trim(split_part(text, '.', 1), ' ') AS title,
 translate(substr(text, length(split_part(text, '.', 1)) + 2, 200), chr(10), ' ') AS description, trim({pick(vocab.HEADLINES, "doc_id")} || ' ' || {pick(vocab.HEADLINE_TAILS, f"doc_id // {len(vocab.HEADLINES)}")}, ' ') AS headline,
 'https://news.example/' || {pick(SECTIONS, "doc_id")} || '/' || doc_id AS url, {pick(vocab.CATEGORIES, "doc_id")} AS category,
 cast(doc_id % 3 + 1 as int) AS tier, doc_id % 5 <> 0 AS processed, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at,
 TIMESTAMP '2024-01-01' + to_minutes(doc_id + doc_id % 90) AS fetched_at,
 (doc_id // 12) * 12 + (doc_id % 12) // ((doc_id // 12) % 6 + 1) AS story_id FROM documents)"""
STORIES = """stories AS (SELECT story_id, arg_min(headline, doc_id) AS title, arg_min(category, doc_id) AS category, min(published_at) AS first_seen,
 max(published_at) AS last_updated, cast(count(DISTINCT source) as int) AS source_count, cast(count(*) as int) AS n_articles, min(tier) AS best_tier,
 CASE WHEN story_id % 3 <> 0 THEN arg_min(description, doc_id) END AS summary, cast(50 + story_id % 51 as int) AS importance,
 count(DISTINCT source) >= 5 OR story_id % 17 = 0 AS breaking, story_id % 4 = 0 AS notified FROM articles GROUP BY story_id)"""
INTERACTIONS = """interactions AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'source_click' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'like' ELSE event_type END AS kind,
 value AS dwell, cast(json_extract_string(props, '$.k') AS bigint) AS story_id FROM events WHERE event_type <> 'error')"""
FETCH = """fetch_log AS (SELECT event_id, user_id AS feed, ts, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN cast(floor(value) AS bigint) ELSE 0 END AS found,
 CASE WHEN event_type = 'error' THEN props END AS error FROM events)"""
FEEDS = f"""feeds AS (SELECT s_suppkey AS feed, s_name AS name, n_name AS country, r_name AS region, cast(s_suppkey % 2 + 1 AS int) AS tier, {pick(vocab.CATEGORIES, "s_suppkey")} AS category
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
VIEWS = f"WITH {ARTICLES}, {STORIES}, {INTERACTIONS}, {FETCH}, {FEEDS}"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; sql, where given, follows the views (it may begin with `, name AS (...)`)."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{VIEWS}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return wrap


def any_of(words) -> str:
    from ..functions.text import any_of as pattern

    return pattern(words).replace("'", "''")


def any_pattern(patterns) -> str:
    from ..functions.text import any_pattern as joined

    return joined(patterns).replace("'", "''")
