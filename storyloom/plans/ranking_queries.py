"""Registered queries of ranking, limits, feeds and search."""

from pyspark.sql import functions as F

from ..operators import ranking as R
from . import views as V
from .views_sql import T, query


@query("SELECT feed, category, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY feed) AS turn FROM feeds) ORDER BY turn, category LIMIT 25".replace("AS turn", "::int AS turn").replace("OVER (PARTITION BY category ORDER BY feed) ::int", "OVER (PARTITION BY category ORDER BY feed)::int"))
def w1_round_robin(spark, d):
    return R.round_robin(V.feeds(spark, d), 25).select("feed", "category", "turn")


@query(", s AS (SELECT story_id, category, round(importance::double + source_count / 10, 6) AS score FROM stories), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, story_id) > 5 AS o FROM s) SELECT story_id, score, (row_number() OVER (ORDER BY o, score DESC, story_id))::int AS place FROM r ORDER BY place LIMIT 20")
def w2_diversify(spark, d):
    s = V.stories(spark, d).select("story_id", "category", F.round(F.col("importance").cast("double") + F.col("source_count") / 10, 6).alias("score"))
    return R.diversify(s, 20).select("story_id", "score", "place")


@query("SELECT story_id, source, arg_min(doc_id, doc_id) AS doc_id FROM articles GROUP BY 1, 2")
def w3_dedup_sources_first(spark, d):
    return R.dedup_sources(V.members(spark, d)).select("story_id", "source", "doc_id")


@query("SELECT story_id, source, max(doc_id) AS doc_id FROM articles GROUP BY 1, 2")
def w3_dedup_sources_last(spark, d):
    return R.dedup_sources(V.members(spark, d), "last").select("story_id", "source", "doc_id")


@query("SELECT doc_id FROM articles WHERE NOT processed ORDER BY published_at DESC, doc_id LIMIT 100")
def w4_latest_unprocessed(spark, d):
    return R.latest(V.articles(spark, d), ~F.col("processed"), "published_at", 100, "doc_id").select("doc_id")


@query("SELECT story_id FROM stories WHERE category = 'health' ORDER BY last_updated DESC, story_id LIMIT 20")
def w5_recent_stories(spark, d):
    return R.recent_stories(V.stories(spark, d), 20, "health").select("story_id")


@query("""SELECT feed, count(*) FILTER (late) AS consecutive, CASE WHEN count(*) FILTER (late) >= 3 AND floor(epoch(TIMESTAMP '2024-01-30')) - floor(epoch(max(ts) FILTER (late))) > 1800 THEN 'half_open' WHEN count(*) FILTER (late) >= 3 THEN 'open' ELSE 'closed' END AS state
 FROM (SELECT *, NOT ok AND sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY ts DESC, event_id DESC) = 0 AS late FROM fetch_log) GROUP BY 1""")
def w6_breaker_state(spark, d):
    return R.breaker_state(V.fetch_log(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp"))


@query("SELECT user_id, event_id, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM interactions WHERE kind = 'view') WHERE place <= 50")
def w7_reading_history(spark, d):
    return R.reading_history(V.interactions(spark, d), 50).select("user_id", "event_id", "place")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM interactions WHERE kind = 'view') h WHERE place > 10 AND NOT EXISTS (SELECT 1 FROM interactions s WHERE s.kind = 'save' AND s.user_id = h.user_id AND s.story_id = h.story_id)")
def w7_prune_history(spark, d):
    return R.prune_history(V.interactions(spark, d), 10).select("user_id", "event_id")


@query("SELECT user_id, event_id, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM interactions) WHERE place <= 5")
def w8_recent_interactions(spark, d):
    return R.recent_interactions(V.interactions(spark, d), 5).select("user_id", "event_id", "place")


@query(f"SELECT c_custkey AS user_id, coalesce(used, 0) AS used, CASE WHEN c_custkey % 5 = 0 THEN 1000 ELSE 20 END AS limit, greatest(CASE WHEN c_custkey % 5 = 0 THEN 1000 ELSE 20 END - coalesce(used, 0), 0) AS remaining FROM customer LEFT JOIN (SELECT user_id, count(*) AS used FROM interactions WHERE ts > {T} - INTERVAL 1 DAY AND ts <= {T} GROUP BY 1) u ON c_custkey = u.user_id".replace("AS limit", 'AS "limit"').replace('AS "limit",', '::int AS "limit",').replace("20 END ::int", "20 END::int"))
def w9_quota(spark, d):
    tiers = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 == 0, "paid").otherwise("free").alias("tier"))
    return R.quota(V.interactions(spark, d), tiers, V.asof())


@query("SELECT story_id, doc_id, n, change FROM (SELECT *, n - lag(n) OVER (PARTITION BY story_id ORDER BY published_at, n) AS change FROM (SELECT story_id, doc_id, published_at, (tier * 2)::int AS n FROM articles)) WHERE change <> 0")
def w10_source_count_changes(spark, d):
    snaps = V.members(spark, d).select("story_id", "doc_id", F.col("published_at").alias("ts"), (F.col("tier") * 2).alias("n"))
    return R.source_count_changes(snaps).select("story_id", "doc_id", "n", "change")


@query("SELECT story_id, arg_min(doc_id, tier * 1000000000 + doc_id) AS lead FROM articles GROUP BY 1".replace("1000000000", "1000000000::bigint"))
def w11_lead_story(spark, d):
    return R.lead_story(V.members(spark, d))


WEIGHTS = {"sports": 0.8, "health": 0.3, "politics": 0.55}


def profile(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "category string, weight double")


_W = "CASE category " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items()) + " ELSE 0 END"
_S = f"""round(CASE WHEN h < 1 THEN 100 WHEN h < 3 THEN 95 WHEN h < 6 THEN 90 WHEN h < 12 THEN 80 WHEN h < 24 THEN 70 WHEN h < 48 THEN 50 ELSE greatest(0, 30 - h) END::double + CASE WHEN breaking THEN 15 ELSE 0 END + importance / 10 + least(source_count, 5) + 10 * ({_W})::double, 6)"""
_H = f"(SELECT *, (epoch({T}) - epoch(first_seen)) / 3600 AS h FROM "


@query(f"SELECT story_id, {_S} AS score FROM {_H} stories)")
def e14_feed_score(spark, d):
    return R.feed_score(V.stories(spark, d), profile(spark), V.asof()).select("story_id", "score")


@query(f""", v AS (SELECT * FROM stories WHERE last_updated >= {T} - INTERVAL 2 DAY AND category <> 'lifestyle' ORDER BY last_updated DESC, story_id LIMIT 200), c AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY first_seen DESC, story_id) AS p FROM v WHERE length(coalesce(summary, '')) > 0) WHERE p > 10 AND p <= 50),
 s AS (SELECT story_id, category, {_S} AS score FROM {_H} c)), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, story_id) > 5 AS o FROM s) SELECT story_id, score, (row_number() OVER (ORDER BY o, score DESC, story_id))::int AS place FROM r ORDER BY place LIMIT 20""")
def ranked_feed(spark, d):
    return R.ranked_feed(V.stories(spark, d), profile(spark), None, 20, 10, V.asof()).select("story_id", "score", "place")


@query("SELECT story_id FROM stories ORDER BY breaking DESC, first_seen DESC, story_id LIMIT 30")
def r2_default_feed(spark, d):
    return R.default_feed(V.stories(spark, d), 30).select("story_id")


@query(f"""SELECT story_id, round(CASE WHEN contains(lower(title), 'health') THEN 100.0 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '(?:health)') THEN 50.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), 'health') THEN 25.0 ELSE 0 END + greatest(0, 20 - (epoch({T}) - epoch(last_updated)) / 3600), 6)::double AS score
 FROM stories WHERE contains(lower(title), 'health') OR contains(lower(coalesce(summary, '')), 'health') OR category = 'health' ORDER BY score DESC, story_id LIMIT 50""")
def r3_search_tags(spark, d):
    return R.search(V.stories(spark, d).withColumn("tags", F.array("category")), "health", None, 50, V.asof()).select("story_id", "score")


@query(f"""SELECT story_id, round(CASE WHEN contains(lower(title), 'in') THEN 100.0 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '(?:in)') THEN 50.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), 'in') THEN 25.0 ELSE 0 END + greatest(0, 20 - (epoch({T}) - epoch(last_updated)) / 3600), 6)::double AS score
 FROM stories WHERE contains(lower(title), 'in') OR contains(lower(coalesce(summary, '')), 'in') ORDER BY score DESC, story_id LIMIT 50""")
def r3_search(spark, d):
    return R.search(V.stories(spark, d), "in", None, 50, V.asof()).select("story_id", "score")


@query(f"SELECT story_id FROM stories WHERE breaking AND last_updated >= {T} - INTERVAL 3 DAY ORDER BY last_updated DESC, story_id LIMIT 20")
def r4_breaking(spark, d):
    return R.breaking(V.stories(spark, d), 20, V.asof()).select("story_id")


@query(f"SELECT count(*) AS n FROM (SELECT story_id FROM stories WHERE source_count = 1 AND length(coalesce(summary, '')) > 0)")
def f6_with_fallback(spark, d):
    return R.with_fallback(V.stories(spark, d).filter("source_count = 1"), 20).agg(F.count("*").alias("n"))


@query("SELECT story_id FROM stories WHERE length(coalesce(summary, '')) = 0 ORDER BY last_updated DESC, story_id LIMIT 20")
def f6_falls_back(spark, d):
    """Where no story has a summary, the latest ones are shown."""
    return R.with_fallback(V.stories(spark, d).filter(F.length(F.coalesce("summary", F.lit(""))) == 0), 20).select("story_id")
