"""Registered queries of sources and sinks, clustering, upkeep and streams."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from ..functions.text import entities
from ..operators import articles as A
from ..operators import clusters as C
from ..operators import joins as J
from ..sources import io as S
from ..sources import rows, tables
from ..streaming import streams as K
from . import views as V
from .join_queries import _J15, _LINKS, _WEEK, CENT, COS, _links, _vector_stories
from .text_queries import _FALLBACK, _SIG, ENTITIES, JAC, WORDS
from .text_queries import _any as any_list
from .views_sql import T, any_of, lst, query


def _tmp(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    import uuid

    return f"{S.shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("SELECT feed, name FROM feeds WHERE tier = 1 AND contains(upper(region), 'AM')")
def s1_feeds(spark, d):
    return S.feeds(V.feeds(spark, d), tier=1, region="am").select("feed", "name")


@query("SELECT page_id, trim(regexp_replace(url, '^\\s+|\\s+$', '', 'g')) AS url, strftime(TIMESTAMP '2024-01-01' + to_minutes(page_id), '%Y-%m-%d %H:%M:%S') AS published FROM pages WHERE length(url) > 0 AND page_id % 9 <> 0")
def s2_parse_items(spark, d):
    p = V.table(spark, d, "pages")
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60), "yyyy-MM-dd HH:mm:ss")
    title = F.when(F.col("page_id") % 9 == 0, "<b></b>").otherwise(F.concat(F.lit("<b>Page &amp; "), F.col("page_id").cast("string"), F.lit("</b>")))
    items = p.select("page_id", F.lit("web").alias("source"), title.alias("title"), F.col("url").alias("link"), F.substring("html", 1, 2000).alias("description"), when.alias("pubDate"), F.lit(None).cast("string").alias("updated"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("content"))
    return S.parse_feed_items(items, V.asof(), keep=("page_id",)).select("page_id", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


def _upserts(spark, d):
    a = V.articles(spark, d).select("doc_id", "headline", "category", F.col("published_at").alias("updated_at"), "fetched_at")
    late = a.filter("doc_id % 4 = 0").select("doc_id", F.upper("headline").alias("headline"), "category", (F.col("updated_at") + F.expr("interval 1 day")).alias("updated_at"), (F.col("fetched_at") + F.expr("interval 1 day")).alias("fetched_at"))
    return a, late


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(headline) ELSE headline END AS headline, cast(epoch(fetched_at) AS bigint) AS fetched FROM articles")
def s3_upsert(spark, d):
    return S.upsert_articles(*_upserts(spark, d)).select("doc_id", "headline", F.col("fetched_at").cast("long").alias("fetched"))


def _table(spark, d):
    """The articles as a table parted by day, after upserts of a third of its days' rows, twice the same."""
    a, late = _upserts(spark, d)
    path, day = _tmp(spark, "articles"), F.to_date("published_at").alias("published_date")
    days = V.articles(spark, d).select("doc_id", X.article_id(F.col("source"), F.col("url"), F.col("published_at")).alias("id"), day)
    tables.upsert_table(path, a.join(days, "doc_id"), "doc_id")
    for _ in range(2):
        tables.upsert_table(path, late.join(days, "doc_id"), "doc_id")
    return path, days


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(headline) ELSE headline END AS headline, cast(epoch(fetched_at) AS bigint) AS fetched, cast(published_at AS date) AS published_date FROM articles")
def s3_upsert_table(spark, d):
    return spark.read.parquet(_table(spark, d)[0]).select("doc_id", "headline", F.col("fetched_at").cast("long").alias("fetched"), "published_date")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND cast(published_at AS date) = DATE '2024-01-01' THEN 'merged' WHEN doc_id % 4 = 0 THEN upper(headline) ELSE headline END AS headline FROM articles")
def s4_patch_table(spark, d):
    path, days = _table(spark, d)
    tables.patch_table(path, days.filter("doc_id % 4 = 0 and published_date = date '2024-01-01'").select("doc_id", "published_date", F.lit("merged").alias("headline")), "doc_id")
    return spark.read.parquet(path).select("doc_id", "headline")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'merged' ELSE headline END AS headline, CASE WHEN doc_id % 8 = 0 THEN 'world' ELSE category END AS category FROM articles")
def s4_merge_fields(spark, d):
    a = V.articles(spark, d).select("doc_id", "headline", "category")
    patch = a.filter("doc_id % 4 = 0").select("doc_id", F.lit("merged").alias("headline"), F.when(F.col("doc_id") % 8 == 0, "world").alias("category"))
    return S.merge_fields(a, patch, "doc_id")


@query("""SELECT feed, cast(epoch(max(ts)) AS bigint) AS last_poll, arg_max(error, ts) FILTER (NOT ok) AS last_error, count(*) AS total_polls, sum(found)::bigint AS total_articles, count(*) FILTER (NOT ok AND (g IS NULL OR ts > g)) AS consecutive_failures
 FROM (SELECT *, max(ts) FILTER (ok) OVER (PARTITION BY feed) AS g FROM fetch_log) GROUP BY 1""".replace("cast(epoch(max(ts)) AS bigint)", "cast(floor(epoch(max(ts))) AS bigint)"))
def s5_feed_state(spark, d):
    return S.feed_state(V.fetch_log(spark, d)).select("feed", F.floor(F.col("last_poll").cast("double")).alias("last_poll"), "last_error", "total_polls", "total_articles", "consecutive_failures")


@query("SELECT doc_id FROM articles WHERE doc_id % 13 = 0")
def s6_articles_by_id(spark, d):
    """Of the table parted by day: the day that an id holds prunes its partitions."""
    path, days = _table(spark, d)
    return S.articles_by_id(spark.read.parquet(path), days.filter("doc_id % 13 = 0").select("id")).select("doc_id")


@query("SELECT doc_id, category FROM articles")
def s7_article_changes(spark, d):
    path = _tmp(spark, "changes")
    V.articles(spark, d).select("doc_id", "category").repartition(4).write.parquet(path)
    changes = S.article_changes(spark, path, spark.read.parquet(path).schema, files=2)
    out = _tmp(spark, "seen")
    K.drain(changes, _tmp(spark, "state"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select("doc_id", "category")


@query("SELECT doc_id, category FROM articles")
def s7_article_rows(spark, d):
    """The same by a source that counts rows, not files: 500 a trigger here. The files of each of the three writers are a lane."""
    path, out, state = _tmp(spark, "changes"), _tmp(spark, "seen"), _tmp(spark, "state")
    V.articles(spark, d).select("doc_id", "category").repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    changes = [rows.row_changes(spark, path, schema, 500, lane, 3) for lane in range(3)]
    # A batch that runs again overwrites its folder, so one commit of its task's file is enough.
    quick = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "mapreduce.fileoutputcommitter.algorithm.version": "2"}
    rows.drain_lanes(changes, lambda lane: f"{state}/{lane}", lambda df, lane, n: df.write.mode("overwrite").options(**quick).parquet(f"{out}/lane={lane}/batch={n}"))
    return spark.read.schema("doc_id long, category string").parquet(out).select("doc_id", "category")


@query("SELECT least(300, count(*))::bigint AS positive, 200::bigint AS negative FROM articles a JOIN articles b ON a.story_id = b.story_id AND a.doc_id < b.doc_id")
def s8_pairs(spark, d):
    pairs = J.positive_pairs(V.members(spark, d), 300).unionByName(J.easy_negatives(V.articles(spark, d), 20, 200))
    return S.write_pairs(pairs, _tmp(spark, "pairs"))


@query("SELECT count(*) FILTER (published_at >= TIMESTAMP '2024-01-03' - INTERVAL 2 DAY) AS stay, count(*) FILTER (published_at < TIMESTAMP '2024-01-03' - INTERVAL 2 DAY) AS go FROM articles")
def s9_retention(spark, d):
    return S.apply_retention(V.articles(spark, d), "published_at", 2, F.lit("2024-01-03 00:00:00").cast("timestamp"), dry_run=True)


@query("SELECT event_id, event_type AS text, cast(json_extract_string(props, '$.k') AS int) AS k FROM events")
def s10_parse_events(spark, d):
    log = V.table(spark, d, "events").select("event_id", F.concat_ws(" | ", "event_type", "props").alias("message"))
    return S.parse_events(log, "k int").select("event_id", "text", "payload.k")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {q}" for k, q in (("view", "view"), ("like", '"like"'), ("save", "save"), ("source_click", "source_click"))) + ", round(sum(dwell), 4) AS dwell FROM interactions GROUP BY 1")
def s11_interaction_stats(spark, d):
    return S.interaction_stats(V.interactions(spark, d))


@query("SELECT user_id, token FROM (SELECT user_id, 't' || (story_id % 3) AS token, arg_max(kind <> 'save', ts) AS o FROM interactions GROUP BY 1, 2) WHERE o")
def s12_token_state(spark, d):
    e = V.interactions(spark, d).select("user_id", F.concat(F.lit("t"), (F.col("story_id") % 3).cast("string")).alias("token"), "ts", "event_id", (F.col("kind") != "save").alias("on"))
    return S.token_state(e)


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'dark' ELSE 'light' END AS theme, lower(c_mktsegment) AS segment FROM customer")
def s13_preferences(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.create_map(F.lit("theme"), F.lit("light"), F.lit("segment"), F.lower("c_mktsegment")).alias("preferences"))
    patch = c.filter("user_id % 2 = 0").select("user_id", F.create_map(F.lit("theme"), F.lit("dark")).alias("patch"))
    return S.merge_preferences(c, patch).select("user_id", F.col("preferences")["theme"].alias("theme"), F.col("preferences")["segment"].alias("segment"))


@query(f"""{CENT}, mt AS (SELECT vec_id AS doc_id, story_id FROM (SELECT vec_id, story_id, row_number() OVER (PARTITION BY vec_id ORDER BY round({COS.format('embedding', 'centroid')}, 6) DESC, story_id) AS r, round({COS.format('embedding', 'centroid')}, 6) AS s FROM embeddings, cent) WHERE r = 1 AND s >= 0.3),
 f AS (SELECT a.*, mt.story_id AS m FROM articles a LEFT JOIN mt USING (doc_id) WHERE NOT processed AND (epoch({T}) - epoch(published_at)) // 86400 <= 7), have AS (SELECT DISTINCT label AS m, source FROM embeddings JOIN articles ON vec_id = doc_id WHERE processed)
 SELECT min(doc_id) AS doc_id, m::bigint AS story_id, false AS created FROM f WHERE m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM have h WHERE h.m = f.m AND h.source = f.source) GROUP BY m, source UNION ALL SELECT doc_id, -doc_id - 1, true FROM f WHERE m IS NULL""")
def k1_cluster_batch(spark, d):
    a = V.articles(spark, d)
    v = V.vectors(spark, d)
    with_vectors = a.join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    matches = J.match_stories(with_vectors, _vector_stories(spark, d), 0.3, 0.3)
    have = v.join(a.filter("processed"), v.vec_id == a.doc_id).select(v.story_id, "source")
    return C.assign_batch(a, matches, have, V.asof()).select("doc_id", F.col("story_id").cast("long").alias("story_id"), "created")


@query()
def k1_cluster_stream(spark, d):
    a = V.articles(spark, d)
    v = V.vectors(spark, d)
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    _land(a, path)
    have = v.select(F.col("story_id").cast("long").alias("story_id"), F.col("vec_id").alias("doc_id")).join(a.filter("processed").select("doc_id", "source", "tier", "published_at"), "doc_id", "left")
    stories = _vector_stories(spark, d).select(F.col("story_id").cast("long").alias("story_id"), "title", "centroid", "last_updated")
    K.cluster_stream(S.article_changes(spark, path, a.schema, files=2), _tmp(spark, "state"), stories, have, v.select("vec_id", "embedding"), V.asof(), out, 0.3, 0.3)
    return spark.read.parquet(f"{out}/members").select("doc_id", "story_id", "created")


def _land(a, path, slices=4, files=2, at="published_at"):
    """Rows as change files of equal spans of time, one span after the other, so that a stream reads them in that order."""
    at = F.col(at).cast("long")
    lo, hi = a.agg(F.min(at), F.max(at)).first()
    for i in range(slices if lo is not None else 0):
        part = a.filter(F.floor((at - lo) * slices / (hi - lo + 1)) == i)
        part.repartition(files).write.mode("append").parquet(path)


_K1 = f"""{CENT}, mt AS (SELECT vec_id AS doc_id, story_id FROM (SELECT vec_id, story_id, row_number() OVER (PARTITION BY vec_id ORDER BY round({COS.format('embedding', 'centroid')}, 6) DESC, story_id) AS r, round({COS.format('embedding', 'centroid')}, 6) AS s FROM embeddings, cent) WHERE r = 1 AND s >= 0.3)"""


def _matches(spark, d):
    a, v = V.articles(spark, d), V.vectors(spark, d)
    return J.match_stories(a.join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id"), _vector_stories(spark, d), 0.3, 0.3)


@query(f"{_K1} SELECT doc_id, processed OR (epoch({T}) - epoch(published_at)) // 86400 <= 7 AS processed, CASE WHEN NOT processed AND (epoch({T}) - epoch(published_at)) // 86400 <= 7 THEN coalesce(mt.story_id, -doc_id - 1) END AS story_id FROM articles a LEFT JOIN mt USING (doc_id)".replace("a LEFT", "AS a LEFT").replace("mt.story_id", "mt.story_id::bigint"))
def k2_mark_processed(spark, d):
    """Every article that a run looked at is marked, with the story that took it or that it started; a second run finds none."""
    a = V.articles(spark, d)
    looked = C.fresh_articles(a, V.asof()).select("doc_id").join(_matches(spark, d).select("doc_id", F.col("story_id").cast("long").alias("match")), "doc_id", "left")
    rows = a.select("doc_id", "processed", F.lit(None).cast("long").alias("story_id"))
    return C.mark_processed(rows, looked.select("doc_id", F.coalesce("match", -F.col("doc_id") - 1).alias("story_id")))


@query(f"{_K1} SELECT -doc_id - 1 AS story_id, headline AS title, category, 'NEW' AS status, 1 AS verification_level, 1 AS source_count, published_at AS first_seen, CASE WHEN tier = 1 THEN 70 ELSE 50 END AS importance, 40 AS confidence, tier = 1 AS breaking FROM articles WHERE NOT processed AND (epoch({T}) - epoch(published_at)) // 86400 <= 7 AND doc_id NOT IN (SELECT doc_id FROM mt)")
def p29_new_stories(spark, d):
    """The stories that unmatched articles start."""
    return C.new_stories(C.fresh_articles(V.articles(spark, d), V.asof()).join(_matches(spark, d).select("doc_id"), "doc_id", "left_anti"))


@query("""SELECT story_id, count(DISTINCT source)::int AS source_count, CASE WHEN count(DISTINCT source) >= 5 THEN 'TOP_STORY' WHEN count(DISTINCT source) >= 3 THEN 'VERIFIED' WHEN count(DISTINCT source) = 2 THEN 'DEVELOPING' ELSE 'NEW' END AS status, min(tier) = 1 OR count(DISTINCT source) >= 3 AS breaking FROM articles GROUP BY 1""")
def k2_refresh_stories(spark, d):
    return C.refresh_stories(V.members(spark, d), V.vectors(spark, d)).select("story_id", "source_count", "status", "breaking")


@query("SELECT story_id FROM stories WHERE summary IS NULL OR source_count > story_id % 4")
def k3_summary_triggers(spark, d):
    return K.summary_triggers(V.stories(spark, d).withColumn("summary_sources", F.col("story_id") % 4)).select("story_id")


@query("SELECT story_id FROM stories WHERE source_count BETWEEN 3 AND 4 AND last_updated <= first_seen + INTERVAL 30 MINUTE")
def k4_notify_stream(spark, d):
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    s = V.stories(spark, d).select("story_id", "source_count", "first_seen", "last_updated")
    s.unionByName(s.filter("story_id % 2 = 0")).write.parquet(path)
    stream = K.notify_stream(S.article_changes(spark, path, s.schema, files=100), "400 days")
    K.drain(stream, _tmp(spark, "state"), lambda df, n: df.select("story_id").write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select("story_id")


@query("""SELECT feed, event_id FROM (WITH RECURSIVE l AS (SELECT feed, event_id, cast(floor(epoch(ts)) AS bigint) AS t FROM fetch_log), c(feed, event_id, t) AS (SELECT feed, arg_min(event_id, (t, event_id)), min(t) FROM l GROUP BY 1
 UNION ALL SELECT feed, event_id, t FROM (SELECT l.feed, l.event_id, l.t, row_number() OVER (PARTITION BY l.feed ORDER BY l.t, l.event_id) AS r FROM c JOIN l ON l.feed = c.feed AND l.t >= c.t + 86400) WHERE r = 1) SELECT * FROM c)""")
def k5_cooldown(spark, d):
    """Requests let through a day's cooldown, over several micro-batches."""
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    log = V.fetch_log(spark, d).select("feed", "ts", "event_id")
    _land(log, path, at="ts")
    K.drain(K.cooldown(S.article_changes(spark, path, log.schema, files=2), 86400), _tmp(spark, "state"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select("feed", "event_id")


_BREAKER = """, lg AS (SELECT *, epoch_us(ts) AS us, sum(ok::int) OVER w AS island, lead(epoch_us(ts)) OVER w AS nxt, max(epoch_us(ts)) OVER () AS wm FROM fetch_log WINDOW w AS (PARTITION BY feed ORDER BY ts, event_id)),
 ct AS (SELECT *, CASE WHEN ok THEN 0 ELSE row_number() OVER (PARTITION BY feed, island, ok ORDER BY ts, event_id) END AS c FROM lg), st AS (SELECT *, lag(c, 1, 0) OVER w AS pc, us - lag(us) OVER w AS gap FROM ct WINDOW w AS (PARTITION BY feed ORDER BY ts, event_id)),
 ch AS (SELECT feed, us, 'open' AS state, c AS consecutive FROM st WHERE c >= 3 AND (pc < 3 OR gap > 1800000000) UNION ALL SELECT feed, us, 'closed', c FROM st WHERE c < 3 AND pc >= 3
 UNION ALL SELECT feed, us + 1800000000, 'half_open', c FROM st WHERE c >= 3 AND coalesce(nxt - us > 1800000000, us + 1800000000 < wm))"""


def _breakers(spark, d):
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    log = V.fetch_log(spark, d).select("feed", "ts", "event_id", "ok")
    _land(log, path, at="ts")
    K.drain(K.breaker_stream(S.article_changes(spark, path, log.schema, files=2)), _tmp(spark, "state"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema("feed long, at timestamp, state string, consecutive long").parquet(out)


@query(f"{_BREAKER} SELECT feed, us, state, consecutive FROM ch")
def k6_breaker_stream(spark, d):
    """All changes of the breakers over several micro-batches; what is half open by a timer or by a later outcome."""
    return _breakers(spark, d).select("feed", F.unix_micros("at").alias("us"), "state", "consecutive")


@query(f"{_BREAKER} SELECT feed, state, consecutive FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY us DESC, state = 'half_open') AS r FROM ch WHERE us <= epoch_us(TIMESTAMP '2024-01-30')) WHERE r = 1")
def k6_breakers_at(spark, d):
    """The breakers as of the end of January."""
    return K.breakers_at(_breakers(spark, d), F.lit("2024-01-30 00:00:00").cast("timestamp")).select("feed", "state", "consecutive")


@query("SELECT cast(epoch(time_bucket(INTERVAL 5 MINUTE, fetched_at, TIMESTAMP '1970-01-01')) AS bigint) AS start, count(*) AS n FROM articles GROUP BY 1")
def k7_ingest_windows(spark, d):
    return K.ingest_windows(V.articles(spark, d))


def _streamed_windows(spark, d, width):
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    a = V.articles(spark, d).select("doc_id", "source", "fetched_at")
    _land(a, path, at="fetched_at")
    stream = K.ingest_windows(S.article_changes(spark, path, a.schema, files=2), width, "2 minutes", sources=True)
    K.drain(stream, _tmp(spark, "state"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema("start long, n long, sources int").parquet(out).select("start", "n", "sources")


_CLOSED = "SELECT cast(epoch(w) AS bigint) AS start, count(*) AS n, count(DISTINCT source)::int AS sources FROM (SELECT *, time_bucket(INTERVAL {0} MINUTE, fetched_at, TIMESTAMP '1970-01-01') AS w, max(fetched_at) OVER () AS newest FROM articles) WHERE w + INTERVAL {0} MINUTE <= newest - INTERVAL 2 MINUTE GROUP BY w"


@query(_CLOSED.format(1))
def k7_ingest_stream_1(spark, d):
    """Windows of a minute as a stream gives them: each once, when the watermark has passed its end."""
    return _streamed_windows(spark, d, "1 minute")


@query(_CLOSED.format(5))
def k7_ingest_stream_5(spark, d):
    return _streamed_windows(spark, d, "5 minutes")


@query(f"SELECT source, cast(epoch(m) AS bigint) AS last_fetched, coalesce(m <= {T} - INTERVAL 100 MINUTE, true) AS inactive FROM (SELECT DISTINCT 'src' || feed AS source FROM feeds UNION SELECT DISTINCT source FROM articles WHERE source IS NOT NULL) LEFT JOIN (SELECT source, max(fetched_at) AS m FROM articles WHERE fetched_at <= {T} GROUP BY 1) USING (source)")
def k7_feed_activity(spark, d):
    expected = V.feeds(spark, d).select(F.concat(F.lit("src"), F.col("feed").cast("string")).alias("source")).union(V.articles(spark, d).select("source").filter("source is not null"))
    rows = K.feed_activity(expected, V.articles(spark, d), V.asof(), 100)
    return rows.withColumn("last_fetched", F.col("last_fetched").cast("long"))


@query(f"SELECT count(*) FILTER (fetched_at > {T} - INTERVAL 5 MINUTE AND fetched_at <= {T}) AS n, count(*) FILTER (fetched_at > {T} - INTERVAL 5 MINUTE AND fetched_at <= {T}) > 0 AS active FROM articles")
def k7_ingest_active(spark, d):
    return K.ingest_active(V.articles(spark, d), V.asof())


@query(f"{_J15} SELECT doc_id FROM xd WHERE doc_id = f AND doc_id NOT IN (SELECT doc_id FROM yc WHERE doc_id <> f) AND doc_id NOT IN (SELECT y.doc_id FROM yr x JOIN yr y ON (x.since < y.since OR x.since = y.since AND x.doc_id < y.doc_id) AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) BETWEEN 1 AND 3 AND y.since - x.until <= {_WEEK})")
def k8_near_dedup_stream(spark, d):
    """What is left of the articles, over several micro-batches."""
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    a = V.articles(spark, d).select("doc_id", "headline", "description", "url", "published_at")
    _land(a, path)
    K.near_dedup_stream(S.article_changes(spark, path, a.schema, files=2), _tmp(spark, "state"), out)
    return spark.read.parquet(f"{out}/kept").select("doc_id")


@query("SELECT count(DISTINCT md5(lower(title) || '|' || 'news.example')) AS n FROM articles")
def k8_dedup_stream(spark, d):
    path, out = _tmp(spark, "in"), _tmp(spark, "out")
    a = V.articles(spark, d).select("doc_id", "title", "url", "published_at")
    a.write.parquet(path)
    K.drain(K.dedup_stream(S.article_changes(spark, path, a.schema, files=100)), _tmp(spark, "state"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@query(""", f AS (SELECT story_id, source, min(doc_id) AS doc_id FROM articles GROUP BY 1, 2), r AS (SELECT story_id, doc_id, row_number() OVER (PARTITION BY story_id ORDER BY doc_id) AS n FROM f)
 SELECT story_id, doc_id, CASE WHEN n = 5 THEN 'TOP_STORY' WHEN n = 3 THEN 'VERIFIED' WHEN n = 2 THEN 'DEVELOPING' ELSE 'NEW' END AS status FROM r WHERE n IN (1, 2, 3, 5)""")
def k9_status_history(spark, d):
    return C.status_history(V.members(spark, d))


@query(f"SELECT story_id, epoch({T}) - epoch(last_updated) > 3600 AS demote, epoch({T}) - epoch(last_updated) > 604800 AS archive FROM stories")
def k9_eligibility(spark, d):
    return C.eligibility(V.stories(spark, d), V.asof())


@query("SELECT conv_id AS batch_id, count(*) AS requests, count(*) FILTER (turn % 4 < 2) AS succeeded, count(*) FILTER (turn % 4 = 2) AS errored, count(*) FILTER (turn % 4 = 3) AS expired, 'completed' AS status FROM conversations GROUP BY 1")
def k10_batch_results(spark, d):
    return C.ingest_batch_results(_results(spark, d), V.stories(spark, d))[0]


def _batches(spark, d):
    """Tracked batches, a conversation each: of five one failed, one runs on, one is unknown, one was completed before."""
    k = F.col("batch_id")
    rows = _results(spark, d)
    story = F.map_from_entries(F.collect_list(F.when(F.col("story_id") % 3 > 0, F.struct("story_id", F.concat(F.lit("c"), (F.col("story_id") % 4).cast("string"))))))
    counts = F.map_from_entries(F.collect_list(F.when(F.col("story_id") % 3 > 0, F.struct("story_id", (F.col("story_id") % 5).cast("int")))))
    tracking = rows.groupBy("batch_id").agg(story.alias("story_categories"), counts.alias("story_counts")).withColumn("status", F.when(k % 5 == 4, "completed").when(k % 2 == 0, "submitted").otherwise("in_progress"))
    batches = rows.select("batch_id").distinct().filter(k % 5 != 3).select("batch_id", F.when(k % 5 == 2, "in_progress").otherwise("ended").alias("processing"), F.when(k % 5 == 1, "no such batch").alias("error"))
    return tracking, batches, rows


@query(f"""SELECT conv_id AS batch_id, CASE conv_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 4 THEN 'completed' ELSE CASE WHEN conv_id % 2 = 0 THEN 'submitted' ELSE 'in_progress' END END AS status, CASE WHEN conv_id % 5 = 0 THEN cast(epoch({T}) AS bigint) END AS ended, CASE WHEN conv_id % 5 = 0 THEN count(*) FILTER (turn % 4 < 2) END AS succeeded_count,
 CASE WHEN conv_id % 5 = 0 THEN count(*) FILTER (turn % 4 >= 2) END AS errored_count, CASE WHEN conv_id % 5 = 1 THEN 'no such batch' END AS error FROM conversations GROUP BY 1""")
def k10_tracking(spark, d):
    """What becomes of the tracked batches: completed with counts, failed with the error, or as they were."""
    tracking, batches, results = _batches(spark, d)
    made = C.update_tracking(tracking, batches, results, V.asof())
    return made.select("batch_id", "status", F.col("ended_at").cast("long").alias("ended"), "succeeded_count", "errored_count", "error")


@query(f""", fb AS ({_FALLBACK}), rs AS (SELECT conv_id AS batch_id, conv_id * 12 + turn AS story_id, trim(CASE WHEN conv_id % 7 = 0 THEN 'I cannot say. ' || text ELSE ' ' || text || ' ' END, ' ') AS text, turn FROM conversations WHERE turn % 4 < 2 AND conv_id % 5 IN (0, 4)),
 fd AS (SELECT batch_id, rs.story_id, turn, CASE WHEN regexp_matches(lower(text), '{any_of(vocab.REFUSALS_LIVE)}') THEN fb.summary ELSE text END AS summary FROM rs JOIN stories s ON s.story_id = rs.story_id LEFT JOIN fb ON fb.story_id = rs.story_id)
 SELECT batch_id, story_id, len({WORDS.format('summary')})::int AS words, 1 AS version, CASE WHEN story_id % 3 > 0 THEN 'c' || (story_id % 4) ELSE 'general' END AS category, CASE WHEN story_id % 3 > 0 THEN (story_id % 5)::int ELSE 1 END AS source_count, round(((1000 + story_id - 100 * turn) * 0.5 + 100 * turn * 0.05 + (50 + turn) * 2.5) / 1000000, 6)::double AS cost_usd FROM fd WHERE summary IS NOT NULL""")
def k10_summaries_of_ended(spark, d):
    """Summaries of the batches that ended well, as tracked, with their cost at batch prices."""
    tracking, batches, results = _batches(spark, d)
    s = V.stories(spark, d)
    made = C.ingest_batch_results(results, s, A.fallback_summary(s, V.articles(spark, d)), batches)[1]
    turn = F.col("story_id") - F.col("batch_id") * 12
    usage = results.select("batch_id", "story_id", (F.col("story_id") + 1000).alias("input"), (100 * turn).alias("cached"), (50 + turn).alias("output"))
    return C.batch_summaries(made, tracking, usage).drop("summary")


def _results(spark, d):
    """Answers of batches: a turn of a conversation each, one in seven conversations refused."""
    kind = F.when(F.col("turn") % 4 < 2, "succeeded").when(F.col("turn") % 4 == 2, "errored").otherwise("expired")
    text = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("I cannot say. "), F.col("text"))).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
    return V.table(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), (F.col("conv_id") * 12 + F.col("turn")).alias("story_id"), kind.alias("type"), text.alias("text"))


@query(f""", fb AS ({_FALLBACK}), rs AS (SELECT conv_id AS batch_id, conv_id * 12 + turn AS story_id, trim(CASE WHEN conv_id % 7 = 0 THEN 'I cannot say. ' || text ELSE ' ' || text || ' ' END, ' ') AS text FROM conversations WHERE turn % 4 < 2),
 fd AS (SELECT batch_id, rs.story_id, CASE WHEN regexp_matches(lower(text), '{any_of(vocab.REFUSALS_LIVE)}') THEN fb.summary ELSE text END AS summary FROM rs JOIN stories s ON s.story_id = rs.story_id LEFT JOIN fb ON fb.story_id = rs.story_id)
 SELECT batch_id, story_id, summary, len({WORDS.format('summary')})::int AS words FROM fd WHERE summary IS NOT NULL""")
def k10_batch_summaries(spark, d):
    s = V.stories(spark, d)
    return C.ingest_batch_results(_results(spark, d), s, A.fallback_summary(s, V.articles(spark, d)))[1]


def _merging(spark, d):
    """Stories of two members and more that stay active for half a day to a day and a half, with what their titles name."""
    s = V.stories(spark, d)
    found = entities(F.col("title"))
    low = lambda x: F.array_distinct(F.transform(x, lambda e: F.lower(e["text"])))
    places = low(F.filter(found, lambda e: e["type"] == "LOCATION"))
    last = F.timestamp_seconds(F.col("last_updated").cast("long") + 43200 * (F.col("story_id") % 3 + 1))
    return s.withColumns({"last_updated": last, "names": low(found), "places": places, "signature": X.event_signature(F.col("title"), F.lit(""), found)})


_MCAP = f"list_filter({WORDS.format('title')}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND length(w) > 2)"
_MC = f""", mw AS (SELECT story_id, category, n_articles, epoch(first_seen) AS s, epoch(last_updated) + 43200 * (story_id % 3 + 1) AS e, title, list_transform({_MCAP}, lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')) AS ws FROM stories WHERE n_articles >= 2),
 mx AS (SELECT *, list_distinct(list_transform(ws, lambda w: lower(w))) AS names, list_transform(list_filter(ws, lambda w: w IN {vocab.COUNTRIES} OR ends_with(w, 'land') OR ends_with(w, 'stan')), lambda w: lower(w)) AS places, lower(title || ' ') AS t FROM mw),
 my AS (SELECT *, {any_list(vocab.EVENT_TYPES)} AS types, list_sort(list_filter(list_transform({lst(vocab.ACTIONS)}, lambda v: {{'p': coalesce(list_position(toks, v), 0), 'v': v}}), lambda x: x.p > 0))[1:3] AS v FROM (SELECT *, list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS toks FROM mx)),
 ms AS (SELECT *, list_transform(v, lambda x: x.v) AS verbs, list_distinct(list_transform(ws, lambda w: lower(w))[1:5]) AS five FROM my WHERE floor((epoch(TIMESTAMP '2024-01-03') - e) / 86400) BETWEEN 0 AND 7 AND len(names) > 0),
 mc AS (SELECT a.story_id AS a, b.story_id AS b, a.n_articles AS na, b.n_articles AS nb, round({JAC.format('a.names', 'b.names')}, 6)::double AS jaccard FROM ms a JOIN ms b ON a.category = b.category AND a.story_id < b.story_id AND least(a.e, b.e) > greatest(a.s, b.s)
 WHERE {JAC.format('a.names', 'b.names')} >= 0.6 AND (least(a.e, b.e) - greatest(a.s, b.s)) / greatest(a.e - a.s, b.e - b.s) >= 0.5 AND CASE WHEN len(a.places) > 0 AND len(b.places) > 0 THEN {JAC.format('list_distinct(a.places)', 'list_distinct(b.places)')} ELSE 0.5 END >= 0.7
 AND round(0.4 * ({JAC.format('a.verbs', 'b.verbs')}) + 0.3 * ({JAC.format('a.types', 'b.types')}) + 0.3 * ({JAC.format('a.five', 'b.five')}), 9) >= 0.8)"""


@query(f"{_MC} SELECT a, b, jaccard FROM mc")
def m1_merge_candidates(spark, d):
    return C.merge_candidates(_merging(spark, d), F.lit("2024-01-03 00:00:00").cast("timestamp"))


@query(f"""{_MC}, mv AS (SELECT CASE WHEN nb > na THEN a ELSE b END AS s, CASE WHEN nb > na THEN b ELSE a END AS t, greatest(na, nb) AS n FROM mc), b AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS r FROM mv) WHERE r = 1), st AS (SELECT * FROM b WHERE t NOT IN (SELECT s FROM b)),
 mm AS (SELECT coalesce(t, story_id) AS story_id, doc_id FROM articles LEFT JOIN st ON s = story_id), mh AS (SELECT story_id, name, count(*) AS n FROM mm JOIN (SELECT doc_id, unnest(list_distinct({WORDS.format('lower(headline)')})) AS name FROM articles) USING (doc_id) GROUP BY 1, 2)
 SELECT l.story_id, level, names, most, vectors FROM (SELECT story_id, count(*) AS level, count(vec_id) > 0 AS vectors FROM mm LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1) l LEFT JOIN (SELECT story_id, count(*)::int AS names, max(n) AS most FROM mh GROUP BY 1) h ON h.story_id = l.story_id""")
def m2_merge_clusters(spark, d):
    """Stories after a run of merging, with their level, their histogram's size and largest count, and whether they have a centroid."""
    merged = C.merge_clusters(V.members(spark, d).select("story_id", "doc_id"), C.merge_candidates(_merging(spark, d), F.lit("2024-01-03 00:00:00").cast("timestamp")))
    names = V.articles(spark, d).select("doc_id", F.explode(F.array_distinct(X.words(F.lower("headline")))).alias("name"))
    p = C.merged_profiles(merged, names, V.vectors(spark, d))
    return p.select("story_id", "level", F.size("histogram").alias("names"), F.array_max(F.map_values("histogram")).alias("most"), F.col("centroid").isNotNull().alias("vectors"))


@query(""", m AS (SELECT doc_id % 20 AS story_id, doc_id, published_at FROM articles), n AS (SELECT story_id, count(*) AS n, epoch(max(published_at)) - epoch(min(published_at)) AS s FROM m GROUP BY 1),
 r AS (SELECT m.*, row_number() OVER (PARTITION BY story_id ORDER BY published_at, doc_id) AS r FROM m) SELECT r.story_id, doc_id, (CASE WHEN n >= 10 AND s >= 21600 THEN CASE WHEN r * 2 > n THEN 2 ELSE 1 END ELSE 0 END)::int AS part FROM r JOIN n ON r.story_id = n.story_id""")
def m3_split_clusters(spark, d):
    m = V.members(spark, d).withColumn("story_id", F.col("doc_id") % 20)
    return C.split_clusters(m, 10, 0.25)


@query()
def m3_split_by_vectors(spark, d):
    v = V.vectors(spark, d).select(F.col("story_id").cast("long").alias("story_id"), F.col("vec_id").alias("doc_id"), "embedding")
    return C.split_by_vectors(v)


@query()
def m3_separation(spark, d):
    """How well two parts part the vectors of each label."""
    v = V.vectors(spark, d).select(F.col("story_id").cast("long").alias("story_id"), F.col("vec_id").alias("doc_id"), "embedding")
    return C.separation(v)


@query("SELECT story_id, CASE WHEN n_articles = 1 AND a > 14 THEN 'single' WHEN a > 30 THEN 'old' WHEN n_articles <= 2 AND a > 21 THEN 'small' END AS reason FROM (SELECT *, (epoch(TIMESTAMP '2024-01-23') - epoch(last_updated)) / 86400 AS a FROM stories) WHERE (n_articles = 1 AND a > 14) OR a > 30 OR (n_articles <= 2 AND a > 21)")
def m4_decay(spark, d):
    return C.decay(V.stories(spark, d), F.lit("2024-01-23 00:00:00").cast("timestamp"))


@query("SELECT c_custkey, CASE WHEN b < 3000 THEN 'a' WHEN b < 8000 THEN 'b' ELSE 'control' END AS variant FROM (SELECT c_custkey, md5_number('exp:' || c_custkey) AS h, ((('0x' || md5('exp:' || c_custkey)[1:16])::ubigint::hugeint % 10000) * 1616 + ('0x' || md5('exp:' || c_custkey)[17:32])::ubigint::hugeint % 10000) % 10000 AS b FROM customer)")
def m5_assign_variant(spark, d):
    return C.assign_variant(V.table(spark, d, "customer").select("c_custkey"), "c_custkey", "exp", {"a": 0.3, "b": 0.5, "control": 0.2})


@query("SELECT step::int AS step, r_name AS variant, round(0.2 + (r_regionkey / 10 - 0.2) * step / 4, 6)::double AS share FROM region, range(1, 5) t(step)")
def m6_rollout_plan(spark, d):
    r = V.table(spark, d, "region")
    return C.rollout_plan(r.select(F.col("r_name").alias("variant"), F.lit(0.2).alias("share")), r.select(F.col("r_name").alias("variant"), (F.col("r_regionkey") / 10).alias("share")), 4)


@query(f"""{_SIG}, ne AS (SELECT doc_id, count(*)::int AS n FROM ents GROUP BY 1){_LINKS.removeprefix(ENTITIES)}, nl AS (SELECT doc_id, count(*)::int AS n FROM links GROUP BY 1)
 SELECT a.doc_id, coalesce(ne.n, 0) AS n_entities, coalesce(nl.n, 0) AS n_links, CASE WHEN confidence >= 0.3 THEN md5(CASE WHEN parts = '' THEN 'none' ELSE parts END)[1:12] END AS signature, vec_id IS NOT NULL AS has_vector
 FROM articles a JOIN sh ON sh.doc_id = a.doc_id LEFT JOIN ne ON ne.doc_id = a.doc_id LEFT JOIN nl ON nl.doc_id = a.doc_id LEFT JOIN embeddings ON vec_id = a.doc_id WHERE processed""")
def m7_enrich(spark, d):
    """Processed articles with their entities, linked ones, a signature of some confidence, and a vector if there is one."""
    a = V.with_entities(V.articles(spark, d).filter("processed"))
    s = a.withColumn("signature", X.event_signature(F.col("headline"), F.col("description"), F.col("entities")))
    v = V.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    linked = _links(spark, d).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_links"))
    rows = s.join(v, "doc_id", "left").join(linked, "doc_id", "left")
    return rows.select("doc_id", F.size("entities").alias("n_entities"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("signature.confidence") >= 0.3, F.col("signature.hash")).alias("signature"), F.col("embedding").isNotNull().alias("has_vector"))
