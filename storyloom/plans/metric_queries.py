"""Registered queries of the metrics."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import articles as A
from ..operators import metrics as M
from . import views as V
from .text_queries import BARE, _key, _prop, WORDS
from .views_sql import T, query


def rate(n, of):
    return f"CASE WHEN {of} > 0 THEN round({n} / {of}, 6) ELSE 0.0 END"


def since(c, i):
    return f"({c} > {T} - INTERVAL {i} AND {c} <= {T})"


HAS = "length(coalesce(summary, '')) > 0"


@query("SELECT * FROM (SELECT count(*) AS articles, count(*) FILTER (processed) AS processed, count(DISTINCT source) AS sources, cast(epoch(max(published_at)) AS bigint) AS latest, cast(epoch(min(published_at)) AS bigint) AS oldest FROM articles), (SELECT count(*) AS stories, count(*) FILTER (breaking) AS breaking, count(*) FILTER (source_count >= 2) AS multi FROM stories)")
def a1_table_stats(spark, d):
    return M.table_stats(V.articles(spark, d), V.stories(spark, d))


@query("SELECT category, count(*) AS n FROM stories GROUP BY 1")
def a2_counts_by(spark, d):
    return M.counts_by(V.stories(spark, d), "category")


@query("SELECT source, n, round(n / (SELECT count(*) FROM articles), 6) AS share FROM (SELECT source, count(*) AS n FROM articles GROUP BY 1) ORDER BY n DESC, source LIMIT 10")
def a3_top_sources(spark, d):
    return M.top_sources(V.articles(spark, d), 10)


@query(f"SELECT count(*) FILTER {('(WHERE ' + since('fetched_at', '24 HOUR') + ')')} AS day, count(*) FILTER (WHERE {since('fetched_at', '1 HOUR')}) AS hour, greatest(round(count(*) FILTER (WHERE {since('fetched_at', '24 HOUR')}) / 24, 6), count(*) FILTER (WHERE {since('fetched_at', '1 HOUR')})::double) AS per_hour, {rate('count(*) FILTER (processed)', 'count(*)')} AS success_rate, cast(epoch(max(fetched_at) FILTER (fetched_at <= {T})) AS bigint) AS last_run FROM articles")
def a4_ingest_stats(spark, d):
    return M.ingest_stats(V.articles(spark, d), V.asof())


_CL = f""", cl AS (SELECT *, CASE WHEN hour >= 10 AND backlog < 100 THEN 'healthy' WHEN hour > 0 THEN 'degraded' ELSE 'stalled' END AS health FROM (SELECT round(avg(source_count), 6) AS mean_sources, {rate('count(*) FILTER (source_count >= 2)', 'count(*)')} AS match_rate,
 count(*) FILTER (WHERE {since('first_seen', '24 HOUR')}) AS created, count(*) FILTER (WHERE {since('last_updated', '24 HOUR')} AND NOT {since('first_seen', '24 HOUR')}) AS updated, count(*) FILTER (WHERE {since('last_updated', '1 HOUR')}) AS hour FROM stories),
 (SELECT count(*) FILTER (NOT processed) AS backlog, count(*) FILTER (processed) AS processed, cast(floor((epoch({T}) - epoch(min(fetched_at) FILTER (NOT processed))) / 60) AS bigint) AS oldest_minutes FROM articles))"""


@query(f"{_CL} SELECT * FROM cl")
def a5_clustering_stats(spark, d):
    return M.clustering_stats(V.articles(spark, d), V.stories(spark, d), V.asof())


@query(f"SELECT * FROM (SELECT {rate(f'count(*) FILTER ({HAS})', 'count(*)')} AS coverage, count(*) FILTER (WHERE {HAS} AND {since('last_updated', '24 HOUR')}) AS day FROM stories), (SELECT round(avg(value / 100), 6) AS mean_seconds, round(avg(user_id), 6) AS mean_words, round(sum(value / 1000), 4) AS cost FROM events)")
def a6_summary_stats(spark, d):
    e = V.table(spark, d, "events").select((F.col("value") / 100).alias("seconds"), F.col("user_id").alias("words"), (F.col("value") / 1000).alias("cost"))
    return M.summary_stats(V.stories(spark, d), e, V.asof())


@query(f"SELECT count(*) AS submitted, count(*) FILTER (o_orderstatus = 'F') AS completed, {rate(chr(99) + 'ount(*) FILTER (o_orderstatus = ' + chr(39) + 'F' + chr(39) + ')', 'count(*)')} AS success_rate, count(*) FILTER (o_orderstatus = 'O') AS waiting, round(avg(o_custkey), 6) AS mean_size, round(sum(o_totalprice), 2) AS cost FROM orders")
def a7_batch_stats(spark, d):
    o = V.table(spark, d, "orders")
    return M.batch_stats(o.select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("failed").alias("status"), F.col("o_custkey").alias("request_count"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))).withColumn("cost", F.col("cost").cast("double"))


@query(f"""SELECT match_rate, diversity, CASE WHEN match_rate > 0.7 AND diversity > 0.5 THEN 'Excellent' WHEN match_rate > 0.5 AND diversity > 0.3 THEN 'Good' WHEN match_rate > 0.3 THEN 'Fair' ELSE 'Needs Improvement' END AS label
 FROM (SELECT {rate('count(*) FILTER (source_count >= 2)', 'count(*)')} AS match_rate FROM stories), (SELECT least(round((SELECT count(DISTINCT source) FROM articles) / (SELECT count(*) FROM feeds), 6), 1.0)::double AS diversity)""")
def a8_feed_quality(spark, d):
    return M.feed_quality(V.stories(spark, d), V.articles(spark, d), V.feeds(spark, d))


@query(f"""{_CL}, parts AS (SELECT 'healthy' AS database, CASE WHEN h > 0 THEN 'healthy' WHEN y > 0 THEN 'degraded' ELSE 'down' END AS ingest, health AS clustering, CASE WHEN c > 0.95 THEN 'healthy' WHEN c > 0.80 THEN 'degraded' ELSE 'down' END AS summaries, hour AS rate, processed
 FROM cl, (SELECT count(*) FILTER (WHERE {since('fetched_at', '1 HOUR')}) AS h, count(*) FILTER (WHERE {since('fetched_at', '24 HOUR')}) AS y FROM articles), (SELECT {rate(f'count(*) FILTER ({HAS})', 'count(*)')} AS c FROM stories)),
 j AS (SELECT *, CASE WHEN ingest = 'healthy' AND rate > 0 THEN 'healthy' WHEN ingest = 'healthy' OR rate > 0 OR processed > 0 THEN 'degraded' WHEN ingest = 'down' THEN 'down' ELSE 'unknown' END AS jobs FROM parts)
 SELECT database, ingest, clustering, summaries, jobs, CASE WHEN jobs = 'healthy' THEN 'healthy' WHEN jobs IN ('degraded', 'down') THEN 'degraded' ELSE database END AS overall FROM j""")
def a9_health(spark, d):
    a, s = V.articles(spark, d), V.stories(spark, d)
    none = V.table(spark, d, "events").limit(0).select(F.lit(0.0).alias("seconds"), F.lit(0).alias("words"), F.lit(0.0).alias("cost"))
    return M.health(M.ingest_stats(a, V.asof()), M.clustering_stats(a, s, V.asof()), M.summary_stats(s, none, V.asof()), s)


@query("SELECT source_count, count(*) AS n, round(count(*) / (SELECT count(*) FROM stories), 6) AS share FROM stories GROUP BY 1")
def a10_source_histogram(spark, d):
    return M.source_histogram(V.stories(spark, d))


@query(f""", k AS (SELECT story_id, sum(k - 1)::bigint AS surplus FROM (SELECT story_id, source, count(*) AS k FROM articles GROUP BY 1, 2) GROUP BY 1 HAVING sum(k) > 1)
 SELECT *, CASE WHEN percent > 10 THEN 'failing' WHEN percent > 5 THEN 'partial' ELSE 'working' END AS label FROM (SELECT count(*) FILTER (surplus > 0) AS stories, coalesce(sum(surplus), 0)::bigint AS surplus, round(100 * {rate('count(*) FILTER (surplus > 0)', 'count(*)')}, 4) AS percent FROM k)""")
def a11_duplicate_sources(spark, d):
    return M.duplicate_sources(V.members(spark, d))


@query(f"SELECT count(*) FILTER (k > 1) AS groups, sum(k - 1)::bigint AS surplus, round(sum(k - 1) / sum(k), 6) AS rate FROM (SELECT md5(trim({BARE.format('title')}, ' ')) AS fp, count(*) AS k FROM stories GROUP BY 1)")
def a12_fingerprint_collisions(spark, d):
    return M.fingerprint_collisions(V.stories(spark, d).withColumn("fp", X.title_fp(F.col("title"))))


@query(f""", m AS (SELECT story_id, list(headline ORDER BY doc_id) AS l FROM articles GROUP BY 1), p AS (SELECT story_id, l[1] AS h, l[2] AS g FROM m WHERE len(l) >= 2 ORDER BY story_id LIMIT 100),
 s AS (SELECT story_id, round(CASE WHEN len(kh) = 0 OR len(kg) = 0 THEN jac ELSE 0.40 * len(list_filter(kh, lambda w: list_contains(kg, w))) / least(len(kh), len(kg)) + CASE WHEN len(ph) > 0 AND len(pg) > 0 THEN 0.40 * len(list_intersect(ph, pg)) / least(len(ph), len(pg)) ELSE 0 END
 + 0.15 * (len(list_filter(kh, lambda w: length(w) > 4 AND contains(lower(g), w))) + len(list_filter(kg, lambda w: length(w) > 4 AND contains(lower(h), w)))) / (len(kh) + len(kg)) + 0.05 * jac END, 6) AS similarity
 FROM (SELECT *, {_key('h')} AS kh, {_key('g')} AS kg, {_prop('h')} AS ph, {_prop('g')} AS pg, len(list_intersect(th, tg)) / len(list_distinct(list_concat(th, tg))) AS jac FROM (SELECT *, list_distinct({WORDS.format('lower(h)')}) AS th, list_distinct({WORDS.format('lower(g)')}) AS tg FROM p)))
 SELECT *, CASE WHEN similarity >= 0.7 THEN 'good' WHEN similarity >= 0.5 THEN 'questionable' ELSE 'poor' END AS label FROM s""")
def a13_accuracy_sample(spark, d):
    return M.accuracy_sample(V.members(spark, d), 100)


@query("SELECT " + ", ".join(f"round(avg((length(coalesce({c}, '')) > 0)::int), 6) AS {c}" for c in ("title", "description", "text", "url")) + ", round(avg(processed::int), 6) AS processed FROM articles")
def a14_completeness(spark, d):
    return M.completeness(V.articles(spark, d))


@query(f"SELECT cast(epoch(date_trunc('minute', fetched_at)) AS bigint) AS minute, count(*) AS n, count(DISTINCT source) AS sources FROM articles WHERE {since('fetched_at', '12 HOUR')} GROUP BY 1")
def a15_per_minute(spark, d):
    return M.per_minute(V.articles(spark, d), V.asof(), "12 hours")


@query(f"SELECT *, CASE WHEN lag_s IS NULL THEN 'none' WHEN lag_s < 60 THEN 'minimal' WHEN lag_s < 300 THEN 'moderate' ELSE 'high' END AS label FROM (SELECT count(*) FILTER (NOT processed) AS backlog, cast(floor(epoch({T}) - epoch(min(fetched_at) FILTER (NOT processed))) AS bigint) AS lag_s FROM articles)")
def a16_processing_lag(spark, d):
    return M.processing_lag(V.articles(spark, d), V.asof())


@query("SELECT top_share, CASE WHEN top_share > 0.6 THEN 'critical' WHEN top_share > 0.5 THEN 'high' WHEN top_share > 0.3 THEN 'moderate' ELSE 'diverse' END AS label FROM (SELECT round(max(n) / sum(n), 6) AS top_share FROM (SELECT count(*) AS n FROM articles GROUP BY source))")
def a17_concentration(spark, d):
    return M.concentration(V.articles(spark, d))


@query(f"""SELECT duplicate_titles, round(structural, 4) AS structural, diversity, round(clustering, 4) AS clustering, round(summaries, 4) AS summaries, round(0.25 * structural + 0.25 * diversity + 0.20 * clustering + 15 + 0.15 * summaries, 4) AS score
 FROM (SELECT sum(k - 1)::bigint AS duplicate_titles FROM (SELECT count(*) AS k FROM stories GROUP BY lower(title))), (SELECT least(100.0, count(DISTINCT lower(source)) * 10.0)::double AS diversity FROM articles WHERE source <> '' AND NOT contains(lower(source), 'test') AND NOT starts_with(lower(source), 'source ')),
 (SELECT 100 * avg((length(trim(title)) >= 10 AND length(title) <= 200 AND source_count BETWEEN 1 AND 20)::int)::double AS structural, 100 * avg((n_articles BETWEEN 2 AND 8)::int)::double AS clustering, 100 * avg(({HAS})::int)::double AS summaries FROM stories)""")
def a18_quality_score(spark, d):
    s, m = V.stories(spark, d), V.members(spark, d)
    listed = s.join(m.groupBy("story_id").agg(F.collect_set("source").alias("sources")), "story_id", "left")
    return M.quality_score(s, m, A.validate_stories(listed))


@query(f"SELECT mean_hours, greatest(0.0, round(100 - 2 * mean_hours, 4)) AS score FROM (SELECT round(avg((epoch({T}) - epoch(p)) / 3600), 5) AS mean_hours FROM (SELECT max(published_at) AS p FROM articles GROUP BY story_id))")
def a19_timeliness(spark, d):
    return M.timeliness(V.members(spark, d), V.asof())


@query(f"SELECT feed, count(*) AS polls, sum(found)::bigint AS articles, {rate('count(*) FILTER (ok)', 'count(*)')} AS success_rate FROM fetch_log GROUP BY 1")
def a20_fetch_rollup(spark, d):
    return M.fetch_rollup(V.fetch_log(spark, d))


@query("SELECT category, count(*) FILTER (n_articles = 1) AS created, sum(n_articles - 1)::bigint AS additions, round(avg(source_count), 6) AS mean_sources FROM stories GROUP BY 1")
def a21_cluster_rollup(spark, d):
    return M.cluster_rollup(V.stories(spark, d))


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"round(quantile_disc(value, {q}), 6) AS p{p}" for p, q in ((50, 0.5), (95, 0.95), (99, 0.99))) + " FROM events GROUP BY 1")
def a22_latency(spark, d):
    return M.latency(V.table(spark, d, "events"))


def _messages(spark, d):
    """Log lines as the service writes them, out of the events."""
    v = F.format_string("%.2f", F.col("value"))
    gen = F.concat(F.lit("summary model=m"), (F.col("user_id") % 3).cast("string"), F.lit(" cost=$"), v, F.lit(" took "), v, F.lit("s"))
    match = F.concat(F.when(F.col("value") >= 50, "match").otherwise("no match"), F.lit(" similarity="), v)
    return V.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", gen).when(F.col("event_type") == "click", match).otherwise(F.col("props")).alias("message"))


@query("SELECT 'm' || (user_id % 3) AS model, count(*) AS n, round(sum(value), 4) AS cost, round(avg(value), 5) AS mean_seconds FROM events WHERE event_type = 'view' GROUP BY 1")
def a23_summary_rollup(spark, d):
    return M.summary_rollup(_messages(spark, d))


@query(f"SELECT count(*) AS n, {rate('count(*) FILTER (value >= 50)', 'count(*)')} AS match_rate, min(value) AS low, round(avg(value), 5) AS mean, max(value) AS high FROM events WHERE event_type = 'click'")
def a24_match_rollup(spark, d):
    return M.match_rollup(_messages(spark, d))


@query("SELECT error, count(*) AS n FROM fetch_log WHERE NOT ok GROUP BY 1 ORDER BY n DESC, error LIMIT 10")
def a25_error_rollup(spark, d):
    return M.error_rollup(V.fetch_log(spark, d), 10)


@query("SELECT category, count(*) AS n, round(avg(importance / 100), 5) AS mean_confidence FROM stories GROUP BY 1")
def a26_category_rollup(spark, d):
    return M.category_rollup(V.stories(spark, d).select("category", (F.col("importance") / 100).alias("confidence")))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, event_type AS metric, count(*) AS n, round(avg(v), 5) AS mean, min(v) AS low, max(v) AS high, count(DISTINCT CASE WHEN v IS NULL THEN t END) AS others FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 'x' || (event_id % 7) ELSE value::varchar END AS t, try_cast(t AS double) AS v FROM events) GROUP BY 1, 2")
def a27_experiment_stats(spark, d):
    e = V.table(spark, d, "events")
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), (F.col("event_id") % 7).cast("string"))).otherwise(F.col("value").cast("string"))
    return M.experiment_stats(e.select(F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant"), F.col("event_type").alias("metric"), text.alias("value")))


@query("SELECT story_id, stated, actual FROM (SELECT story_id, (n_articles + CASE WHEN story_id % 6 = 0 THEN 1 ELSE 0 END)::int AS stated FROM stories) JOIN (SELECT story_id, count(DISTINCT source)::int AS actual FROM articles GROUP BY 1) USING (story_id) WHERE stated <> actual")
def a28_source_count_fixups(spark, d):
    """One story in six states a source too many."""
    s = V.stories(spark, d).withColumn("n_articles", (F.col("n_articles") + F.when(F.col("story_id") % 6 == 0, 1).otherwise(0)).cast("int"))
    return M.source_count_fixups(s, V.members(spark, d))


@query("SELECT region, count(*) AS feeds, sum(found)::bigint AS found FROM (SELECT feed, sum(found) AS found FROM fetch_log GROUP BY 1) JOIN feeds USING (feed) GROUP BY 1")
def a29_counts_by_region(spark, d):
    return M.counts_by_region(V.fetch_log(spark, d), V.feeds(spark, d))


@query("SELECT source, category, count(*) AS n, grouping(source, category)::bigint AS level FROM articles GROUP BY CUBE (source, category)")
def a30_counts_cube(spark, d):
    return M.counts_cube(V.articles(spark, d), ["source", "category"])


@query("SELECT count(*) FILTER (n_articles <> source_count) AS mismatched, count(*) FILTER (n_articles > source_count) AS repeated, 0::bigint AS empty, count(*) AS stories FROM stories")
def a31_source_consistency(spark, d):
    return M.source_consistency(V.stories(spark, d), V.members(spark, d))


@query(f"SELECT * FROM (SELECT {rate(f'count(*) FILTER ({HAS})', 'count(*)')} AS summaries_a, round(avg(source_count), 6) AS sources_a FROM stories WHERE breaking), (SELECT {rate(f'count(*) FILTER ({HAS})', 'count(*)')} AS summaries_b, round(avg(source_count), 6) AS sources_b FROM stories WHERE NOT breaking)")
def a32_coverage_compare(spark, d):
    s = V.stories(spark, d)
    return M.coverage_compare(s.filter("breaking"), s.filter("not breaking"))


@query("SELECT cast(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS bigint) AS bucket, round(avg(ok::int), 6) AS success_rate FROM fetch_log GROUP BY 1")
def a33_batch_series(spark, d):
    return M.batch_series(V.fetch_log(spark, d), "6 hours", F.round(F.avg(F.col("ok").cast("double")), 6), "success_rate")


@query("SELECT event_id, 'no match similarity=' || printf('%.2f', value) AS message FROM events WHERE event_type = 'click' AND value < 50 ORDER BY event_id DESC LIMIT 20")
def a34_event_extract(spark, d):
    return M.event_extract(_messages(spark, d), "^no match", 20)


@query("SELECT count(*) AS n, round(avg(epoch(fetched_at) - epoch(published_at)), 4) AS mean_s, round(max(epoch(fetched_at) - epoch(published_at)), 4) AS max_s FROM articles")
def a35_notify_latency(spark, d):
    return M.notify_latency(V.articles(spark, d).select(F.col("published_at").alias("triggered"), F.col("fetched_at").alias("sent")))


@query(f"SELECT tp, fp, fn, {rate('(n - fp - fn)', 'n')} AS accuracy, {rate('tp', '(tp + fp)')} AS precision, {rate('tp', '(tp + fn)')} AS recall, {rate('2 * tp', '(2 * tp + fp + fn)')} AS f1, {rate('fn', '(tp + fn)')} AS duplicate_rate FROM (SELECT count(*) AS n, count(*) FILTER (n_chars >= 2000 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 2000 AND quality <> 1) AS fp, count(*) FILTER (n_chars < 2000 AND quality = 1) AS fn FROM labels JOIN articles USING (doc_id))")
def a36_pair_metrics(spark, d):
    rows = V.table(spark, d, "labels").join(V.articles(spark, d), "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return M.pair_metrics(rows, 2000)
