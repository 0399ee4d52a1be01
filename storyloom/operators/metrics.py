"""Health, quality and cost metrics: one conditional aggregate a table. Group keys are few or pre-summed before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import title_similarity
from ..sources.io import durable


def rate(n: Column, of: Column) -> Column:
    """n / of in parts of one, to six places; 0 for none."""
    return F.round(F.when(of > 0, n / of).otherwise(F.lit(0.0)), 6)


def seconds(a: Column, b: Column) -> Column:
    return a.cast("double") - b.cast("double")


def since(c: str, asof: Column, interval: str) -> Column:
    return (F.col(c) > asof - F.expr(f"interval {interval}")) & (F.col(c) <= asof)


def table_stats(articles: DataFrame, stories: DataFrame) -> DataFrame:
    a = articles.agg(F.count("*").alias("articles"), F.count_if("processed").alias("processed"), F.count_distinct("source").alias("sources"), F.max("published_at").cast("long").alias("latest"), F.min("published_at").cast("long").alias("oldest"))
    s = stories.agg(F.count("*").alias("stories"), F.count_if("breaking").alias("breaking"), F.count_if(F.col("source_count") >= 2).alias("multi"))
    return a.crossJoin(s)  # one row each


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def counts_cube(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of all combinations with their subtotals, in one pass; `level` tells a subtotal from a null key."""
    return df.cube(*cols).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def top_sources(articles: DataFrame, n: int) -> DataFrame:
    """The n sources with the most articles and their share of all; of equal counts the first by name."""
    by = articles.groupBy("source").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("source", "n", rate(F.col("n"), F.col("total")).alias("share")).orderBy(F.desc("n"), "source").limit(n)


def ingest_stats(articles: DataFrame, asof: Column) -> DataFrame:
    day, hour = F.count_if(since("fetched_at", asof, "24 hours")), F.count_if(since("fetched_at", asof, "1 hour"))
    return articles.agg(day.alias("day"), hour.alias("hour"), F.greatest(F.round(day / 24, 6), hour.cast("double")).alias("per_hour"), rate(F.count_if("processed"), F.count("*")).alias("success_rate"), F.max(F.when(F.col("fetched_at") <= asof, F.col("fetched_at"))).cast("long").alias("last_run"))


def clustering_stats(articles: DataFrame, stories: DataFrame, asof: Column) -> DataFrame:
    """health: healthy from ten stories updated in the last hour on and a backlog below 100, stalled without any, else degraded."""
    matched = rate(F.count_if(F.col("source_count") >= 2), F.count("*"))
    s = stories.agg(F.round(F.avg("source_count"), 6).alias("mean_sources"), matched.alias("match_rate"), F.count_if(since("first_seen", asof, "24 hours")).alias("created"), F.count_if(since("last_updated", asof, "24 hours") & ~since("first_seen", asof, "24 hours")).alias("updated"), F.count_if(since("last_updated", asof, "1 hour")).alias("hour"))
    oldest = F.floor(seconds(asof, F.min(F.when(~F.col("processed"), F.col("fetched_at")))) / 60).cast("long")
    a = articles.agg(F.count_if(~F.col("processed")).alias("backlog"), F.count_if("processed").alias("processed"), oldest.alias("oldest_minutes"))
    label = F.when((F.col("hour") >= 10) & (F.col("backlog") < 100), "healthy").when(F.col("hour") > 0, "degraded").otherwise("stalled")
    return s.crossJoin(a).withColumn("health", label)


def summary_stats(stories: DataFrame, responses: DataFrame, asof: Column) -> DataFrame:
    """responses: (story_id, seconds, words, cost)."""
    has = F.length(F.coalesce("summary", F.lit(""))) > 0
    s = stories.agg(rate(F.count_if(has), F.count("*")).alias("coverage"), F.count_if(has & since("last_updated", asof, "24 hours")).alias("day"))
    return s.crossJoin(responses.agg(F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg("words"), 6).alias("mean_words"), F.round(F.sum("cost"), 4).alias("cost")))


def batch_stats(batches: DataFrame) -> DataFrame:
    """batches: (status, request_count, cost)."""
    done = F.count_if(F.col("status") == "completed")
    return batches.agg(F.count("*").alias("submitted"), done.alias("completed"), rate(done, F.count("*")).alias("success_rate"), F.count_if(F.col("status") == "in_progress").alias("waiting"), F.round(F.avg("request_count"), 6).alias("mean_size"), F.round(F.sum("cost"), 2).alias("cost"))


def feed_quality(stories: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Label from the share of stories with several sources and the distinct sources of articles over all feeds, 1 at most."""
    matched = stories.agg(rate(F.count_if(F.col("source_count") >= 2), F.count("*")).alias("match_rate"))
    spread = articles.agg(F.count_distinct("source").alias("s")).crossJoin(feeds.agg(F.count("*").alias("f")))
    r = matched.crossJoin(spread.select(F.when(F.col("f") > 0, F.least(F.round(F.col("s") / F.col("f"), 6), F.lit(1.0))).otherwise(0.0).alias("diversity")))
    m, v = F.col("match_rate"), F.col("diversity")
    return r.withColumn("label", F.when((m > 0.7) & (v > 0.5), "Excellent").when((m > 0.5) & (v > 0.3), "Good").when(m > 0.3, "Fair").otherwise("Needs Improvement"))


def health(ingest: DataFrame, clustering: DataFrame, summaries: DataFrame, stories: DataFrame) -> DataFrame:
    """Component labels and the overall one, from one-row frames of the stats.

    ingest stands for the worker's own report: healthy with articles in the last hour, degraded with some in the last day,
    else down. Jobs are healthy with healthy ingest and stories updated in the last hour, degraded with either or with
    processed articles. Summaries: healthy above 95 % coverage, degraded above 80 %. Overall looks at the database and the jobs.
    """
    worker = F.when(F.col("hour") > 0, "healthy").when(F.col("day") > 0, "degraded").otherwise("down")
    i = ingest.select(worker.alias("ingest"))
    c = clustering.select(F.col("health").alias("clustering"), F.col("hour").alias("rate"), "processed")
    s = summaries.select(F.when(F.col("coverage") > 0.95, "healthy").when(F.col("coverage") > 0.80, "degraded").otherwise("down").alias("summaries"))
    d = stories.agg(F.when(F.count("*") > 0, "healthy").otherwise("degraded").alias("database"))
    up, active = F.col("ingest") == "healthy", F.col("rate") > 0
    jobs = F.when(up & active, "healthy").when(up | active | (F.col("processed") > 0), "degraded").otherwise("down")  # the ingest that's left is down or degraded
    jobs = F.when((F.col("ingest") == "degraded") & ~active & (F.col("processed") == 0), "unknown").otherwise(jobs)
    rows = i.crossJoin(c).crossJoin(s).crossJoin(d).withColumn("jobs", jobs)
    both = (F.col("database") == "healthy") & (F.col("jobs") == "healthy")
    overall = F.when(both, "healthy").when((F.col("database") == "degraded") | F.col("jobs").isin("degraded", "down"), "degraded").otherwise(F.col("database"))
    return rows.select("database", "ingest", "clustering", "summaries", "jobs", overall.alias("overall"))


def source_histogram(stories: DataFrame) -> DataFrame:
    by = stories.groupBy("source_count").agg(F.count("*").alias("n"))
    return by.select("source_count", "n", rate(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share"))


def duplicate_sources(members: DataFrame) -> DataFrame:
    """One row over the stories of several members: those with repeated sources, surplus rows, their percentage, a label."""
    by = members.groupBy("story_id", "source").agg(F.count("*").alias("k")).groupBy("story_id").agg(F.sum(F.col("k") - 1).alias("surplus"), F.sum("k").alias("rows")).filter("rows > 1")
    out = by.agg(F.count_if(F.col("surplus") > 0).alias("stories"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("surplus"), F.round(100 * rate(F.count_if(F.col("surplus") > 0), F.count("*")), 4).alias("percent"))
    return out.withColumn("label", F.when(F.col("percent") > 10, "failing").when(F.col("percent") > 5, "partial").otherwise("working"))


def fingerprint_collisions(stories: DataFrame, fp: str = "fp") -> DataFrame:
    by = stories.groupBy(fp).agg(F.count("*").alias("k"))
    return by.agg(F.count_if(F.col("k") > 1).alias("groups"), F.sum(F.col("k") - 1).alias("surplus"), rate(F.sum(F.col("k") - 1), F.sum("k")).alias("rate"))


def accuracy_sample(members: DataFrame, n: int) -> DataFrame:
    """Stories with two members or more: the similarity of the first two titles. The n smallest story ids.

    good from .70 on, questionable from .50 on, else poor.
    """
    few = members.groupBy("story_id").agg(F.count("*").alias("k")).filter("k > 1").orderBy("story_id").limit(n)
    w = Window.partitionBy("story_id").orderBy("doc_id")
    rows = members.join(F.broadcast(few), "story_id").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    two = rows.groupBy("story_id").agg(F.min_by("headline", "r").alias("x"), F.max_by("headline", "r").alias("y"))
    s = F.round(title_similarity(F.col("x"), F.col("y")), 6)
    return two.select("story_id", s.alias("similarity")).withColumn("label", F.when(F.col("similarity") >= 0.7, "good").when(F.col("similarity") >= 0.5, "questionable").otherwise("poor"))


def completeness(articles: DataFrame) -> DataFrame:
    full = lambda c: F.round(F.avg((F.length(F.coalesce(c, F.lit(""))) > 0).cast("double")), 6).alias(c)
    return articles.agg(full("title"), full("description"), full("text"), full("url"), F.round(F.avg(F.col("processed").cast("double")), 6).alias("processed"))


def per_minute(articles: DataFrame, asof: Column, interval: str) -> DataFrame:
    w = F.window("fetched_at", "1 minute")
    return articles.filter(since("fetched_at", asof, interval)).groupBy(w).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).select(F.col("window.start").cast("long").alias("minute"), "n", "sources")


def processing_lag(articles: DataFrame, asof: Column) -> DataFrame:
    """The backlog and the age of its oldest article by fetch: minimal below a minute, moderate below five, else high; none without one."""
    late = ~F.col("processed")
    out = articles.agg(F.count_if(late).alias("backlog"), F.floor(seconds(asof, F.min(F.when(late, F.col("fetched_at"))))).cast("long").alias("lag_s"))
    return out.withColumn("label", F.when(F.col("lag_s").isNull(), "none").when(F.col("lag_s") < 60, "minimal").when(F.col("lag_s") < 300, "moderate").otherwise("high"))


def concentration(articles: DataFrame) -> DataFrame:
    top = articles.groupBy("source").agg(F.count("*").alias("n")).agg(rate(F.max("n"), F.sum("n")).alias("top_share"))
    return top.withColumn("label", F.when(F.col("top_share") > 0.6, "critical").when(F.col("top_share") > 0.5, "high").when(F.col("top_share") > 0.3, "moderate").otherwise("diverse"))


def quality_score(stories: DataFrame, members: DataFrame, flawed: DataFrame) -> DataFrame:
    """One row: repeated titles, and the overall score out of 100 of its five parts.

    .25 stories without a structural issue (flawed: story_id of those with one), .25 ten points a distinct source, .20
    stories of two to eight listed sources, .15 images (full marks: stories carry none), .15 stories with a summary.
    """
    n = members.groupBy("story_id").agg(F.count("*").alias("n"))
    j = stories.select("story_id", "title", "summary").join(n, "story_id", "left").join(flawed.select("story_id", F.lit(True).alias("bad")).distinct(), "story_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100
    parts = j.agg(share(F.col("bad").isNull()).alias("structural"), share(F.col("n").between(2, 8)).alias("clustering"), share(F.length("summary") > 0).alias("summaries"))
    name = F.lower(F.trim("source"))
    real = members.filter((name != "") & ~name.contains("test") & ~name.startswith("source ")).agg(F.least(F.lit(100.0), F.count_distinct(name) * 10.0).alias("diversity"))
    dup = stories.groupBy(F.lower("title").alias("t")).agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("duplicate_titles"))
    score = 0.25 * F.col("structural") + 0.25 * F.col("diversity") + 0.20 * F.col("clustering") + 0.15 * 100 + 0.15 * F.col("summaries")
    return parts.crossJoin(real).crossJoin(dup).select("duplicate_titles", F.round("structural", 4).alias("structural"), "diversity", F.round("clustering", 4).alias("clustering"), F.round("summaries", 4).alias("summaries"), F.round(score, 4).alias("score"))


def timeliness(members: DataFrame, asof: Column) -> DataFrame:
    """Mean age in hours of each story's newest member, and 100 less two points an hour, at least 0."""
    age = members.groupBy("story_id").agg(F.max("published_at").alias("p")).select((seconds(asof, F.col("p")) / 3600).alias("h"))
    return age.agg(F.round(F.avg("h"), 5).alias("mean_hours")).withColumn("score", F.greatest(F.lit(0.0), F.round(100 - 2 * F.col("mean_hours"), 4)))


def fetch_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("feed").agg(F.count("*").alias("polls"), F.sum("found").alias("articles"), rate(F.count_if("ok"), F.count("*")).alias("success_rate"))


def cluster_rollup(stories: DataFrame) -> DataFrame:
    return stories.groupBy("category").agg(F.count_if(F.col("n_articles") == 1).alias("created"), F.sum(F.col("n_articles") - 1).alias("additions"), F.round(F.avg("source_count"), 6).alias("mean_sources"))


def latency(events: DataFrame, key: str = "event_type", value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """(key, n, p50, p95, p99): exact nearest-rank percentiles, nulls left out, without a hot task for a hot key.

    A mergeable sketch only cuts each key's values into seven spans, three of them narrow; counts of the spans say in which one a rank lies,
    and only the values of those spans are ordered.
    """
    of = (50, 95, 99)
    near = [F.lit(min(max(p / 100 + s * 5 / accuracy, 0.0), 1.0)) for p in of for s in (-1, 1)]
    k, v = F.col("__k"), F.col("__v")
    rows = events.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    cuts = durable(rows.groupBy("__k").agg(F.count("*").alias("n"), F.percentile_approx("__v", F.array(*near), accuracy).alias("c")).withColumn("id", F.monotonically_increasing_id()))
    of_key = rows.filter(v.isNotNull()).join(cuts.select(F.col("__k").alias("__j"), "id", "c"), k.eqNullSafe(F.col("__j")))
    placed = of_key.select("id", F.size(F.filter("c", lambda x: x < v)).alias("span"), v.alias("v"))
    spans = placed.groupBy("id", "span").agg(F.count("*").alias("m"))
    w = Window.partitionBy("id").orderBy("span")
    spans = spans.select("id", "span", F.sum("m").over(w).alias("upto"), (F.sum("m").over(w) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("id")).alias("total"))
    asked = spans.withColumn("p", F.explode(F.array(*[F.lit(p) for p in of]))).withColumn("rank", F.expr("(total * p + 99) div 100")).filter("rank > before and rank <= upto")
    asked = durable(asked.select("id", "span", "p", (F.col("rank") - F.col("before")).alias("rank")))
    inside = placed.join(asked.select("id", "span").distinct(), ["id", "span"], "left_semi").groupBy("id", "span", "v").agg(F.count("*").alias("m"))
    inside = inside.withColumn("upto", F.sum("m").over(Window.partitionBy("id", "span").orderBy("v")))
    found = inside.join(asked, ["id", "span"]).filter("upto >= rank").groupBy("id").agg(*[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in of])
    return cuts.join(found, "id", "left").select(k.alias(key), "n", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in of])


def summary_rollup(log: DataFrame) -> DataFrame:
    """Costs and seconds that messages like `model=x cost=$0.12 took 3.4s` hold, by model."""
    num = lambda p: F.regexp_extract("message", p, 1).try_cast("double")
    rows = log.select(F.regexp_extract("message", r"model=(\S+)", 1).alias("model"), num(r"cost=\$([0-9.]+)").alias("cost"), num(r"took ([0-9.]+)s").alias("took")).filter("model <> ''")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("took"), 5).alias("mean_seconds"))


def match_rollup(log: DataFrame) -> DataFrame:
    """Match rate and similarities in messages like `match similarity=0.812` and `no match similarity=0.412`."""
    s = F.regexp_extract("message", r"similarity=([0-9.]+)", 1).try_cast("double")
    rows = log.select(s.alias("s"), F.col("message").startswith("match").alias("hit")).filter("s is not null")
    return rows.agg(F.count("*").alias("n"), rate(F.count_if("hit"), F.count("*")).alias("match_rate"), F.round(F.min("s"), 6).alias("low"), F.round(F.avg("s"), 5).alias("mean"), F.round(F.max("s"), 6).alias("high"))


def error_rollup(log: DataFrame, n: int) -> DataFrame:
    return log.filter("not ok").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def category_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))


def experiment_stats(metrics: DataFrame) -> DataFrame:
    """metrics: (variant, metric, value text). Numbers: mean, least, most; other values: how many distinct."""
    v = F.col("value").try_cast("double")
    return metrics.groupBy("variant", "metric").agg(F.count("*").alias("n"), F.round(F.avg(v), 5).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_distinct(F.when(v.isNull(), F.col("value"))).alias("others"))


def source_count_fixups(stories: DataFrame, members: DataFrame, stated: str = "n_articles") -> DataFrame:
    """(story_id, stated, actual) where the stated count isn't that of distinct sources."""
    real = members.groupBy("story_id").agg(F.count_distinct("source").cast("int").alias("actual"))
    return stories.select("story_id", F.col(stated).alias("stated")).join(real, "story_id").filter("stated <> actual")


def counts_by_region(log: DataFrame, feeds: DataFrame) -> DataFrame:
    return log.groupBy("feed").agg(F.sum("found").alias("found")).join(feeds.select("feed", "region"), "feed").groupBy("region").agg(F.count("*").alias("feeds"), F.sum("found").alias("found"))


def source_consistency(stories: DataFrame, members: DataFrame, stated: str = "n_articles") -> DataFrame:
    """Issues by kind: mismatch of stated and listed sources, repeats, empty lists with a stated count."""
    m = members.groupBy("story_id").agg(F.count("*").alias("listed"), F.count_distinct("source").alias("unique"))
    j = stories.select("story_id", F.col(stated).alias("stated")).join(m, "story_id", "left").fillna(0, ["listed", "unique"])
    return j.agg(F.count_if(F.expr("stated <> unique")).alias("mismatched"), F.count_if(F.expr("listed > unique")).alias("repeated"), F.count_if(F.expr("listed = 0 and stated > 0")).alias("empty"), F.count("*").alias("stories"))


def coverage_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    has = F.length(F.coalesce("summary", F.lit(""))) > 0
    one = lambda df, x: df.agg(rate(F.count_if(has), F.count("*")).alias(f"summaries_{x}"), F.round(F.avg("source_count"), 6).alias(f"sources_{x}"))
    return one(a, "a").crossJoin(one(b, "b"))


def batch_series(events: DataFrame, width: str, value: Column, name: str) -> DataFrame:
    """(bucket, name): an aggregate over windows of the given width of `ts`."""
    return events.groupBy(F.window("ts", width)).agg(value.alias(name)).select(F.col("window.start").cast("timestamp").cast("long").alias("bucket"), name)


def event_extract(log: DataFrame, pattern: str, n: int) -> DataFrame:
    """The n latest messages that a pattern fits."""
    return log.filter(F.col("message").rlike(pattern)).orderBy(F.desc("event_id")).limit(n)


def notify_latency(sent: DataFrame) -> DataFrame:
    """sent: (triggered, sent)."""
    s = F.col("sent").cast("double") - F.col("triggered").cast("double")
    return sent.agg(F.count("*").alias("n"), F.round(F.avg(s), 4).alias("mean_s"), F.round(F.max(s), 4).alias("max_s"))


def pair_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """scored: (label, score). Accuracy, precision, recall and F1 of score >= threshold, and the duplicate rate: positives kept apart, of all positives."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    r = scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return r.select("tp", "fp", "fn", rate(n - fp - fn, n).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(fn, tp + fn).alias("duplicate_rate"))
