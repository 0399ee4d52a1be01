"""Ranking, limits and retrieval. Global top-n is orderBy.limit, which keeps n rows a task; ranks are within keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .articles import visible_stories


def round_robin(ready: DataFrame, n: int, key: str = "category", order: str = "feed") -> DataFrame:
    """One of each category in turn until n; `turn` is the round."""
    w = Window.partitionBy(key).orderBy(order)
    return ready.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", key).limit(n)


def diversify(scored: DataFrame, limit: int, key: str = "category") -> DataFrame:
    """At most max(3, limit / 4) of a category by score, then the rest in score order until limit; `place` from 1."""
    cap = max(3, limit // 4)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "story_id")
    # A place beyond limit in its own category can't be among the first limit rows.
    rows = scored.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit).withColumn("__over", F.col("__rn") > cap)
    top = rows.orderBy("__over", F.desc("score"), "story_id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy("__over", F.desc("score"), "story_id"))).drop("__rn", "__over")


def dedup_sources(members: DataFrame, keep: str = "first") -> DataFrame:
    """One row for each story and source: the first, or the last, by publication."""
    pick = F.min_by if keep == "first" else F.max_by
    row = F.struct(*members.columns)
    return members.groupBy("story_id", "source").agg(pick(row, F.struct("published_at", "doc_id")).alias("r")).select("r.*")


def latest(df: DataFrame, where: Column, order: str, n: int, key: str) -> DataFrame:
    """The n newest rows that fit; of equal times the smallest key."""
    return df.filter(where).orderBy(F.desc(order), key).limit(n)


def recent_stories(stories: DataFrame, n: int, category: str | None = None, status: str | None = None) -> DataFrame:
    where = F.lit(True)
    if category:
        where &= F.col("category") == category
    if status:
        where &= F.col("status") == status
    return latest(stories, where, "last_updated", n, "story_id")


def breaker_state(log: DataFrame, asof: Column, failures: int = 3, minutes: int = 30) -> DataFrame:
    """(feed, consecutive, state): failures since the last success; open from `failures` on, half-open when more than some minutes have passed.

    Only two aggregates of each feed: its last success, and the failures after it. No feed's log is sorted in one task.
    """
    good = log.filter("ok").groupBy("feed").agg(F.max(F.struct("ts", "event_id")).alias("s"))
    j = log.join(good, "feed", "left").withColumn("late", ~F.col("ok") & (F.col("s").isNull() | (F.struct("ts", "event_id") > F.col("s"))))
    out = j.groupBy("feed").agg(F.count_if("late").alias("consecutive"), F.max(F.when(F.col("late"), F.col("ts"))).alias("last_failure"))
    open_ = F.col("consecutive") >= failures
    rested = asof.cast("long") - F.col("last_failure").cast("long") > minutes * 60
    return out.select("feed", "consecutive", F.when(open_ & rested, "half_open").when(open_, "open").otherwise("closed").alias("state"))


def reading_history(inter: DataFrame, n: int) -> DataFrame:
    """The last n views of each user, newest first."""
    return _last(inter.filter("kind = 'view'"), n)


def _last(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def prune_history(inter: DataFrame, n: int) -> DataFrame:
    """Views beyond the n newest of a user that the user didn't save."""
    saved = inter.filter("kind = 'save'").select("user_id", "story_id").distinct()
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    old = inter.filter("kind = 'view'").withColumn("place", F.row_number().over(w)).filter(F.col("place") > n)
    return old.join(saved, ["user_id", "story_id"], "left_anti")


def recent_interactions(inter: DataFrame, n: int) -> DataFrame:
    return _last(inter, n)


def quota(inter: DataFrame, tiers: DataFrame, asof: Column) -> DataFrame:
    """(user_id, used, limit, remaining) of the day before asof: 20 a day, 1000 for the paid tier."""
    day = inter.filter((F.col("ts") > asof - F.expr("interval 1 day")) & (F.col("ts") <= asof)).groupBy("user_id").agg(F.count("*").alias("used"))
    limit = F.when(F.col("tier") == "paid", 1000).otherwise(20)
    return tiers.join(day, "user_id", "left").select("user_id", F.coalesce("used", F.lit(0).cast("long")).alias("used"), limit.alias("limit")).withColumn("remaining", F.greatest(F.col("limit") - F.col("used"), F.lit(0).cast("long")))


def source_count_changes(snapshots: DataFrame) -> DataFrame:
    """(story_id, ts, n, change) of snapshots (story_id, ts, n) whose count isn't that of the snapshot before."""
    w = Window.partitionBy("story_id").orderBy("ts", "n")
    return snapshots.withColumn("change", F.col("n") - F.lag("n").over(w)).filter("change <> 0")


def lead_story(members: DataFrame) -> DataFrame:
    """The member of the best tier of each story; of equals the first published."""
    return members.groupBy("story_id").agg(F.min_by("doc_id", F.struct("tier", "published_at", "doc_id")).alias("lead"))


def feed_score(stories: DataFrame, profile: DataFrame, asof: Column) -> DataFrame:
    """stories with score: recency bands, breaking 15, importance / 10, level up to 5, and the profile's (category, weight) x 10."""
    h = (asof.cast("double") - F.col("first_seen").cast("double")) / 3600
    recency = F.when(h < 1, 100.0)
    for hours, points in ((3, 95), (6, 90), (12, 80), (24, 70), (48, 50)):
        recency = recency.when(h < hours, float(points))
    recency = recency.otherwise(F.greatest(F.lit(0.0), 30 - h))
    j = stories.join(profile, "category", "left")  # a row a category; Spark sends it by its size
    score = F.coalesce(recency, F.lit(50.0)) + F.when(F.col("breaking"), 15.0).otherwise(0.0) + F.col("importance") / 10 + F.least(F.col("source_count"), F.lit(5)) + 10 * F.coalesce("weight", F.lit(0.0))
    return j.withColumn("score", F.round(score, 6)).drop("weight")


def with_fallback(visible: DataFrame, n: int) -> DataFrame:
    """Rows with a summary; where there is none at all, the n most recently updated. No driver branch."""
    has = F.length(F.coalesce("summary", F.lit(""))) > 0
    some = visible.agg(F.coalesce(F.max(has), F.lit(False)).alias("__some"))
    back = visible.orderBy(F.desc("last_updated"), "story_id").limit(n)
    return visible.filter(has).unionByName(back.join(F.broadcast(some), F.lit(True)).filter("not __some").drop("__some"))


def with_fallback_of_few(few: DataFrame, n: int) -> DataFrame:
    """with_fallback of rows that a limit bounds: one pass, in one task, so that what they are made of is computed once."""
    has = F.length(F.coalesce("summary", F.lit(""))) > 0
    marked = few.withColumns({"__some": F.max(has).over(Window.partitionBy()), "__r": F.row_number().over(Window.orderBy(F.desc("last_updated"), "story_id"))})
    return marked.filter(has | (~F.col("__some") & (F.col("__r") <= n))).drop("__some", "__r")


def ranked_feed(stories: DataFrame, profile: DataFrame, category: str | None, limit: int, offset: int, asof: Column) -> DataFrame:
    """The 200 newest visible stories with a summary, a slice of twice the limit, scored and diversified."""
    newest = visible_stories(stories, category, asof).orderBy(F.desc("last_updated"), "story_id").limit(200)
    ready = with_fallback_of_few(newest, 20)
    place = F.row_number().over(Window.orderBy(F.desc("first_seen"), "story_id"))  # 200 rows at most
    cut = ready.withColumn("__p", place).filter((F.col("__p") > offset) & (F.col("__p") <= offset + 2 * limit)).drop("__p")
    return diversify(feed_score(cut, profile, asof), limit)


def default_feed(stories: DataFrame, n: int) -> DataFrame:
    return stories.orderBy(F.desc("breaking"), F.desc("first_seen"), "story_id").limit(n)


def search(stories: DataFrame, q: str, category: str | None, n: int, asof: Column) -> DataFrame:
    """Stories whose title or summary holds q, or that have it as a tag; by phrase in title 100, a word in title 50, in summary 25, and up to 20 for age."""
    q = q.lower()
    title, text = F.lower("title"), F.lower(F.coalesce("summary", F.lit("")))
    age = (asof.cast("double") - F.col("last_updated").cast("double")) / 3600
    tagged = F.coalesce(F.array_contains("tags", q), F.lit(False)) if "tags" in stories.columns else F.lit(False)
    hit = stories.filter(title.contains(q) | text.contains(q) | tagged)
    hit = hit.filter(F.col("category") == category) if category else hit
    score = F.when(title.contains(q), 100.0).otherwise(0.0) + F.when(title.rlike(X.any_of(q.split())), 50.0).otherwise(0.0) + F.when(text.contains(q), 25.0).otherwise(0.0) + F.greatest(F.lit(0.0), 20 - age)
    return hit.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "story_id").limit(n)


def breaking(stories: DataFrame, n: int, asof: Column) -> DataFrame:
    return latest(stories, F.col("breaking") & (F.col("last_updated") >= asof - F.expr("interval 3 days")), "last_updated", n, "story_id")
