"""Domain views over the supplied tables, in DataFrame code; views_sql holds the same rules in SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import entities

#: The as-of time of the registered queries.
ASOF = "2024-01-02 00:00:00"
SECTIONS = ("world", "business", "sports", "technology", "food", "health", "deals")


def asof() -> Column:
    return F.lit(ASOF).cast("timestamp")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """One article a document; published a minute apart, with a headline from the fixed lists."""
    k = F.col("doc_id")
    head = F.split_part("text", F.lit("."), F.lit(1))
    published = F.timestamp_seconds(F.lit(1704067200) + k * 60)
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(
        "doc_id", "source", "lang", "n_chars", "text",
        F.trim(head).alias("title"),
        F.translate(F.substr("text", F.length(head) + 2, F.lit(200)), "\n", " ").alias("description"),
        F.trim(F.concat(_pick(vocab.HEADLINES, k), F.lit(" "), _pick(vocab.HEADLINE_TAILS, F.floor(k / len(vocab.HEADLINES))))).alias("headline"),
        F.concat(F.lit("https://news.example/"), _pick(SECTIONS, k), F.lit("/"), k.cast("string")).alias("url"),
        _pick(vocab.CATEGORIES, k).alias("category"),
        (k % 3 + 1).cast("int").alias("tier"),
        (k % 5 != 0).alias("processed"),
        published.alias("published_at"),
        F.timestamp_seconds(F.lit(1704067200) + (k + k % 90) * 60).alias("fetched_at"),
        story_key(k).alias("story_id"),
    )


def story_key(k: Column) -> Column:
    """Runs of twelve documents in stories of one to six."""
    block = F.floor(k / 12)
    return (block * 12 + F.floor((k % 12) / (block % 6 + 1))).cast("long")


def stories(spark: SparkSession, d: str) -> DataFrame:
    """One row a story, with its members counted and its first member's words."""
    a = articles(spark, d)
    first = lambda c: F.min_by(c, "doc_id").alias(c)
    g = a.groupBy("story_id").agg(
        first("headline"), first("description"), first("category"),
        F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_updated"),
        F.count_distinct("source").cast("int").alias("source_count"), F.count("*").cast("int").alias("n_articles"), F.min("tier").alias("best_tier"),
    )
    k = F.col("story_id")
    return g.select(
        "story_id", F.col("headline").alias("title"), "category", "first_seen", "last_updated", "source_count", "n_articles", "best_tier",
        F.when(k % 3 != 0, F.col("description")).alias("summary"),
        (F.lit(50) + k % 51).cast("int").alias("importance"),
        ((F.col("source_count") >= 5) | (k % 17 == 0)).alias("breaking"),
        (k % 4 == 0).alias("notified"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("story_id", "doc_id", "source", "published_at", "headline", "tier")


def with_entities(a: DataFrame) -> DataFrame:
    return a.withColumn("entities", entities(F.concat_ws(" ", "headline", "description")))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "source_click").when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "signup", "like").otherwise(F.col("event_type"))
    e = table(spark, d, "events").filter("event_type <> 'error'")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("value").alias("dwell"), F.get_json_object("props", "$.k").cast("long").alias("story_id"))


def fetch_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ok = F.col("event_type") != "error"
    return e.select("event_id", F.col("user_id").alias("feed"), F.col("ts").cast("timestamp").alias("ts"), ok.alias("ok"), F.when(ok, F.floor("value")).otherwise(0).cast("long").alias("found"), F.when(~ok, F.col("props")).alias("error"))


def feeds(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("feed"), F.col("s_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("tier"), _pick(vocab.CATEGORIES, F.col("s_suppkey")).alias("category"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("story_id"), "embedding")
