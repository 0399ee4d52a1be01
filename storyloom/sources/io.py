"""Sources and sinks. Tables are Parquet; a snapshot is a new version folder, and what is partitioned is overwritten by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

ITEM = "STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING, updated: STRING, author: STRING, content: STRING>"


def shared_folder(spark) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it names none, one of this machine's if Spark runs on it alone."""
    import tempfile

    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="storyloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def feeds(registry: DataFrame, category: str | None = None, tier: int | None = None, region: str | None = None) -> DataFrame:
    """The feed registry, by category, tier, or a part of the region's name in any case."""
    for where in ((F.col("category") == category) if category else None, (F.col("tier") == tier) if tier else None, F.upper("region").contains(region.upper()) if region else None):
        registry = registry if where is None else registry.filter(where)
    return registry


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, one row an item."""
    return spark.read.format("xml").option("rowTag", "item").schema(T._parse_datatype_string(ITEM)).load(path)


def parse_feed_items(items: DataFrame, asof: Column, cap: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clean articles of raw items (source, and the fields of ITEM), without those that lack a title or a link; columns keep stay.

    Published, else updated, else asof; the body is the content, else the description, cut to cap.
    """
    when = lambda c: F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.regexp_replace(c, r"^\w+, | GMT$| \+0000$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    title, text = X.clean_text(F.col("title")), X.clean_text(F.col("description"))
    rows = items.select(*keep, "source", title.alias("title"), F.regexp_replace("link", r"^\s+|\s+$", "").alias("url"), X.truncate_words(text, 500).alias("description"), X.truncate_words(F.coalesce(F.when(F.length("content") > 0, X.clean_text(F.col("content"))), text), cap).alias("content"), F.coalesce(when(F.col("pubDate")), when(F.col("updated")), asof).alias("published_at"))
    rows = rows.filter((F.length("title") > 0) & (F.length("url") > 0))
    return rows.withColumns({"id": X.article_id(F.col("source"), F.col("url"), F.col("published_at")), "published_date": F.to_date("published_at")})


def upsert_articles(base: DataFrame, updates: DataFrame, key: str = "doc_id", version: str = "updated_at", first: str = "fetched_at") -> DataFrame:
    """Last write wins on key; the first fetch time is kept. Equal versions: the update wins."""
    every = base.withColumn("__u", F.lit(0)).unionByName(updates.withColumn("__u", F.lit(1)))
    row = F.struct(*[c for c in base.columns if c != first])
    return every.groupBy(key).agg(F.max_by(row, F.struct(version, "__u")).alias("r"), F.min(first).alias(first)).select("r.*", first).select(base.columns)


def merge_fields(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of patch (one row a key) in their places."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != key])
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in patch.columns if c != key}
    return base.join(p, key, "left").withColumns(new).select(base.columns)


def feed_state(log: DataFrame) -> DataFrame:
    """One row a feed: last poll, success and error, counts, and failures since the last success."""
    good = log.filter("ok").groupBy("feed").agg(F.max("ts").alias("last_success"))
    late = ~F.col("ok") & (F.col("last_success").isNull() | (F.col("ts") > F.col("last_success")))
    by = log.join(good, "feed", "left").groupBy("feed")
    return by.agg(F.max("ts").alias("last_poll"), F.max("last_success").alias("last_success"), F.max_by("error", F.when(~F.col("ok"), F.struct("ts", "event_id"))).alias("last_error"), F.count("*").alias("total_polls"), F.sum("found").alias("total_articles"), F.count_if(late).alias("consecutive_failures"))


def articles_by_id(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles (id, published_date) by id; the date that the id holds prunes partitions when the query runs, other ids are looked up everywhere."""
    form = r"_(\d{8})_[0-9a-f]{8}$"
    dated = ids.select("id", F.try_to_date(F.regexp_extract("id", form, 1), "yyyyMMdd").alias("d"))
    # A pattern is a filter that Spark takes for selective, as it needs to prune by what the ids hold.
    hit = articles.join(dated.filter(F.col("id").rlike(form) & F.col("d").isNotNull()).select("id", F.col("d").alias("published_date")), ["id", "published_date"], "left_semi")
    return hit.unionByName(articles.join(dated.filter("d is null").select("id"), "id", "left_semi"))


def article_changes(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream over landed change files, some files a trigger; a checkpoint resumes it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Pairs written as Parquet, and how many of each label they are."""
    pairs.write.mode("overwrite").parquet(path)
    return pairs.sparkSession.read.parquet(path).agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_retention(df: DataFrame, col: str, days: int, asof: Column, dry_run: bool = False) -> DataFrame:
    """Rows no older than the cutoff; or, as a dry run, how many would stay and go."""
    old = F.col(col) < asof - F.expr(f"interval {days} days")
    return df.agg(F.count_if(~old).alias("stay"), F.count_if(old).alias("go")) if dry_run else df.filter(~old)


def parse_events(log: DataFrame, schema: str) -> DataFrame:
    """message split at ` | ` into its text and its JSON payload, typed."""
    return log.withColumns({"text": F.split_part("message", F.lit(" | "), F.lit(1)), "payload": F.from_json(F.split_part("message", F.lit(" | "), F.lit(2)), schema)})


def append_interactions(inter: DataFrame, path: str) -> None:
    inter.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def interaction_stats(inter: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return inter.groupBy("user_id").agg(n("view"), n("like"), n("save"), n("source_click"), F.round(F.sum("dwell"), 4).alias("dwell"))


def token_state(events: DataFrame) -> DataFrame:
    """The latest state of each user's token (user_id, token, ts, on): those still registered."""
    return events.groupBy("user_id", "token").agg(F.max_by("on", F.struct("ts", "event_id")).alias("on")).filter("on").drop("on")


def merge_preferences(profiles: DataFrame, patches: DataFrame) -> DataFrame:
    """profiles (user_id, preferences map) with the entries of patches (user_id, patch map) put over theirs."""
    j = profiles.join(patches, "user_id", "left")
    keep = F.map_filter("preferences", lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("patch", F.create_map().cast("map<string,string>"))), k))
    return j.select("user_id", F.when(F.col("patch").isNull(), F.col("preferences")).otherwise(F.map_concat(keep, "patch")).alias("preferences"))
