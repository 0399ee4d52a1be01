"""Table jobs over articles and stories: cleaning, ids, flags, display columns. Mostly projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import vocab
from ..functions import similarity as Z
from ..functions import text as X


def clean_columns(df: DataFrame, cols: list[str], decode: bool = True) -> DataFrame:
    return df.withColumns({c: X.clean_text(F.col(c), decode) for c in cols})


def truncate_column(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.withColumn(col, X.truncate_words(F.col(col), n))


def with_article_id(df: DataFrame, source: str = "source", url: str = "url", published: str = "published_at") -> DataFrame:
    return df.withColumn("id", X.article_id(F.col(source), F.col(url), F.col(published)))


def with_source_name(df: DataFrame, names: DataFrame, source: str = "source") -> DataFrame:
    """Display name: that of the mapping (source, name), else the id with its words capitalised. The mapping has a row a source."""
    return df.join(names.select(F.col("source").alias(source), F.col("name").alias("__name")), source, "left").withColumn("source_name", F.coalesce("__name", F.initcap(F.translate(source, "_-", "  ")))).drop("__name")


def with_status(df: DataFrame, count: str = "source_count") -> DataFrame:
    n = F.col(count)
    return df.withColumn("status", F.when(n >= 5, "TOP_STORY").when(n >= 3, "VERIFIED").when(n == 2, "DEVELOPING").otherwise("NEW"))


def with_cost(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """(tokens in - cached) * a + cached * b + out * c, at half price in a batch; prices (model, a, b, c) are per million."""
    raw = ((F.col("tokens_in") - F.col("cached")) * F.col("a") + F.col("cached") * F.col("b") + F.col("tokens_out") * F.col("c")) / 1e6
    return df.join(prices, model).withColumn("cost", F.when(F.col("batch"), raw / 2).otherwise(raw)).drop("a", "b", "c")


def _first_members(members: DataFrame, n: int, *cols: str) -> DataFrame:
    """(story_id, m): the first n members (doc_id, cols) of each story, by number.

    Ranks are cut to n before and after the shuffle, and texts are joined to the few that stay, so a story's size doesn't count.
    """
    w = Window.partitionBy("story_id").orderBy("doc_id")
    few = members.select("story_id", "doc_id").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
    return few.join(members.select("doc_id", *cols), "doc_id").groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", *cols))).alias("m"))


def fallback_summary(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(story_id, summary): the title, up to three sources, and the first member's description; a hundred words at most."""
    one = _first_members(members, 3, "source", "description")
    m = F.col("m")
    lead = F.substring(m[0]["description"], 1, 300)
    many = F.concat(F.col("title"), F.lit(". Multiple sources including "), F.array_join(F.transform(m, lambda x: x["source"]), ", "), F.lit(" are reporting on this story. "), lead)
    text = F.when(F.size("m") == 1, F.concat(F.col("title"), F.lit(". According to "), m[0]["source"], F.lit(", "), lead)).otherwise(many)
    return stories.join(one, "story_id").select("story_id", F.array_join(F.slice(X.words(text), 1, 100), " ").alias("summary"))


def summary_requests(members: DataFrame) -> DataFrame:
    """(story_id, template, prompt): numbered blocks of the first six members, a thousand characters each."""
    one = _first_members(members.withColumn("text", F.substring("text", 1, 1000)), 6, "source", "headline", "text")
    block = lambda x, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(": "), x["source"], F.lit("\nTitle: "), x["headline"], F.lit("\nContent: "), x["text"])
    return one.select("story_id", F.when(F.size("m") == 1, "single").otherwise("multi").alias("template"), F.array_join(F.transform("m", block), "\n\n---\n\n").alias("prompt"))


def apply_summaries(stories: DataFrame, responses: DataFrame) -> DataFrame:
    """(story_id, summary, category, version, words): JSON answers, fenced or not, give text and category; others are the text."""
    inner = F.regexp_extract("response", r"(?s)^\s*(?:```(?:json)?)?\s*(\{.*\})\s*(?:```)?\s*$", 1)
    parsed = F.from_json(F.when(inner != "", inner), "summary string, category string")
    text = F.coalesce(parsed["summary"], F.col("response"))
    return stories.join(responses, "story_id").select("story_id", text.alias("summary"), F.coalesce(parsed["category"], F.col("category")).alias("category"), (F.col("version") + 1).alias("version"), F.size(X.words(text)).alias("words"))


def story_detail(stories: DataFrame, members: DataFrame, asof: Column) -> DataFrame:
    """Stories with distinct sources, their list, and the state of the summary: available, generating (three minutes), absent."""
    one = members.groupBy("story_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    age = asof.cast("long") - F.col("first_seen").cast("long")
    state = F.when(F.length(F.coalesce("summary", F.lit(""))) > 0, "available").when(age < 180, "generating").otherwise("absent")
    return stories.join(one, "story_id", "left").withColumns({"unique_sources": F.coalesce(F.size("sources"), F.lit(0)), "summary_state": state})


def feed_columns(stories: DataFrame) -> DataFrame:
    """What a feed row needs of a story, those columns that there are; vectors and the like stay behind."""
    wanted = ("story_id", "title", "category", "tags", "status", "level", "summary", "source_count", "first_seen", "last_updated", "importance", "breaking", "members")
    return stories.select(*[c for c in wanted if c in stories.columns])


def client_view(detail: DataFrame, urls: DataFrame | None = None, unavailable: str | None = None) -> DataFrame:
    """Stories as a client shows them. level is 0 to 10; trending is .9 for breaking news, else a tenth of the importance.

    urls (story_id, url, place), where given, adds the first valid address of the story's sources, in order of place: one with a scheme and without
    white space. Where there is none, it is `unavailable`.
    """
    words = F.size(X.words(F.coalesce("summary", F.lit(""))))
    level = F.least(F.col("source_count"), F.lit(10))
    out = with_status(detail).select(
        "story_id", "title", X.normalize_category(F.col("category")).alias("category"), F.greatest(F.lit(1), F.floor(words / 200)).cast("int").alias("minutes"), "status",
        F.round(level / 10, 6).alias("credibility"), F.round(F.when(F.col("breaking"), 0.9).otherwise(F.col("importance") / 10), 6).alias("trending"),
    )
    if urls is None:
        return out
    first = urls.filter(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")).groupBy("story_id").agg(F.min_by("url", "place").alias("url"))
    return out.join(first, "story_id", "left").withColumn("url", F.coalesce("url", F.lit(unavailable)))


def display_columns(stories: DataFrame, asof: Column) -> DataFrame:
    """Updated thirty minutes or more after publication; age in m, h or d; summary without heading or refusal."""
    minutes = F.floor((asof.cast("long") - F.col("first_seen").cast("long")) / 60)
    age = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
    shown = F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"^#+\s*", ""))
    late = F.col("last_updated").cast("long") - F.col("first_seen").cast("long") >= 1800
    return stories.withColumns({"updated": late, "age": age, "shown": F.when(X.refusal(shown), "").otherwise(shown)})


def etag(stories: DataFrame, params: dict[str, str]) -> DataFrame:
    """One row: md5 of the latest update and the request's parameters."""
    return stories.agg(F.md5(F.concat_ws("|", F.max("last_updated").cast("long").cast("string"), *[F.lit(f"{k}={v}") for k, v in sorted(params.items())]).cast("binary")).alias("etag"))


def drop_promotional(df: DataFrame, title: str = "headline") -> DataFrame:
    return df.filter(~X.promotional(F.col(title), F.col("description"), F.col("url")))


def drop_promotional_light(df: DataFrame, title: str = "headline") -> DataFrame:
    return df.filter(~X.promotional_light(F.col(title), F.col("description"), F.col("url")))


def promotional_sweep(stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts by pattern, stories that stay)."""
    hit = F.filter(F.array(*[F.when(F.lower("title").rlike(p), F.lit(p)) for p in (*vocab.PROMO_PHRASES, *vocab.PROMO_PATTERNS)]), lambda x: x.isNotNull())
    marked = stories.withColumn("__hit", hit)
    return marked.select(F.explode("__hit").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")), marked.filter(F.size("__hit") == 0).drop("__hit")


def flag_test_stories(stories: DataFrame, members: DataFrame) -> DataFrame:
    """(story_id, reason): test-like titles, more than half test-like sources, or more than a hundred."""
    one = members.groupBy("story_id").agg(F.count("*").alias("n"), F.count_if(F.lower("source").rlike("test|example|dummy|src1$")).alias("t"))
    reason = F.when(F.lower("title").rlike(r"\btest\b|lorem ipsum|example story"), "title").when(F.col("t") * 2 > F.col("n"), "sources").when(F.col("n") > 100, "count")
    return stories.join(one, "story_id").select("story_id", reason.alias("reason")).filter("reason is not null")


def visible_stories(stories: DataFrame, category: str | None, asof: Column) -> DataFrame:
    """Two days without lifestyle; seven days of one category; top stories without soft categories, with a current status."""
    days = 2 if category in (None, "top_stories") else 7
    rows = stories.filter((F.col("last_updated") >= asof - F.expr(f"interval {days} days")) & (F.col("last_updated") <= asof + F.expr("interval 3650 days")))
    if category is None:
        return rows.filter("category <> 'lifestyle'")
    if category == "top_stories":
        return with_status(rows).filter(~F.col("category").isin(*vocab.SOFT_CATEGORIES) & (F.col("status") != "NEW")).drop("status")
    return rows.filter(F.col("category") == category)


def needs_summary(stories: DataFrame, asof: Column, hours: int, n: int) -> DataFrame:
    """The n latest stories without a summary that changed within the hours before asof, but those that are only monitored."""
    recent = F.col("last_updated") >= asof - F.expr(f"interval {hours} hours")
    watched = F.coalesce(F.col("status") != "MONITORING", F.lit(True))
    return stories.filter((F.length(F.coalesce("summary", F.lit(""))) == 0) & (F.col("source_count") >= 1) & watched & recent).orderBy(F.desc("last_updated"), "story_id").limit(n)


def needs_enrichment(articles: DataFrame, asof: Column, vectors: DataFrame, linked: DataFrame | None = None, least_confidence: float = 0.3, geography: bool = False) -> DataFrame:
    """Processed articles of the last seven days that lack a vector, entity links, a signature or places.

    linked (doc_id): the articles whose entities are linked; None turns that gate off. A signature is missing where
    `signature` is null and `confidence` is least_confidence or more, if articles has these columns; places where
    `places` is null, if geography is asked for.
    """
    fresh = articles.filter("processed").filter(F.floor((asof.cast("long") - F.col("published_at").cast("long")) / 86400) <= 7)
    j = fresh.join(vectors.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("__vector")).distinct(), "doc_id", "left")
    lacks = F.col("__vector").isNull()
    if linked is not None:
        j = j.join(linked.select("doc_id", F.lit(True).alias("__linked")).distinct(), "doc_id", "left")
        lacks = lacks | F.col("__linked").isNull()
    if "signature" in articles.columns:
        lacks = lacks | (F.col("signature").isNull() & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence))
    if geography:
        lacks = lacks | F.col("places").isNull()
    return j.filter(lacks).select(articles.columns)


def validate_stories(detail: DataFrame) -> DataFrame:
    """(story_id, issues) of stories with an issue. detail: story_id, title, category, last_updated, sources (null: none listed).

    Where sources are structs, each must be there and have a source and a title; where last_updated is text, it must be an ISO date or time.
    """
    issue = lambda c, name: F.when(c, F.lit(name))
    title, n = F.coalesce("title", F.lit("")), F.coalesce(F.size("sources"), F.lit(0))
    issues = [
        issue(F.col("title").isNull(), "no title"), issue(F.col("category").isNull(), "no category"), issue(F.col("last_updated").isNull(), "no time"), issue(F.length(F.trim(title)) < 10, "short title"), issue(F.length(title) > 200, "long title"),
        issue(n <= 0, "no sources"), issue(n > 20, "many sources"), issue(~F.col("category").isin(*vocab.CATEGORIES, "tech", "us", "europe", "australia", "general"), "unknown category"),
    ]
    if isinstance(detail.schema["last_updated"].dataType, T.StringType):
        iso = F.col("last_updated").rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$") & F.try_to_timestamp("last_updated").isNotNull()
        issues.append(issue(F.col("last_updated").isNotNull() & ~iso, "bad time"))
    found = F.array(*issues)
    if isinstance(detail.schema["sources"].dataType.elementType, T.StructType):
        each = lambda x, i: F.when(x.isNull(), F.concat(F.lit("source "), i.cast("string"), F.lit(" is nothing"))).when(x["source"].isNull() | x["title"].isNull(), F.concat(F.lit("source "), i.cast("string"), F.lit(" lacks a field")))
        found = F.concat(found, F.coalesce(F.transform("sources", each), F.array().cast("array<string>")))
    return detail.select("story_id", F.filter(found, lambda x: x.isNotNull()).alias("issues")).filter(F.size("issues") > 0)


def ready_feeds(feeds: DataFrame, state: DataFrame, asof: Column, seconds: int) -> DataFrame:
    """Feeds never polled, or polled at least `seconds` before asof."""
    return feeds.join(state.select("feed", "last_poll"), "feed", "left").filter(F.col("last_poll").isNull() | (asof.cast("long") - F.col("last_poll").cast("long") >= seconds)).drop("last_poll")


def rank_entities(df: DataFrame, title: str = "headline", description: str = "description", found: str = "entities", keep: int = 10) -> DataFrame:
    """The entities by salience: 1 for one that the title holds, half of 1 - start / 5000, and .3 of its confidence.

    start is its first place in title and description; confidence is .5, .2 more for several words, .1 more for capitals alone.
    """
    text, low = F.concat_ws(" ", title, description), F.lower(title)

    def salience(name: Column) -> Column:
        sure = 0.5 + F.when(F.size(X.words(name)) > 1, 0.2).otherwise(0.0) + F.when((F.upper(name) == name) & (F.lower(name) != name), 0.1).otherwise(0.0)
        return F.when(F.contains(low, F.lower(name)), 1.0).otherwise(0.0) + 0.5 * (1 - (F.position(name, text) - 1) / 5000) + 0.3 * F.least(sure, F.lit(1.0))

    scored = F.array_sort(F.transform(F.col(found), lambda e, i: F.struct((-F.round(salience(e["text"]), 6)).alias("s"), i.alias("i"), e["text"].alias("text"), e["type"].alias("type"))))
    return df.withColumn("ranked", F.transform(F.slice(scored, 1, keep), lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), (-x["s"]).alias("salience"))))


def normalize_articles(df: DataFrame, url: str = "url") -> DataFrame:
    """domain from the URL, and the body without tags."""
    return df.withColumns({"domain": F.lower(F.parse_url(url, F.lit("HOST"))), "body": X.clean_text(F.col("text"), decode=False)})


def embedding_text(df: DataFrame, title: str = "headline", n: int = 500) -> DataFrame:
    return df.withColumn("embedding_text", F.trim(F.concat(F.col(title), F.lit(" "), F.substring("description", 1, n))))


def blend_vectors(df: DataFrame, text: str = "text_vector", names: str = "entity_vector", share: float = 0.3, out: str = "embedding") -> DataFrame:
    """out: share of the entity vector and the rest of the text vector, at unit length; the text vector alone where the other is null."""
    both = F.zip_with(text, names, lambda x, y: (1 - share) * x.cast("double") + share * y.cast("double"))
    return df.withColumn(out, F.when(F.col(names).isNull(), F.transform(text, lambda x: x.cast("double"))).otherwise(Z.unit(both)))
