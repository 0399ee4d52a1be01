"""Clustering of articles into stories, and the upkeep of stories: merging, splitting, decay, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as Z
from ..sources.io import durable
from .articles import with_status
from .joins import centroids


def fresh_articles(articles: DataFrame, asof: Column) -> DataFrame:
    """Those that aren't processed yet and no older than seven whole days."""
    return articles.filter(~F.col("processed") & (F.floor((asof.cast("long") - F.col("published_at").cast("long")) / 86400) <= 7))


def start_story(tier: Column) -> dict[str, Column]:
    """What a story starts with: importance 50, and 20 more from a first-tier source, which also makes it breaking news; confidence 40."""
    first = F.coalesce(tier == 1, F.lit(False))
    return {"importance": F.when(first, 70).otherwise(50), "confidence": F.lit(40), "breaking": first}


def new_stories(articles: DataFrame) -> DataFrame:
    """The stories that unmatched articles (doc_id, headline, category, source, tier, published_at) start, one each."""
    start = start_story(F.col("tier"))
    return articles.select((-F.col("doc_id") - 1).alias("story_id"), F.col("headline").alias("title"), "category", F.lit("NEW").alias("status"), F.lit(1).alias("verification_level"), F.lit(1).alias("source_count"), F.col("published_at").alias("first_seen"), *[c.alias(n) for n, c in start.items()])


def mark_processed(articles: DataFrame, looked: DataFrame) -> DataFrame:
    """articles with processed and story_id of looked (doc_id, story_id), the articles that a run looked at; the next run leaves these out."""
    seen = looked.select("doc_id", F.col("story_id").alias("__s"))
    j = articles.join(seen, "doc_id", "left")
    return j.withColumns({"processed": F.col("processed") | F.col("__s").isNotNull(), "story_id": F.coalesce("__s", "story_id")}).select(articles.columns)


def assign_batch(articles: DataFrame, matches: DataFrame, members: DataFrame, asof: Column) -> DataFrame:
    """(doc_id, story_id, created): one micro-batch against a snapshot.

    Only unprocessed articles no older than seven days. A matched story takes one article of each source that it hasn't got, the first
    published; other matched articles are dropped; each unmatched one starts a story of its own id.
    """
    j = fresh_articles(articles, asof).join(matches.select("doc_id", F.col("story_id").alias("match")), "doc_id", "left")
    hit = j.filter("match is not null")
    new = hit.join(members.select(F.col("story_id").alias("match"), "source").distinct(), ["match", "source"], "left_anti")
    first = new.groupBy("match", "source").agg(F.min_by("doc_id", F.struct("published_at", "doc_id")).alias("doc_id"))
    added = first.select("doc_id", F.col("match").alias("story_id"), F.lit(False).alias("created"))
    return added.unionByName(j.filter("match is null").select("doc_id", (-F.col("doc_id") - 1).alias("story_id"), F.lit(True).alias("created")))


def refresh_stories(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(story_id, source_count, status, breaking, last_updated, centroid) from members (story_id, doc_id, source, tier, published_at)."""
    about = members.groupBy("story_id").agg(F.count_distinct("source").cast("int").alias("source_count"), F.min("tier").alias("best"), F.max("published_at").alias("last_updated"))
    about = with_status(about).withColumn("breaking", (F.col("best") == 1) | (F.col("source_count") >= 3)).drop("best")
    v = members.select("story_id", "doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return about.join(centroids(v), "story_id", "left")


def merge_candidates(stories: DataFrame, asof: Column, least_jaccard: float = 0.6, least_overlap: float = 0.5, least_geography: float = 0.7, least_signature: float = 0.8, least_cosine: float | None = None) -> DataFrame:
    """(a, b, jaccard): story pairs of a category, two members or more, both updated within seven days, alike in all else.

    stories: story_id, category, n_articles, first_seen, last_updated, names (entities in lower case), places, signature,
    and centroid where least_cosine is given, which then stands for geography and signature. Time: what both cover, over the
    longer of the two. Geography is the ratio of the places, .5 where either has none; a missing signature counts .5 as well.

    Pairs meet by prefix filtering: sets with a ratio of j or more share one of their first n - ceil(j n) + 1 names in any
    common order, here the rarest first, and a day, as stories that overlap do. So no pair is missed, and frequent names
    bring few stories together.
    """
    age = F.floor((asof.cast("double") - F.col("last_updated").cast("double")) / 86400)
    live = stories.filter((F.col("n_articles") >= 2) & (age >= 0) & (age <= 7) & (F.size("names") > 0))
    extra = ["centroid"] if least_cosine is not None else ["places", "signature"]
    live = live.select("story_id", "category", "names", F.col("first_seen").cast("double").alias("s"), F.col("last_updated").cast("double").alias("e"), *extra)
    df = live.select(F.explode(F.array_distinct("names")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = live.select("story_id", F.explode(F.array_distinct("names")).alias("t")).join(df, "t").groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))
    first = F.slice("o", 1, (F.size("o") - F.ceil(F.round(F.lit(least_jaccard) * F.size("o"), 9)) + 1).cast("int"))
    days = F.explode(F.sequence(F.floor(F.col("s") / 86400), F.floor(F.col("e") / 86400)))
    post = live.join(ranked.select("story_id", F.explode(first).alias("p")), "story_id").select("story_id", "category", F.col("p.t").alias("t"), days.alias("day"))
    pairs = post.withColumnRenamed("story_id", "a").join(post.withColumnRenamed("story_id", "b"), ["category", "t", "day"]).filter("a < b").select("a", "b").distinct()
    one = live.drop("category")
    j = pairs.join(one.select(F.col("story_id").alias("a"), F.struct(*[c for c in one.columns if c != "story_id"]).alias("x")), "a").join(one.select(F.col("story_id").alias("b"), F.struct(*[c for c in one.columns if c != "story_id"]).alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    both, longer = F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]), F.greatest(x["e"] - x["s"], y["e"] - y["s"])
    overlap = F.when((both > 0) & (longer > 0), both / longer).otherwise(0.0)
    jac = Z.jaccard(x["names"], y["names"])
    j = j.filter((overlap >= least_overlap) & (jac >= least_jaccard))
    if least_cosine is not None:
        j = j.filter(Z.cosine(x["centroid"], y["centroid"]) >= least_cosine)
    else:
        some = (F.coalesce(F.size(x["places"]), F.lit(0)) > 0) & (F.coalesce(F.size(y["places"]), F.lit(0)) > 0)
        j = j.filter(F.when(some, Z.jaccard(x["places"], y["places"])).otherwise(0.5) >= least_geography)
        known = x["signature"].isNotNull() & y["signature"].isNotNull()
        j = j.filter(F.round(F.when(known, Z.signature_similarity(x["signature"], y["signature"])).otherwise(0.5), 9) >= least_signature)
    return j.select("a", "b", F.round(jac, 6).alias("jaccard"))


def merged_profiles(members: DataFrame, entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """(story_id, level, histogram, centroid) of merged members (story_id, doc_id): their number, entity counts and mean vector.

    entities: doc_id, name. The histogram of two stories that merged is the sum of theirs, less what a shared member counts twice.
    """
    level = members.groupBy("story_id").agg(F.count("*").alias("level"))
    counts = members.join(entities, "doc_id").groupBy("story_id", "name").agg(F.count("*").alias("n"))
    tops = counts.groupBy("story_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("histogram"))
    v = members.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return level.join(tops, "story_id", "left").join(centroids(v), "story_id", "left")


def merge_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """members (story_id, doc_id) after merging pairs (a, b): the larger story of a pair takes the other's members; of equals the smaller id.

    A story merges once a run, into the largest of its partners; the next run goes on from there.
    """
    size = members.groupBy("story_id").agg(F.count("*").alias("n"))
    j = pairs.join(size.select(F.col("story_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("story_id").alias("b"), F.col("n").alias("nb")), "b")
    move = j.select(F.when(F.col("nb") > F.col("na"), F.col("a")).otherwise(F.col("b")).alias("story_id"), F.when(F.col("nb") > F.col("na"), F.col("b")).otherwise(F.col("a")).alias("to"), F.greatest("na", "nb").alias("n"))
    move = move.groupBy("story_id").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("to"))
    stay = move.join(move.select(F.col("story_id").alias("to")), "to", "left_anti")  # not into a story that itself moves
    return members.join(stay, "story_id", "left").select(F.coalesce("to", "story_id").alias("story_id"), "doc_id").distinct()


def split_clusters(members: DataFrame, least: int = 10, days: float = 3.0) -> DataFrame:
    """(story_id, doc_id, part): stories of `least` members or more over `days` or more, halved by time; part 0 elsewhere."""
    about = members.groupBy("story_id").agg(F.count("*").alias("n"), (F.max("published_at").cast("double") - F.min("published_at").cast("double")).alias("span"))
    due = about.filter((F.col("n") >= least) & (F.col("span") >= days * 86400)).select("story_id", "n")
    w = Window.partitionBy("story_id").orderBy("published_at", "doc_id")
    cut = members.join(due, "story_id").withColumn("part", F.when(F.row_number().over(w) * 2 > F.col("n"), 2).otherwise(1)).select("story_id", "doc_id", "part")
    return cut.unionByName(members.join(due.select("story_id"), "story_id", "left_anti").select("story_id", "doc_id", F.lit(0).alias("part")))


#: Rows of a story that are worked on in one task, and rounds of k-means.
STORY_ROWS, ROUNDS = 10_000, 25


def _per_dimension(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name, n): the mean of value, an array, by keys, to nine digits, so that it doesn't hang on the order of sums, which are made where the rows lie."""
    by = rows.select(*keys, F.posexplode(value).alias("i", "x")).groupBy(*keys, "i").agg(F.round(F.avg("x"), 9).alias("m"), F.count("*").alias("n"))
    return by.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias(name), F.max("n").alias("n"))


def _placed(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (story_id, salt, doc_id, v) with the nearest centre's part, and its distance d and that of the next one e (squares)."""
    far = F.transform("centres", lambda c: F.struct(F.aggregate(F.zip_with("v", c["c"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), c["part"].alias("part")))
    near = rows.join(centres, ["story_id", "salt"]).withColumn("o", F.array_sort(far))
    return near.select("story_id", "salt", "doc_id", "v", F.col("o")[0]["part"].alias("part"), F.col("o")[0]["d"].alias("d"), F.get("o", F.lit(1))["d"].alias("e"))


def _k_means(rows: DataFrame, k: Column, salts: DataFrame, seed: int) -> DataFrame:
    """_placed after k-means in every story at once, from the k members of the least seeded hashes; rows: story_id, salt, doc_id, v, n.

    Centres are a table: a row a story, sent to each of its salts by a join. A round's result is written, and rounds end when no part's mean moves.
    """
    h = F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("h"), "doc_id", "v")
    w = Window.partitionBy("story_id").orderBy("h.h", "h.doc_id")
    least = rows.select("story_id", "salt", h.alias("h"), k.alias("k")).withColumn("r", F.row_number().over(Window.partitionBy("story_id", "salt").orderBy("h.h", "h.doc_id"))).filter(F.col("r") <= F.col("k"))
    means = least.select("story_id", "k", "h", F.row_number().over(w).alias("r")).filter(F.col("r") <= F.col("k")).select("story_id", (F.col("r") - 1).cast("int").alias("part"), F.col("h.v").alias("c"))
    means = durable(means)
    for _ in range(ROUNDS):
        one = means.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("part", "c"))).alias("centres")).join(salts, "story_id")
        placed = _placed(rows, one)
        new = _per_dimension(placed, ["story_id", "part"], F.col("v"), "c").select("story_id", "part", "c")
        new = durable(new.unionByName(means.join(new.select("story_id", "part"), ["story_id", "part"], "left_anti")))  # an empty part keeps its centre
        still = new.join(means.withColumnRenamed("c", "was"), ["story_id", "part"]).filter("c <> was").isEmpty()
        means = new
        if still:
            break
    one = means.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("part", "c"))).alias("centres")).join(salts, "story_id")
    return durable(_placed(rows, one))


def _member_vectors(members: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows, salts) of the stories with `least` member vectors or more: story_id, salt, doc_id, v, n; and each story's salts."""
    some = members.filter(F.col("embedding").isNotNull())
    size = durable(some.groupBy("story_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    parts = F.floor(F.col("n") / STORY_ROWS) + 1
    rows = some.select("story_id", "doc_id", F.col("embedding").cast("array<double>").alias("v")).join(size, "story_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), parts))
    return durable(rows), size.select("story_id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))


def separation(members: DataFrame, least: int = 10, seed: int = 7) -> DataFrame:
    """(story_id, silhouette, n): how well two parts by k-means part each story's member vectors (story_id, doc_id, embedding).

    The simplified silhouette: the mean of (b - a) / max(a, b), a being a member's distance to its own part's mean and b that to the other
    mean. It takes one pass over the members, not one over their pairs. 0 for a story with one part, or whose vectors are all equal.
    """
    rows, salts = _member_vectors(members, least)
    d = _k_means(rows, F.lit(2), salts, seed).withColumns({"a": F.sqrt("d"), "b": F.sqrt("e")})
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    by = d.groupBy("story_id").agg(F.avg(s).alias("s"), F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n"))
    return by.select("story_id", F.when(F.col("x") != F.col("y"), F.round("s", 6)).otherwise(0.0).alias("silhouette"), "n")


def split_due(members: DataFrame, least: int = 10, days: float = 3.0, clear: float = 0.6, seed: int = 7) -> DataFrame:
    """(story_id) of the stories to split: `least` members or more, over `days` or more, with a silhouette above `clear`.

    members: story_id, doc_id, published_at, embedding. The silhouette needs `least` vectors.
    """
    span = F.max("published_at").cast("double") - F.min("published_at").cast("double")
    old = members.groupBy("story_id").agg(F.count("*").alias("n"), span.alias("span")).filter((F.col("n") >= least) & (F.col("span") >= days * 86400))
    return separation(members.join(old.select("story_id"), "story_id", "left_semi"), least, seed).filter(F.col("silhouette") > clear).select("story_id")


def split_by_vectors(members: DataFrame, least: int = 10, seed: int = 7) -> DataFrame:
    """(story_id, doc_id, part): k-means over each large story's member vectors, k = min(3, n / 4); parts of one member are dropped.

    members: story_id, doc_id, embedding. All stories are fitted together by one rule, from the k members of the least seeded hashes; a
    large story's rows are worked on in parts, and nothing of a story comes to the driver.
    """
    rows, salts = _member_vectors(members, least)
    placed = _k_means(rows, F.least(F.lit(3), F.floor(F.col("n") / 4)), salts, seed)
    size = placed.groupBy("story_id", "part").agg(F.count("*").alias("m")).filter("m >= 2")
    return placed.join(size, ["story_id", "part"]).select("story_id", "doc_id", "part")


def decay(stories: DataFrame, asof: Column) -> DataFrame:
    """(story_id, reason): single members after 14 days, pairs after 21, all after 30."""
    age = (asof.cast("double") - F.col("last_updated").cast("double")) / 86400
    reason = F.when((F.col("n_articles") == 1) & (age > 14), "single").when(age > 30, "old").when((F.col("n_articles") <= 2) & (age > 21), "small")
    return stories.select("story_id", reason.alias("reason")).filter("reason is not null")


def bucket(key: Column, mod: int = 10_000) -> Column:
    """md5 of a text as a number, modulo mod: by its two halves, as 128 bits fit no number type."""
    h = F.md5(key.cast("binary"))
    half = lambda a: F.conv(F.substring(h, a, 16), 16, 10).cast("decimal(20,0)")
    hi, lo = half(1) % mod, half(17) % mod
    return ((hi * ((1 << 64) % mod) + lo) % mod).cast("int")


def assign_variant(df: DataFrame, key: str, experiment: str, split: dict[str, float], active: bool = True) -> DataFrame:
    """variant by cumulative shares of 10,000 buckets of md5(experiment:key); control where the experiment rests."""
    b = bucket(F.concat(F.lit(f"{experiment}:"), F.col(key).cast("string")))
    out, at = None, 0.0
    for name, share in split.items():
        at += share
        cond = b < round(at * 10_000)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return df.withColumn("variant", out.otherwise("control") if active else F.lit("control"))


def rollout_plan(current: DataFrame, target: DataFrame, steps: int) -> DataFrame:
    """(step, variant, share): linear steps from current to target shares (variant, share)."""
    j = current.select("variant", F.col("share").alias("a")).join(target.select("variant", F.col("share").alias("b")), "variant", "full").fillna(0.0, ["a", "b"])
    return j.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select("step", "variant", F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("step") / steps, 6).alias("share"))


def status_history(members: DataFrame) -> DataFrame:
    """(story_id, doc_id, status): the status after each member, where it changes. members: story_id, doc_id, source, published_at."""
    first = members.groupBy("story_id", "source").agg(F.min(F.struct("published_at", "doc_id")).alias("f")).select("story_id", "f.*")
    w = Window.partitionBy("story_id").orderBy("published_at", "doc_id")
    rows = with_status(first.withColumn("source_count", F.row_number().over(w)))
    return rows.withColumn("before", F.lag("status").over(w)).filter("before is null or before <> status").select("story_id", "doc_id", "status")


def eligibility(stories: DataFrame, asof: Column) -> DataFrame:
    """(story_id, demote, archive): not updated for more than an hour, or for more than seven days."""
    age = asof.cast("double") - F.col("last_updated").cast("double")
    return stories.select("story_id", (age > 3600).alias("demote"), (age > 7 * 86400).alias("archive"))


def ingest_batch_results(results: DataFrame, stories: DataFrame, fallback: DataFrame | None = None, batches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts by batch, summaries by story) of results (batch_id, story_id, type, text).

    A succeeded answer becomes its story's summary; for a refusal the fallback (story_id, summary) of the story stands in,
    and without one the story stays as it is. Errors and expired requests leave it, too. words counts the summary's. With batches
    (batch_id, processing, error) only the results of those that ended without an error are looked at.
    """
    from ..functions.text import refusal, words

    if batches is not None:
        results = results.join(batches.filter((F.col("processing") == "ended") & F.col("error").isNull()).select("batch_id"), "batch_id", "left_semi")
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    counts = results.groupBy("batch_id").agg(F.count("*").alias("requests"), n("succeeded"), n("errored"), n("expired"), F.lit("completed").alias("status"))
    good = stories.select("story_id").join(results.filter("type = 'succeeded'").select("batch_id", "story_id", F.trim("text").alias("text")), "story_id")
    refused = refusal(F.col("text"))
    if fallback is not None:
        good = good.join(fallback.select("story_id", F.col("summary").alias("other")), "story_id", "left").withColumn("text", F.when(refused, F.col("other")).otherwise(F.col("text")))
    else:
        good = good.filter(~refused)
    return counts, good.filter("text is not null").select("batch_id", "story_id", F.col("text").alias("summary"), F.size(words(F.col("text"))).alias("words"))


def update_tracking(tracking: DataFrame, batches: DataFrame, results: DataFrame, asof: Column) -> DataFrame:
    """tracking (batch_id, status, story_categories, story_counts; maps by story) with what became of its pending batches.

    batches: batch_id, processing, error; results: batch_id, story_id, type. A batch whose retrieval failed is failed, with the error; one that
    ended is completed, at asof, with its succeeded requests and its errored ones, expired and unknown ones among these; one that is still
    running, or of which nothing is known, stays as it is. Batches that aren't pending (submitted, in_progress) are left alone.
    """
    done = results.groupBy("batch_id").agg(F.count_if(F.col("type") == "succeeded").alias("__ok"), F.count_if(~F.col("type").eqNullSafe("succeeded")).alias("__bad"))
    j = tracking.join(batches.select("batch_id", "processing", F.col("error").alias("__error")), "batch_id", "left").join(done, "batch_id", "left")
    pending = F.col("status").isin("submitted", "in_progress")
    failed, ended = pending & F.col("__error").isNotNull(), pending & F.col("__error").isNull() & F.coalesce(F.col("processing") == "ended", F.lit(False))
    status = F.when(failed, "failed").when(ended, "completed").otherwise(F.col("status"))
    count = lambda c: F.when(ended, F.coalesce(F.col(c), F.lit(0)))
    return j.select(*tracking.drop("status").columns, status.alias("status"), F.when(ended, asof).alias("ended_at"), count("__ok").alias("succeeded_count"), count("__bad").alias("errored_count"), F.when(failed, F.col("__error")).alias("error"))


def batch_summaries(summaries: DataFrame, tracking: DataFrame, usage: DataFrame, prices: tuple[float, float, float] = (0.5, 0.05, 2.5)) -> DataFrame:
    """summaries (batch_id, story_id, summary, words) with version, category and source_count as tracked (general and 1 where they aren't), and cost_usd.

    usage: batch_id, story_id, input, cached, output (tokens); prices in dollars a million: of input that isn't cached, of cached, of output.
    """
    j = summaries.join(tracking.select("batch_id", "story_categories", "story_counts"), "batch_id", "left").join(usage, ["batch_id", "story_id"], "left")
    key = F.col("story_id")
    cost = (F.col("input") - F.col("cached")) * prices[0] + F.col("cached") * prices[1] + F.col("output") * prices[2]
    return j.select(
        "batch_id", "story_id", "summary", "words", F.lit(1).alias("version"), F.coalesce(F.try_element_at("story_categories", key), F.lit("general")).alias("category"),
        F.coalesce(F.try_element_at("story_counts", key), F.lit(1)).alias("source_count"), F.round(cost / 1_000_000, 6).alias("cost_usd"),
    )
