"""Structured Streaming forms. Each has a batch twin; clustering gives the rows of its twin run slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import similarity as Z
from ..operators.articles import with_status
from ..operators.clusters import assign_batch, fresh_articles, start_story
from ..operators.joins import RECENT, block_keys, match_stories, simhash, vector_sums


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run the stream over what there is, batch by batch, and stop. `each` must be idempotent by batch id.

    The query keeps its state in RocksDB, as timers need it; it takes the session's settings when it starts, so they are put back then.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    query.awaitTermination()


#: Columns of a live story: all that matching and updating it needs.
LIVE = ("story_id", "title", "centroid", "last_updated", "total", "n", "sources", "best", "breaking", "importance", "confidence")


def live_stories(stories: DataFrame, members: DataFrame, vectors: DataFrame, recent: int = RECENT) -> DataFrame:
    """LIVE of the `recent` latest stories: their vectors' sum and number, their sources and best tier.

    stories: story_id, title, centroid, last_updated, and breaking, importance, confidence where they are known; members: story_id, doc_id, source, tier.
    """
    extra = {"breaking": "boolean", "importance": "int", "confidence": "int"}
    top = stories.filter("centroid is not null").orderBy(F.desc("last_updated"), "story_id").limit(recent)
    top = top.select("story_id", "title", "centroid", "last_updated", *[F.col(c) if c in top.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()])
    own = members.join(F.broadcast(top.select("story_id")), "story_id", "left_semi").groupBy("story_id", "doc_id").agg(F.first("source", True).alias("source"), F.min("tier").alias("tier"))
    about = own.groupBy("story_id").agg(F.collect_set("source").alias("sources"), F.min("tier").alias("best"))
    sums = vector_sums(own.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id"))
    return top.join(about, "story_id", "left").join(sums, "story_id", "left").withColumns({"sources": F.coalesce("sources", F.array().cast("array<string>")), "n": F.coalesce("n", F.lit(0).cast("long"))}).select(*LIVE)


def cluster_stream(changes: DataFrame, checkpoint: str, stories: DataFrame, members: DataFrame, vectors: DataFrame, asof: Column, out: str, accept: float = 0.75, maybe: float = 0.68, recent: int = RECENT) -> None:
    """Each micro-batch is assigned as in the batch form, against what earlier batches made of the stories.

    Only the `recent` latest stories can be matched, and a story that isn't changed never becomes a later one again. So the state is that many live stories
    with their vectors' sum, their number and their sources: batch n reads those of batch n - 1 and writes its own, and costs the
    same however many batches there were. Each folder of out holds a batch under its id, so a batch that runs again replaces itself: members (doc_id, story_id,
    created and the article's columns), stories (those that are new or changed, as deltas; see stories_at), processed (doc_id, story_id: every article
    that was looked at, with the story that took it or already had its source), live.
    stories: story_id, title, centroid, last_updated; members: story_id, doc_id, source, tier, published_at (null where
    only the vector counts); vectors: vec_id, embedding. Stories without a vector can't match and are no candidates.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        get = lambda name, n=number: spark.read.parquet(f"{out}/{name}/batch={n}")
        if not number:
            live_stories(stories, members, vectors, recent).write.mode("overwrite").parquet(f"{out}/live/batch=-1")
        live = get("live", number - 1)
        v = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        rows = batch.join(v, "doc_id")
        matches = match_stories(rows, live, accept, maybe, recent)
        put(matches.select("doc_id", "story_id"), "matches")
        matches = get("matches")
        got = assign_batch(batch, matches, live.select("story_id", F.explode("sources").alias("source")), asof)
        put(got.join(batch.select("doc_id", "source", "tier", "published_at", "headline"), "doc_id"), "members")
        looked = fresh_articles(batch, asof).select("doc_id").join(matches, "doc_id", "left")
        put(looked.select("doc_id", F.coalesce("story_id", -F.col("doc_id") - 1).alias("story_id"), F.lit(True).alias("processed")), "processed")
        added = get("members")
        new = added.groupBy("story_id").agg(F.collect_set("source").alias("s"), F.min("tier").alias("t"), F.max("published_at").alias("at"), F.max(F.struct("created", F.col("headline").alias("title"))).alias("c"))
        sums = vector_sums(added.select("story_id", "doc_id").join(v.withColumnRenamed("vector", "embedding"), "doc_id")).select("story_id", F.col("total").alias("more"), F.col("n").alias("k"))
        j = new.join(sums, "story_id", "left").join(live.withColumnRenamed("title", "known"), "story_id", "left")
        start = start_story(F.col("t"))
        both = F.when(F.col("total").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda x, y: x + y))
        sources = F.when(F.col("sources").isNull(), F.col("s")).otherwise(F.array_union("sources", "s"))
        changed = j.select(
            "story_id", F.when(F.col("c.created"), F.col("c.title")).otherwise(F.col("known")).alias("title"), F.greatest("last_updated", "at").alias("last_updated"), both.alias("total"), (F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("n"),
            sources.alias("sources"), F.least("best", "t").alias("best"), "breaking", F.when(F.col("c.created"), start["importance"]).otherwise(F.col("importance")).alias("importance"), F.when(F.col("c.created"), start["confidence"]).otherwise(F.col("confidence")).alias("confidence"),
        )
        count = F.size("sources")
        changed = changed.withColumns({"centroid": Z.unit(F.col("total")), "breaking": F.coalesce("breaking", F.lit(False)) | F.coalesce(F.col("best") == 1, F.lit(False)) | (count >= 3)}).filter("centroid is not null")
        put(with_status(changed.withColumn("source_count", count)), "stories")
        done = get("stories")
        every = live.join(done.select("story_id"), "story_id", "left_anti").select(*LIVE).unionByName(done.select(*LIVE))
        put(every.orderBy(F.desc("last_updated"), "story_id").limit(recent), "live")

    drain(changes, checkpoint, each)


def stories_at(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The stories that cluster_stream made or changed, each as its last batch (up to `upto`) left it; from the last fold and the batches after it."""
    parts = spark.read.option("basePath", f"{out}/stories").parquet(f"{out}/stories")
    if upto is not None:
        parts = parts.filter(F.col("batch") <= upto)
    cols = [c for c in parts.columns if c != "story_id"]
    return parts.groupBy("story_id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("story_id", "s.*")


def summary_triggers(changes: DataFrame) -> DataFrame:
    """Stories without a summary, or with more sources than at their last one (summary_sources)."""
    return changes.filter(F.col("summary").isNull() | (F.col("source_count") > F.coalesce("summary_sources", F.lit(0))))


def notify_stream(stories: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A verified story's first row, within half an hour of its first sight; once a story. Needs an event time, last_updated."""
    due = stories.filter((F.col("source_count") >= 3) & (F.col("source_count") < 5) & (F.col("last_updated") <= F.col("first_seen") + F.expr("interval 30 minutes")))
    return due.withWatermark("last_updated", delay).dropDuplicatesWithinWatermark(["story_id"])


def ingest_windows(articles: DataFrame, width: str = "5 minutes", delay: str = "10 minutes", sources: bool = False) -> DataFrame:
    """(start, n, and with sources how many there were): tumbling counts of fetched_at; late rows beyond the watermark are left out of a stream."""
    rows = articles.withWatermark("fetched_at", delay) if articles.isStreaming else articles
    more = [F.size(F.collect_set("source")).alias("sources")] if sources else []
    counted = rows.groupBy(F.window("fetched_at", width)).agg(F.count("*").alias("n"), *more)
    return counted.select(F.col("window.start").cast("long").alias("start"), "n", *[c for c in counted.columns if c == "sources"])


def feed_activity(feeds: DataFrame, articles: DataFrame, asof: Column, minutes: int = 10) -> DataFrame:
    """(source, last_fetched, inactive) of each expected source: inactive are those without an article in the minutes before asof, if they ever had one."""
    last = articles.filter(F.col("fetched_at") <= asof).groupBy("source").agg(F.max("fetched_at").alias("last_fetched"))
    recent = F.col("last_fetched") > asof - F.expr(f"interval {minutes} minutes")
    return feeds.select("source").distinct().join(last, "source", "left").withColumn("inactive", ~F.coalesce(recent, F.lit(False)))


def dedup_stream(articles: DataFrame, memory: str = "7 days") -> DataFrame:
    """The first article of equal title and domain within a week."""
    keyed = articles.withColumn("digest", F.md5(F.concat_ws("|", F.lower("title"), F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit(""))).cast("binary")))
    return keyed.withWatermark("published_at", memory).dropDuplicatesWithinWatermark(["digest"]) if articles.isStreaming else keyed.dropDuplicates(["digest"])


def ingest_active(articles: DataFrame, asof: Column, minutes: int = 5) -> DataFrame:
    """One row: the articles fetched in the minutes before asof, and whether there are any."""
    recent = (F.col("fetched_at") > asof - F.expr(f"interval {minutes} minutes")) & (F.col("fetched_at") <= asof)
    return articles.agg(F.count_if(recent).alias("n")).withColumn("active", F.col("n") > 0)


class Seen(StatefulProcessor):
    """Marks the rows (doc_id, at, us, ...) of a key that come within `days` of one before; remembers the key's last time alone, and that for so long."""

    def __init__(self, days: int, columns: list[str]):
        self.span, self.columns = days * 86_400_000_000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["us", "doc_id"])
        before = got["us"].shift(1).astype("Int64")
        if self.last.exists():
            before.iloc[0] = self.last.get()[0]
        last = int(got["us"].max())
        self.last.update((last,))
        _ring(self.handle, last + self.span)
        yield got.assign(again=(got["us"].astype("Int64") - before <= self.span).fillna(False).astype(bool))[[*self.columns, "again"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Alike(StatefulProcessor):
    """Marks the rows (doc_id, us, hi, lo) of a block of bits whose SimHash is within `bits` of one that came in the `days` before.

    Remembers each hash with its last time, for so long; texts aren't kept. Every row of a micro-batch gives one row.
    """

    def __init__(self, days: int, bits: int):
        self.span, self.bits = days * 86_400_000_000, bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "us array<long>, hi array<long>, lo array<long>")

    def _held(self) -> dict[tuple[int, int], int]:
        return {(h, l): t for t, h, l in zip(*self.memory.get(), strict=True)} if self.memory.exists() else {}  # noqa: E741

    def _keep(self, held: dict[tuple[int, int], int]) -> None:
        self.memory.update((list(held.values()), [h for h, _ in held], [l for _, l in held]))  # noqa: E741
        _ring(self.handle, min(held.values()) + self.span)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        got = pd.concat(list(rows)).sort_values(["us", "doc_id"])
        known, times = np.array(list(held) or np.zeros((0, 2)), np.int64), np.array(list(held.values()), np.int64)
        near = []
        for us, hi, lo in zip(got["us"].tolist(), got["hi"].tolist(), got["lo"].tolist(), strict=True):
            far = np.bitwise_count(known[:, 0] ^ hi) + np.bitwise_count(known[:, 1] ^ lo)
            near.append(bool(((far <= self.bits) & (us - times <= self.span)).any()))
            if (hi, lo) in held:
                times[list(held).index((hi, lo))] = us
            else:
                known, times = np.vstack([known, [[hi, lo]]]), np.append(times, us)
            held[hi, lo] = us
        newest = max(held.values())
        self._keep({k: t for k, t in held.items() if newest - t <= self.span})
        yield pd.DataFrame({"doc_id": got["doc_id"].to_numpy(), "near": near})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us = expiredTimerInfo.getExpiryTimeInMs() * 1000
        left = {k: t for k, t in self._held().items() if t + self.span >= us}
        if left:
            self._keep(left)
        else:
            self.memory.clear()
        yield from ()

    def close(self) -> None:
        pass


def near_dedup_stream(articles: DataFrame, checkpoint: str, out: str, days: int = 7, bits: int = 3, delay: str = "0 seconds") -> None:
    """Each micro-batch without the articles that are exact or near copies of earlier ones of the `days` before, under its batch id in out/kept.

    Gives what near_duplicates leaves of all articles: one is suppressed where it links it to an earlier one, suppressed or not. Two keyed states hold
    the memory: the last time of each title and domain, and of each SimHash under the twenty blocks of bits it may share with one within three bits.
    A text is hashed once, when it comes; a batch touches its own keys alone, and timers of event time forget what is older.
    articles: doc_id, headline, description, url, published_at; later rows than `delay` behind the newest are left out. A key's rows of one
    micro-batch are in one task, which the source's files a trigger bound.
    """
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    exact = F.md5(F.concat_ws("|", host, F.lower(F.trim(F.coalesce("headline", F.lit(""))))).cast("binary"))
    text = F.concat(F.coalesce("headline", F.lit("")), F.coalesce("description", F.lit("")))
    rows = articles.withWatermark("published_at", delay).select("doc_id", "published_at", F.unix_micros("published_at").alias("us"), text.alias("text"), exact.alias("exact"))
    kept = "doc_id long, published_at timestamp, us long, text string"
    columns = [c.split()[0] for c in kept.split(", ")]
    first = rows.groupBy("exact").transformWithStateInPandas(Seen(days, columns), f"{kept}, again boolean", "append", "EventTime", eventTimeColumnName="published_at")
    hashed = simhash(first.filter("not again"), "text").select("doc_id", "published_at", "us", "hi", "lo", F.explode(F.array(*block_keys())).alias("block"))
    near = hashed.select("*", "block.i", "block.k").groupBy("i", "k").transformWithStateInPandas(Alike(days, bits), "doc_id long, near boolean", "append", "EventTime")
    drain(near, checkpoint, lambda df, number: df.groupBy("doc_id").agg(F.max("near").alias("near")).filter("not near").select("doc_id").write.mode("overwrite").parquet(f"{out}/kept/batch={number}"))


def _ring(handle: StatefulProcessorHandle, *at: int) -> None:
    """The key's timers are those at these times (microseconds) and no others; a timer of milliseconds rings after its time, never before."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    for us in at:
        handle.registerTimer(us // 1000 + 1)


#: Feeds are kept in so many groups, each with one state and one timer: what a call of a processor costs is paid for many feeds at once.
GROUPS = 1024


def _grouped(rows: DataFrame, delay: str, groups: int):
    """rows (feed, ts, event_id, ...) with a watermark, by groups of feeds. A null feed is one too: its number is 0, and known is false."""
    marked = rows.withWatermark("ts", delay).withColumns({"part": F.pmod(F.xxhash64("feed"), F.lit(groups)).cast("int"), "known": F.col("feed").isNotNull(), "feed": F.coalesce("feed", F.lit(0).cast("long"))})
    return marked.groupBy("part")


def _feed_again(rows: DataFrame) -> DataFrame:
    return rows.withColumn("feed", F.when(F.col("known"), F.col("feed"))).drop("known")


class FeedStates(StatefulProcessor):
    """State by feed, held for a group of feeds as one row of arrays. A subclass says what a feed's rows do and when its state is due.

    columns: those of a feed's state, all long; read: those of a row that its step takes; out: those it emits. What is due is what a timer of the feed alone would do: the group's timer is that of the feed which is
    due first, and when it rings, all feeds whose time the watermark has passed are seen to.
    """

    columns: tuple[str, ...] = ()
    read: tuple[str, ...] = ()
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("feeds", ", ".join(["known array<boolean>", "feed array<long>", *[f"{c} array<long>" for c in self.columns]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states, out = self._load(), []
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        frame = frame.assign(us=frame["ts"].astype("datetime64[us]").astype("int64"))
        for known, feed, *row in zip(*[frame[c].tolist() for c in ("known", "feed", *self.read)], strict=True):
            states[known, feed] = self.step(states.get((known, feed)), out, (known, feed), *row)
        self._keep(states)
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        states, out = self._load(), []
        for feed in [f for f, state in states.items() if self._ring(state) <= now]:
            state = self.ended(states.pop(feed), out, feed, now * 1000)
            if state is not None:
                states[feed] = state
        self._keep(states)
        yield from self._frames(out)

    def close(self) -> None:
        pass

    def _ring(self, state: tuple) -> int:
        """The milliseconds at which a feed's timer rings: after its time, never before."""
        return self.due(state) // 1000 + 1

    def _load(self) -> dict:
        if not self.held.exists():
            return {}
        known, feed, *rest = self.held.get()
        return dict(zip(zip(known, feed, strict=True), zip(*rest, strict=True), strict=True))

    def _keep(self, states: dict) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if states:
            known, feed = zip(*states, strict=True)
            self.held.update((list(known), list(feed), *[list(c) for c in zip(*states.values(), strict=True)]))
            self.handle.registerTimer(min(map(self._ring, states.values())))
        else:
            self.held.clear()

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(out, columns=["known", "feed", *self.out])
        if "at" in self.out:
            rows = rows.assign(at=pd.to_datetime(rows["at"].astype("int64"), unit="us"))
        yield rows


class Breaker(FeedStates):
    """A feed's breaker. Emits its changes: open at `failures` in a row, half_open when the last of them is `seconds` past, closed by a success.

    The change to half open comes from a timer; where the feed's next outcome is in the same micro-batch, that outcome brings it first, so the rows
    don't depend on where batches are cut. A feed without an outcome for `forget` seconds loses its state.
    """

    STATES = ("closed", "open", "half_open")
    columns, read, out = ("consecutive", "last_failure", "seen", "state"), ("ok", "us"), ("at", "state", "consecutive")

    def __init__(self, failures: int, seconds: int, forget: int):
        self.failures, self.wait, self.forget = failures, seconds * 1_000_000, forget * 1_000_000

    def step(self, held: tuple | None, out: list, feed: tuple, ok: bool, us: int) -> tuple:
        count, last, seen, state = held or (0, None, us, 0)
        if us - seen > self.forget:
            count, last, state = 0, None, 0
        if state == 1 and us - last > self.wait:
            state = 2
            out.append((*feed, last + self.wait, "half_open", count))
        count, last = (0, None) if ok else (count + 1, us)
        new = 1 if count >= self.failures else 0
        if new != state:
            out.append((*feed, us, self.STATES[new], count))
        return count, last, max(seen, us), new

    def due(self, held: tuple) -> int:
        _, last, seen, state = held
        return min(seen + self.forget, last + self.wait) if state == 1 else seen + self.forget

    def ended(self, held: tuple, out: list, feed: tuple, us: int) -> tuple | None:
        count, last, seen, state = held
        if state == 1 and us > last + self.wait and self.wait <= self.forget:
            state = 2
            out.append((*feed, last + self.wait, "half_open", count))
        return None if us > seen + self.forget else (count, last, seen, state)


def breaker_stream(outcomes: DataFrame, failures: int = 3, seconds: int = 1800, delay: str = "0 seconds", forget: int = 90 * 86400, groups: int = GROUPS) -> DataFrame:
    """(feed, at, state, consecutive): the changes of each feed's breaker, as outcomes (feed, ts, event_id, ok) come in.

    Keyed state with timers of event time: half_open is emitted half an hour after the last failure, once the watermark is past it.
    Outcomes behind the watermark are left out. Needs the RocksDB state store, see drain.
    """
    rows = _grouped(outcomes.select("feed", "ts", "event_id", "ok"), delay, groups)
    return _feed_again(rows.transformWithStateInPandas(Breaker(failures, seconds, forget), "known boolean, feed long, at timestamp, state string, consecutive long", "append", "EventTime"))


def breakers_at(changes: DataFrame, asof: Column) -> DataFrame:
    """(feed, state, consecutive, since) at a time, of breaker_stream's changes. A feed without a change is closed and has no row."""
    order = F.struct("at", F.when(F.col("state") == "half_open", 0).otherwise(1))
    last = changes.filter(F.col("at") <= asof).groupBy("feed").agg(F.max_by(F.struct("state", "consecutive", "at"), order).alias("l"))
    return last.select("feed", "l.state", "l.consecutive", F.col("l.at").alias("since"))


class Cooldown(FeedStates):
    """Lets a feed's request through if the last one let through is `seconds` past; its state is only held until then."""

    columns, read, out = ("last",), ("us", "event_id"), ("event_id",)

    def __init__(self, seconds: int):
        self.wait = seconds * 1_000_000

    def step(self, held: tuple | None, out: list, feed: tuple, us: int, event: int) -> tuple:
        if held is not None and us // 1_000_000 - held[0] // 1_000_000 < self.wait // 1_000_000:
            return held
        out.append((*feed, event))
        return (us,)

    def due(self, held: tuple) -> int:
        return held[0] + self.wait

    def ended(self, held: tuple, out: list, feed: tuple, us: int) -> None:
        return None


def cooldown(requests: DataFrame, seconds: int, delay: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """The requests (feed, ts, event_id) that come at least `seconds` (whole ones are compared) after the last one let through of their feed.

    Keyed state that a timer clears when the cooldown is over, so it holds no more feeds than are cooling. Requests behind the
    watermark are left out. Needs the RocksDB state store, see drain.
    """
    rows = _grouped(requests.select("feed", "ts", "event_id"), delay, groups)
    return _feed_again(rows.transformWithStateInPandas(Cooldown(seconds), "known boolean, feed long, event_id long", "append", "EventTime"))
