"""Boundary rows of the rules, written by hand."""

import datetime as dt
import html
import re
import time

import pytest
from pyspark.sql import functions as F

from storyloom.functions import similarity as Z
from storyloom.functions import text as X
from storyloom.operators import articles as A
from storyloom.operators import clusters as C
from storyloom.operators import joins as J
from storyloom.operators import metrics as M
from storyloom.operators import ranking as R
from storyloom.plans import QUERIES
from storyloom.sources import io as S
from storyloom.streaming import streams as K
from tests.oracle import SF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def test_clean_text(spark):
    assert one(spark, X.clean_text(lit("<p>a &amp;  <b>b</b>\n&#8220;c&#8221;</p> "))) == "a & b “c”"
    assert one(spark, X.clean_text(lit(None).cast("string"))) == ""
    assert one(spark, X.truncate_words(lit("alpha beta gamma"), 12)) == "alpha beta..."
    assert one(spark, X.truncate_words(lit("short"), 12)) == "short"


def test_clean_entities_query(spark):
    """The registered query over all pages against the standard library."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    clean = lambda t: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", t or "")), flags=re.ASCII).strip(" ")
    got = {r["page_id"]: r["n_clean"] for r in QUERIES["p1_clean_entities"](spark, SF).collect()}
    assert got == {p["page_id"]: len(clean(p["html"])) for p in pages}
    assert any("&" in (p["html"] or "") for p in pages)


def test_article_id(spark):
    x = one(spark, X.article_id(lit("src"), lit("http://a/b"), lit("2024-03-05 10:00:00").cast("timestamp")))
    assert x.startswith("src_20240305_") and len(x) == 21


def test_categories(spark):
    cat = lambda t, d="", u="http://x/": one(spark, X.categorize(lit(t), lit(d), lit(u)))
    assert cat("Top 10 gifts for dads") == "lifestyle"
    assert cat("Match report", u="http://x/sport/1") == "sports"
    assert cat("President and parliament") == "politics"
    assert cat("Zzz") == "world"
    assert one(spark, X.normalize_category(lit(" Tech "))) == "technology"
    assert one(spark, X.normalize_category(lit(None).cast("string"))) == "world"


def test_promotional(spark):
    p = lambda t, d="", u="http://x/": one(spark, X.promotional(lit(t), lit(d), lit(u)))
    assert p("Sponsored content from X") and p("News", u="http://x/deals/1") and p("Bistro Luna", "a cozy place")
    assert not p("Senate passes bill on housing after long debate")


def test_generated_text(spark):
    assert one(spark, X.clean_summary(lit("Here's a concise summary: Facts."))) == "Facts."
    assert one(spark, X.clean_headline(lit('"Updated headline: Storm hits coast"\nRationale: new'))) in ("Updated headline: Storm hits coast", "Storm hits coast")
    assert one(spark, X.accept_headline(lit("Too short"), lit("Old headline"))) == "Old headline"
    assert one(spark, X.refusal(lit("I cannot do it"))) and not one(spark, X.refusal(lit(None).cast("string")))


def test_similarity(spark):
    v = lambda *x: F.array(*[lit(float(i)) for i in x])
    assert one(spark, Z.cosine(v(1, 0), v(1, 0))) == 1 and one(spark, Z.cosine(v(0, 0), v(1, 0))) == 0 and one(spark, Z.cosine(v(1), v(1, 0))) == 0
    assert one(spark, Z.title_similarity(lit("Storm hits Florida coast"), lit("Storm hits Florida coast"))) > 0.95
    assert one(spark, Z.title_similarity(lit(""), lit("x"))) == 0
    assert one(spark, Z.topic_conflict(lit("Police arrest man"), lit("Team wins championship game")))
    assert not one(spark, Z.topic_conflict(lit("Storm damage"), lit("Team wins game")))


def test_status(spark):
    got = A.with_status(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "source_count int")).collect()
    assert [r["status"] for r in got] == ["NEW", "DEVELOPING", "VERIFIED", "VERIFIED", "TOP_STORY"]


def test_match_thresholds(spark):
    def match(cos, title):
        a = spark.createDataFrame([(1, "Storm Floods Texas", [cos, (1 - cos * cos) ** 0.5])], "doc_id long, headline string, vector array<double>")
        s = spark.createDataFrame([(9, title, [1.0, 0.0], dt.datetime(2024, 1, 1))], "story_id long, title string, centroid array<double>, last_updated timestamp")
        return J.match_stories(a, s).count()

    assert match(0.76, "Other") == 1 and match(0.70, "Texas Other") == 0 and match(0.70, "Floods Texas") == 1 and match(0.67, "Floods Texas") == 0


def test_breaker(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([(1, i, t(i), i > 3 and False) for i in range(3)] + [(2, 10 + i, t(i), i == 1) for i in range(4)], "feed long, event_id long, ts timestamp, ok boolean")
    got = {r["feed"]: (r["consecutive"], r["state"]) for r in R.breaker_state(log, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()}
    assert got == {1: (3, "open"), 2: (2, "closed")}
    late = {r["feed"]: r["state"] for r in R.breaker_state(log, F.lit("2024-01-01 00:32:00").cast("timestamp")).collect()}
    assert late[1] == "open"  # just thirty minutes after its last failure
    late = {r["feed"]: r["state"] for r in R.breaker_state(log, F.lit("2024-01-01 00:32:01").cast("timestamp")).collect()}
    assert late[1] == "half_open"


def test_diversify_fills_up(spark):
    s = spark.createDataFrame([(i, "a" if i < 9 else "b", float(100 - i)) for i in range(10)], "story_id long, category string, score double")
    got = [r["story_id"] for r in R.diversify(s, 8).orderBy("place").collect()]
    assert got == [0, 1, 2, 9, 3, 4, 5, 6]


def test_upsert_keeps_first_fetch(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    base = spark.createDataFrame([(1, "a", d(1), d(1)), (2, "b", d(1), d(1))], "doc_id long, t string, updated_at timestamp, fetched_at timestamp")
    new = spark.createDataFrame([(1, "c", d(2), d(2))], base.schema)
    got = {r["doc_id"]: (r["t"], r["fetched_at"]) for r in S.upsert_articles(base, new).collect()}
    assert got == {1: ("c", d(1)), 2: ("b", d(1))}


def test_decay(spark):
    rows = [(1, 1, 14), (2, 1, 15), (3, 2, 21), (4, 2, 22), (5, 9, 30), (6, 9, 31)]
    s = spark.createDataFrame([(i, n, dt.datetime(2024, 3, 1) - dt.timedelta(days=x)) for i, n, x in rows], "story_id long, n_articles int, last_updated timestamp")
    got = {r["story_id"]: r["reason"] for r in C.decay(s, F.lit("2024-03-01 00:00:00").cast("timestamp")).collect()}
    assert got == {2: "single", 4: "small", 6: "old"}


def test_xml_items(spark, tmp_path):
    p = tmp_path / "feed.xml"
    p.write_text("<rss><channel><item><title>A &amp;amp; B</title><link>http://x/1</link><description><![CDATA[<p>Hi</p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title></title><link>http://x/2</link></item></channel></rss>")
    got = S.parse_feed_items(S.read_feed_xml(spark, str(p)).withColumn("source", F.lit("s")), F.lit("2024-02-02 00:00:00").cast("timestamp")).collect()
    assert [(r["title"], r["description"], str(r["published_at"])) for r in got] == [("A & B", "Hi", "2024-01-01 10:00:00")]


def simhash(text):
    """The definition, word for word."""
    import hashlib

    w = text.lower().split()
    grams = [text.lower()] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    sums = [int(hashlib.md5(g.encode()).hexdigest(), 16) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in sums) > len(sums))


def test_near_duplicates(spark):
    """Against the definition: exact copies, near copies, other texts, and copies more than a week apart."""
    import random

    rng = random.Random(4)
    words = lambda n: [rng.choice("alpha beta gamma delta storm river market vote 日本 été".split()) + str(rng.randint(0, 30)) for _ in range(n)]
    base = words(300)
    rows, t0 = [], dt.datetime(2024, 1, 1)

    def add(title, text, host="a.com", day=0.0):
        rows.append((len(rows), title, text, f"https://{host}/x/{len(rows)}", t0 + dt.timedelta(days=day)))

    for k in range(30):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(300)] = "changed"
        add("One title", " ".join(w), host=f"h{k}.com", day=k / 4)
    add("Same Title ", "x y z", day=0), add("same title", "something else", day=6), add("same title", "third", day=12.5), add("same title", "late", day=30), add("same title", "other host", host="b.com")
    for day in (0, 5, 20, 26, 27):
        add(f"t{day}", "", host="e.com", day=day)
    add("", "copy of a text", host="c.com"), add("", "copy of a text", host="d.com", day=7), add("", "copy of a text", host="f.com", day=15)
    a = spark.createDataFrame(rows, "doc_id long, headline string, description string, url string, published_at timestamp").repartition(4)
    got = {tuple(r) for r in J.near_duplicates(a).collect()}
    week, want = 7 * 86400, set()
    at = {r[0]: r[4].timestamp() for r in rows}

    def spells(keyed):
        """{doc_id: (first, since, until)} of rows of one key."""
        out = {}
        for ids in keyed.values():
            ids.sort(key=lambda i: (at[i], i))
            run = [ids[0]]
            for i in [*ids[1:], None]:
                if i is None or at[i] - at[run[-1]] > week:
                    out |= {j: (run[0], at[run[0]], at[run[-1]]) for j in run}
                    run = []
                run.append(i)
        return out

    keyed, hashed = {}, {}
    for i, h, _, u, _ in rows:
        keyed.setdefault((h.strip().lower(), u.split("/")[2]), []).append(i)
    exact = spells(keyed)
    want |= {(f, i, 0, "exact") for i, (f, _, _) in exact.items() if f != i}
    h = {r[0]: simhash(r[1] + r[2]) for r in rows if exact[r[0]][0] == r[0]}
    for i, x in h.items():
        hashed.setdefault(x, []).append(i)
    near = spells(hashed)
    want |= {(f, i, 0, "near") for i, (f, _, _) in near.items() if f != i}
    reps = [i for i, (f, _, _) in near.items() if f == i]
    for i in reps:
        for j in reps:
            if (near[i][1], i) < (near[j][1], j) and 0 < (h[i] ^ h[j]).bit_count() <= 3 and near[j][1] - near[i][2] <= week:
                want.add((i, j, (h[i] ^ h[j]).bit_count(), "near"))
    assert got == want
    assert {k for *_, k in want} == {"exact", "near"} and any(x[2] for x in want) and (30, 31, 0, "exact") in want and not any(33 in x[:2] for x in want)


def _stream(spark, folder, rows, schema, slices, make):
    """What make of a stream over slices of rows writes, one file a slice and batch: (batch, ...) rows."""
    out = f"{folder}/out"
    for k, part in enumerate(slices):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)  # files are read in order of their times
    stream = make(S.article_changes(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema))
    K.drain(stream, f"{folder}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(out)


_MINUTES = [(1, 0, False), (1, 1, False), (2, 1, False), (1, 2, False), (2, 3, True), (1, 40, False), (2, 41, False), (1, 45, True), (2, 50, False), (2, 51, False), (3, 52, True), (3, 90, True), (4, 91, False)]


@pytest.mark.parametrize("cuts", [[13], [3, 6, 9, 13], list(range(1, 14))])
def test_breaker_stream(spark, tmp_path, cuts):
    """Changes by hand, wherever batches are cut: three failures open, a timer half opens after thirty minutes, a failure opens again, a success closes."""
    rows = [(f, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), ok) for i, (f, m, ok) in enumerate(_MINUTES)]
    slices = [range(a, b) for a, b in zip([0, *cuts], cuts)]
    got = _stream(spark, str(tmp_path), rows, "feed long, event_id long, ts timestamp, ok boolean", slices, K.breaker_stream)
    at = lambda r: int((r["at"] - dt.datetime(2024, 1, 1)).total_seconds() // 60)
    assert sorted((r["feed"], at(r), r["state"], r["consecutive"]) for r in got.collect()) == [(1, 2, "open", 3), (1, 32, "half_open", 3), (1, 40, "open", 4), (1, 45, "closed", 0), (2, 51, "open", 3), (2, 81, "half_open", 3)]
    state = lambda m: {r["feed"]: r["state"] for r in K.breakers_at(got, F.lit(f"2024-01-01 {m}").cast("timestamp")).collect()}
    assert state("00:31:59") == {1: "open"} and state("00:32:00") == {1: "half_open"} and state("00:40:00") == {1: "open"} and state("01:30:00") == {1: "closed", 2: "half_open"}


def test_breaker_forgets_silent_feeds(spark, tmp_path):
    """Two failures, an hour of silence in which the state expires by its timer, one more failure: no three in a row."""
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, 0, t(0), False), (1, 1, t(1), False), (2, 2, t(70), True), (1, 3, t(71), False)]
    run = lambda name, forget: [r["state"] for r in _stream(spark, str(tmp_path / name), rows, "feed long, event_id long, ts timestamp, ok boolean", [[0, 1], [2], [3]], lambda df: K.breaker_stream(df, forget=forget)).collect()]
    assert run("a", 3600) == [] and run("b", 7200) == ["open"]


@pytest.mark.parametrize("cuts", [[7], [2, 4, 7], list(range(1, 8))])
def test_cooldown_stream(spark, tmp_path, cuts):
    rows = [(f, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=m)) for i, (f, m) in enumerate([(1, 0), (2, 100), (1, 299), (1, 300), (1, 301), (2, 500), (1, 1000)])]
    got = _stream(spark, str(tmp_path), rows, "feed long, event_id long, ts timestamp", [range(a, b) for a, b in zip([0, *cuts], cuts)], lambda df: K.cooldown(df, 300))
    assert sorted(r["event_id"] for r in got.collect()) == [0, 1, 3, 5, 6]


def test_simhash_by_row_is_simhash_by_group(spark):
    texts = [None, "", "One two", "a b c d e f g", "Fire in the old mill, police say; nobody was hurt in it " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: (r["hi"], r["lo"]) for r in J.with_simhash(df, F.col("text")).collect()}
    assert {r["doc_id"]: (r["hi"], r["lo"]) for r in J.simhash(df, "text").collect()} == by and len(set(by.values())) == 4


def test_near_dedup_stream_forgets(spark, tmp_path):
    """A copy within the week before goes, exact or near; one eight days later stays; suppressed articles are remembered, too."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    long = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day in may " * 3
    rows = [
        (1, "Title", long, "http://a.x/1", day(0)), (2, "title ", "other words here", "http://a.x/2", day(1)), (3, "Else", "no such thing at all", "http://a.x/3", day(2)),
        (4, "Title", long, "http://b.x/4", day(6)), (5, "Title", long, "http://c.x/5", day(12)), (6, "TITLE", "again", "http://a.x/6", day(9)), (7, "Title", long, "http://d.x/7", day(20)),
    ]
    schema = "doc_id long, headline string, description string, url string, published_at timestamp"
    for part in ([0], [1, 2], [3], [5], [4, 6]):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    K.near_dedup_stream(S.article_changes(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "state"), str(tmp_path / "out"))
    # 2: title and domain of 1; 4: text of 1; 5: text of 4, which was suppressed itself; 6: eight days after 2; 7: eight days after 5
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out/kept")).collect()) == [1, 3, 6, 7]


def test_stories_start_and_articles_are_marked(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "h", "us", "s", 1, t, False, None), (2, "h", "us", "s", 2, t, False, None), (3, "h", "us", "s", None, t, True, 9)], "doc_id long, headline string, category string, source string, tier int, published_at timestamp, processed boolean, story_id long")
    got = {r["story_id"]: (r["importance"], r["confidence"], r["breaking"], r["status"], r["verification_level"]) for r in C.new_stories(a).collect()}
    assert got == {-2: (70, 40, True, "NEW", 1), -3: (50, 40, False, "NEW", 1), -4: (50, 40, False, "NEW", 1)}
    marked = C.mark_processed(a, spark.createDataFrame([(1, 77)], "doc_id long, story_id long"))
    assert sorted((r["doc_id"], r["processed"], r["story_id"]) for r in marked.collect()) == [(1, True, 77), (2, False, None), (3, True, 9)]


def test_hard_negatives(spark):
    """Random pairs of different stories that look alike by titles or by entities, as many as asked for at any size."""
    e = lambda *x: [(i, "ORGANIZATION") for i in x]
    rows = [(i, i // 2, "alpha beta common" if i % 2 else "gamma delta common", e("Same")) for i in range(200)]
    schema = "doc_id long, story_id long, headline string, entities array<struct<text:string,type:string>>"
    got = J.hard_negatives(spark.createDataFrame(rows, schema), 50).collect()
    assert len(got) == 50 and all(r["jaccard"] == 0.2 and (r["a"] + r["b"]) % 2 and r["a"] // 2 != r["b"] // 2 for r in got)
    rows = [(i, i, f"title{i} only{i}", e("A", "B", "C") if i % 2 else e("B", "C", "D")) for i in range(100)]
    got = J.hard_negatives(spark.createDataFrame(rows, schema), 30).collect()
    assert len(got) == 30 and all(r["jaccard"] == 0 and r["entities"] == 0.5 and (r["a"] + r["b"]) % 2 for r in got)
    assert J.hard_negatives(spark.createDataFrame([], schema), 30).count() == 0


def test_random_pairs_grow_with_attempts_alone(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = J.random_pairs(df, 1000).count()
    assert 700 < n < 1300
    assert 4000 < J.random_pairs(df.limit(100), 10_000).count() <= 4950


def test_random_pairs_of_very_many_rows(spark):
    """The share of rows that is drawn holds beyond the range of whole numbers: 3 of 100 stand for 3e9 of 1e11 rows."""
    n = spark.range(100_000).filter(J.drawn_share(F.col("id"), 3e9 / 1e11, 42)).count()
    assert 2_700 < n < 3_300


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_hard_negatives_are_there_at_every_size(spark, d):
    from storyloom.plans import QUERIES

    assert QUERIES["j7_hard_negatives"](spark, d).count() == 300


def test_positive_pairs(spark):
    """All pairs where fewer than n are to be had, whatever the story's size; rows that repeat or lack a key make none."""
    sizes = {1: 2, 2: 1, 3: 20, 4: 50}
    rows = [(s, 100 * s + i) for s, m in sizes.items() for i in range(m)]
    m = spark.createDataFrame([*rows, *rows[:30], (None, 7), (3, None)], "story_id long, doc_id long")
    got = [(r["a"], r["b"]) for r in J.positive_pairs(m, 10_000).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for s, a in rows for t, b in rows if s == t and a < b}
    few = [(r["a"], r["b"]) for r in J.positive_pairs(m, 40).collect()]
    assert len(few) == len(set(few)) == 40 and set(few) <= set(got)
    assert J.positive_pairs(m.limit(0), 5).count() == 0


def test_positive_pairs_of_one_large_story(spark):
    """n of two hundred million pairs, without making them; all of the story's parts give some."""
    m = spark.range(20_000).select(F.lit(1).alias("story_id"), F.col("id").alias("doc_id"))
    got = [(r["a"], r["b"]) for r in J.positive_pairs(m, 300).collect()]
    assert len(set(got)) == 300 and all(a < b for a, b in got) and len({x // 2000 for p in got for x in p}) == 10


def test_pair_scores(spark):
    """Rows worked out by hand."""
    t = dt.datetime(2024, 1, 1)
    ent = "array<struct<text:string,type:string>>"
    rows = [
        (1, "Storm hits Texas", "a b", "bbc.com", "world", t, [("Storm", "ORGANIZATION"), ("Texas", "LOCATION"), ("Ann", "PERSON")], [7, 8]),
        (2, "Storm leaves Texas", "a b c", "bbc.co.uk", "world", t + dt.timedelta(hours=10), [("storm", "ORGANIZATION"), ("Ohio", "LOCATION"), ("Ann", "PERSON")], [8]),
        (3, "Storm", None, "x", None, None, [], []),
    ]
    a = spark.createDataFrame(rows, f"doc_id long, headline string, description string, source string, category string, published_at timestamp, entities {ent}, qids array<int>")
    a = a.withColumn("signature", X.event_signature(F.col("headline"), F.col("description"), F.col("entities")))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id long, embedding array<float>")
    p = spark.createDataFrame([(1, 2, 1), (1, 3, 0)], "a long, b long, label int")
    got = {(r["a"], r["b"]): r for r in J.pair_features(p, a, v).collect()}
    x = got[1, 2]  # the signatures' hashes hold two entities each, and these are the same
    assert [round(x[c], 4) for c in J.FEATURES] == [0.6, round(4 / 7, 4), 0.5, 1.0, 1.0, 0.0, 0.5, round(2.718281828 ** -0.1, 4), 0.25, 1.0, 1.0, 0.0, 0.5, round(20 / 24, 4), 0.5]
    y = got[1, 3]
    assert y["temporal_proximity"] == 0.5 and y["entity_overlap_jaccard"] == 0 and y["embedding_similarity"] == 0 and y["category_match"] == 0
    score = 0.4 * 0.6 + 0.2 * 0.5 + 0.15 * 2.718281828 ** -0.1 + 0.1 + 0.05 * 0.5
    assert abs(J.rule_score(J.pair_features(p, a, v)).filter("b = 2").first()["score"] - score) < 1e-5
    f = spark.createDataFrame([(1, 9, 0.8, 0.5, 0.25, 36.0, True, False), (1, 8, 0.8, 0.5, 0.25, 36.0, False, True)], "doc_id long, story_id long, cosine double, entities double, title double, hours double, same_place boolean, breaking boolean")
    got = {r["story_id"]: r["score"] for r in J.multi_factor_score(f).collect()}
    assert abs(got[9] - (0.44 + 0.1 + 0.025 + 0.1 * 2.718281828 ** -0.25 + 0.05)) < 1e-5 and abs(got[8] - (0.565 + 0.1 * 2.718281828 ** -2.25)) < 1e-5


def test_assignment_thresholds(spark):
    """Alone, only the threshold counts; among others, standing out two deviations is enough."""
    rows = [(1, 1, 0.61, 11.0), (2, 1, 0.62, 11.0), (3, 1, 0.58, 12.0), (4, 1, 0.57, 71.0), (5, 1, 0.52, 72.0), *[(6, i, 0.1, 1.0) for i in range(9)], (6, 50, 0.4, 1.0), (7, 1, 0.5, 1.0), (7, 2, 0.5, 1.0)]
    got = J.assign_clusters(spark.createDataFrame(rows, "doc_id long, story_id long, score double, age_hours double"))
    assert {(r["doc_id"], r["story_id"]) for r in got.collect()} == {(2, 1), (3, 1), (5, 1), (6, 50), (7, 1)}


def test_entity_links(spark):
    kb = [(1, "Japan", ["Nippon"], 200, "country", "country in Asia"), (2, "Japan", ["Japan Inc"], 10, "company", "record company"), (3, "Paris", [], 50, "city", "capital of France"), (4, "Paris", ["Paris"], 0, "entity", "")]
    k = spark.createDataFrame(kb, "qid long, label string, aliases array<string>, sitelinks int, type string, description string")
    m = spark.createDataFrame([(1, "Japan", "LOCATION", "storm in Japan, a country"), (2, "Japan", "ORGANIZATION", "x"), (3, "Paris", "PERSON", "y"), (4, "Ohio", "LOCATION", "")], "doc_id long, mention string, type string, context string")
    got = {(r["doc_id"], r["mention"]): (r["qid"], r["score"]) for r in J.link_entities(m, k).collect()}
    # .3 + .4 + .2 + .2 * (.5 * 2 / 3 + .3 + .2); for the company .03 + .4 + .15 + .2; for Paris .3 * .5 + .4 falls short, and the other has .4 + .3 + .1
    assert got == {(1, "Japan"): (1, 1.066667), (2, "Japan"): (2, 0.78), (3, "Paris"): (4, 0.8)}


def test_labels_of_metrics(spark):
    """Each threshold from both sides."""
    from storyloom.operators import metrics as M

    t = F.lit("2024-01-02 00:00:00").cast("timestamp")
    now = dt.datetime(2024, 1, 2)

    def lag(*seconds):
        a = spark.createDataFrame([(False, now - dt.timedelta(seconds=x)) for x in seconds] + [(True, now)], "processed boolean, fetched_at timestamp")
        return M.processing_lag(a, t).first()["label"]

    assert [lag(), lag(59), lag(60, 5), lag(299), lag(300)] == ["none", "minimal", "moderate", "moderate", "high"]

    def feeds(multi, of, sources, n):
        s = spark.createDataFrame([(2 if i < multi else 1,) for i in range(of)], "source_count int")
        return M.feed_quality(s, spark.createDataFrame([(f"s{i}",) for i in range(sources)], "source string"), spark.range(n)).first()["label"]

    assert [feeds(71, 100, 51, 100), feeds(70, 100, 99, 100), feeds(71, 100, 31, 100), feeds(51, 100, 30, 100), feeds(31, 100, 0 + 1, 100), feeds(30, 100, 99, 100)] == ["Excellent", "Good", "Good", "Fair", "Fair", "Needs Improvement"]

    def repeats(bad, of):
        rows = [(i, "a") for i in range(of)] + [(i, "a" if i < bad else "b") for i in range(of)] + [(1000, "a")]
        return M.duplicate_sources(spark.createDataFrame(rows, "story_id long, source string")).first()["label"]

    assert [repeats(5, 100), repeats(6, 100), repeats(10, 100), repeats(11, 100)] == ["working", "partial", "partial", "failing"]
    pairs = [(1, 1, "Storm hits Texas coast"), (1, 2, "Storm hits Texas coast"), (2, 3, "Storm hits Texas coast"), (2, 4, "Vote on budget"), (3, 5, "x")]
    got = {r["story_id"]: r["label"] for r in M.accuracy_sample(spark.createDataFrame(pairs, "story_id long, doc_id long, headline string"), 10).collect()}
    assert got == {1: "good", 2: "poor"}
    view = A.client_view(spark.createDataFrame([(1, "t", "Tech", 3, None, False, 57), (2, "t", "x", 30, "s", True, 57)], "story_id long, title string, category string, source_count int, summary string, breaking boolean, importance int"))
    assert {r["story_id"]: (r["trending"], r["credibility"], r["status"]) for r in view.collect()} == {1: (5.7, 0.3, "VERIFIED"), 2: (0.9, 1.0, "TOP_STORY")}


def test_ranked_entities(spark):
    """In the title 1, half of the earliness out of 5000 characters, .3 of a confidence of .5, and of .6 for capitals."""
    df = spark.createDataFrame([("NASA found Ice", "at the Moon", [("Moon", "LOCATION"), ("NASA", "ORGANIZATION")])], "headline string, description string, entities array<struct<text:string,type:string>>")
    got = [(r["text"], r["salience"]) for r in A.rank_entities(df).first()["ranked"]]
    assert got == [("NASA", round(1 + 0.5 + 0.18, 6)), ("Moon", round(0.5 * (1 - 22 / 5000) + 0.15, 6))]


def test_signature_entities_by_priority(spark):
    found = spark.createDataFrame([([("A", "LOCATION"), ("B", "EVENT"), ("C", "PERSON"), ("D", "ORGANIZATION"), ("E", "OTHER"), ("F", "PERSON"), ("G", "LOCATION")],)], "e array<struct<text:string,type:string>>")
    r = found.select(X.event_signature(F.lit("Police arrested a man"), F.lit("as storm struck, killed two"), F.col("e")).alias("s")).first()["s"]
    assert [(x["text"], x["priority"]) for x in r["entities"]] == [("C", 3), ("F", 3), ("A", 2), ("D", 2), ("G", 2)]
    assert [(x["verb"], x["context"], x["position"]) for x in r["actions"]] == [("arrested", "police arrested a man", 1), ("struck", "as storm struck killed two", 6), ("killed", "storm struck killed two", 7)]


def test_venue_urls(spark):
    p = lambda t, u: one(spark, X.promotional(lit(t), lit(""), lit(u)))
    assert p("Luna Verde", "http://x/eating-out/1") and not p("Luna Verde Fire", "http://x/eating-out/1") and not p("Luna Verde", "http://x/news/1")


def test_merge_gates(spark):
    """A pair that passes, and one that fails at each gate."""
    t0 = dt.datetime(2024, 1, 1)
    sig = "struct<actions:array<struct<verb:string>>,event_types:array<string>,entities:array<struct<text:string,type:string,priority:int>>>"
    good = ([("struck",)], ["war"], [("A", "PERSON", 3)])
    other = ([("won",)], ["war"], [("A", "PERSON", 3)])

    def rows(i, category="c", n=2, start=0.0, hours=24.0, names=("a", "b", "c"), places=("p",), s=good):
        return (i, category, n, t0 + dt.timedelta(hours=start), t0 + dt.timedelta(hours=start + hours), list(names), list(places), s)

    made = [rows(1), rows(2, start=12.0), rows(3, category="d"), rows(4, n=1), rows(5, start=12.5), rows(6, names=("a", "b", "x", "y")), rows(7, places=("q",)), rows(8, s=other), rows(9, hours=49.0), rows(10, places=())]
    df = spark.createDataFrame(made, f"story_id long, category string, n_articles int, first_seen timestamp, last_updated timestamp, names array<string>, places array<string>, signature {sig}")
    got = {(r["a"], r["b"]) for r in C.merge_candidates(df, F.lit("2024-01-09 00:00:00").cast("timestamp")).collect()}
    assert (1, 2) in got and not any({3, 4, 6, 7, 8, 10} & set(x) for x in got) and (1, 5) not in got and (1, 9) not in got
    late = C.merge_candidates(df, F.lit("2024-01-10 12:00:00").cast("timestamp"))
    assert (1, 2) not in {(r["a"], r["b"]) for r in late.collect()}


def test_cluster_stream_goes_on_from_earlier_batches(spark, tmp_path):
    """Three batches: a source counts once a story over all of them, and a story of an earlier batch is found, by its new centroid."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [  # batch, doc_id, source, vector
        (0, 1, "a", [1.0, 0.0, 0.0]), (0, 2, "b", [0.0, 1.0, 0.0]),
        (1, 3, "a", [1.0, 0.0, 0.0]), (1, 4, "c", [0.0, 1.0, 0.0]), (1, 5, "c", [0.8, 0.6, 0.0]),
        (2, 6, "c", [0.0, 1.0, 0.0]), (2, 7, "d", [0.6, 0.8, 0.0]), (2, 8, "b", [0.0, 0.0, 1.0]),
    ]
    at = lambda i: t0 + dt.timedelta(minutes=i)
    a = spark.createDataFrame([(i, s, 1, at(i), f"title {i}", False, b) for b, i, s, _ in rows], "doc_id long, source string, tier int, published_at timestamp, headline string, processed boolean, b int")
    v = spark.createDataFrame([(i, x) for _, i, _, x in rows] + [(100, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    stories = spark.createDataFrame([(50, "old", [1.0, 0.0, 0.0], t0)], "story_id long, title string, centroid array<double>, last_updated timestamp")
    members = spark.createDataFrame([(50, 100, "z", 1, t0)], "story_id long, doc_id long, source string, tier int, published_at timestamp")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in range(3):
        a.filter(F.col("b") == b).coalesce(1).write.mode("append").parquet(path)
    K.cluster_stream(S.article_changes(spark, path, a.schema), str(tmp_path / "state"), stories, members, v, F.lit("2024-01-02").cast("timestamp"), out, 0.7, 0.7)
    got = {(r["batch"], r["doc_id"], r["story_id"], r["created"]) for r in spark.read.parquet(f"{out}/members").collect()}
    # 3: its source is in; 6: likewise in the story of 2; 7: (.6, .8) is nearer to that story than to the old one
    assert got == {(0, 1, 50, False), (0, 2, -3, True), (1, 4, -3, False), (1, 5, 50, False), (2, 7, -3, False), (2, 8, -9, True)}
    last = {r["story_id"]: r for r in spark.read.parquet(f"{out}/stories").filter("batch = 1").collect()}
    assert last[50]["source_count"] == 3 and last[50]["last_updated"] == at(5) and 0.9 < last[50]["centroid"][0] < 1
    # Every article that was looked at has its story, also where that had its source.
    assert {(r["doc_id"], r["story_id"]) for r in spark.read.parquet(f"{out}/processed").collect()} == {(1, 50), (2, -3), (3, 50), (4, -3), (5, 50), (6, -3), (7, -3), (8, -9)}
    end = {r["story_id"]: (r["source_count"], r["status"], r["breaking"], r["importance"], r["confidence"]) for r in K.stories_at(spark, out).collect()}
    assert end == {50: (3, "VERIFIED", True, None, None), -3: (3, "VERIFIED", True, 70, 40), -9: (1, "NEW", True, 70, 40)}
    assert {r["story_id"] for r in K.stories_at(spark, out, 0).collect()} == {50, -3}


def test_cluster_stream_state_is_bounded(spark, tmp_path):
    """Six batches of new stories with a bound of three: the state has three rows after each, and batch n needs no folder before n - 1."""
    t0 = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(i, f"s{i}", 2, t0 + dt.timedelta(minutes=i), f"title {i}", False) for i in range(12)], "doc_id long, source string, tier int, published_at timestamp, headline string, processed boolean")
    v = spark.createDataFrame([(i, [float(k == i) for k in range(12)]) for i in range(12)], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([], "story_id long, title string, centroid array<double>, last_updated timestamp")
    members = spark.createDataFrame([], "story_id long, doc_id long, source string, tier int, published_at timestamp")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in range(6):
        a.filter(F.col("doc_id").between(2 * b, 2 * b + 1)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    K.cluster_stream(S.article_changes(spark, path, a.schema), str(tmp_path / "state"), none, members, v, F.lit("2024-01-02").cast("timestamp"), out, recent=3)
    live = {}
    for r in spark.read.parquet(f"{out}/live").collect():
        live.setdefault(r["batch"], set()).add(r["story_id"])
    assert live == {0: {-1, -2}, **{b: {-2 * b - 2, -2 * b - 1, -2 * b} for b in range(1, 6)}}


def test_cluster_stream_query_is_the_batch_form_slice_by_slice(spark, tmp_path):
    from storyloom.operators.joins import match_stories
    from storyloom.plans import QUERIES, state_queries
    from storyloom.plans import views as V

    d = "/root/testdata/sf0.001"
    got = sorted((r["doc_id"], r["story_id"], r["created"]) for r in QUERIES["k1_cluster_stream"](spark, d).collect())
    a, v = V.articles(spark, d), V.vectors(spark, d)
    lo, hi = a.agg(F.min("published_at"), F.max("published_at")).first()
    ids = [[r["doc_id"] for r in a.collect() if int((r["published_at"] - lo).total_seconds()) * 4 // int((hi - lo).total_seconds() + 1) == i] for i in range(4)]
    assert all(ids)
    vec = {r["vec_id"]: r["embedding"] for r in v.collect()}
    about = {r["doc_id"]: r for r in a.collect()}
    base = {r["story_id"]: [r["title"], r["centroid"], r["last_updated"]] for r in state_queries._vector_stories(spark, d).collect()}
    own = {}
    for r in v.collect():
        own.setdefault(r["story_id"], set()).add(r["vec_id"])
    sources = {s: {about[i]["source"] for i in m if i in about and about[i]["processed"]} for s, m in own.items()}
    want = []
    for batch in ids:
        stories = spark.createDataFrame([(int(s), *x) for s, x in base.items()], "story_id long, title string, centroid array<double>, last_updated timestamp")
        have = spark.createDataFrame([(int(s), x) for s, xs in sources.items() for x in xs], "story_id long, source string")
        part = a.filter(F.col("doc_id").isin(batch))
        rows = part.join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
        new = [(r["doc_id"], r["story_id"], r["created"]) for r in C.assign_batch(part, match_stories(rows, stories, 0.3, 0.3), have, V.asof()).collect()]
        for i, s, created in new:
            own.setdefault(s, set()).add(i)
            sources.setdefault(s, set()).add(about[i]["source"])
            if created:
                base[s] = [about[i]["headline"], None, about[i]["published_at"]]
            base[s][2] = max(base[s][2], about[i]["published_at"])
        for s in {s for _, s, _ in new}:
            m = [sum(float(vec[i][k]) for i in own[s]) / len(own[s]) for k in range(64)]
            n = sum(x * x for x in m) ** 0.5
            base[s][1] = [x / n for x in m]
        want += new
    assert got == sorted(want)
    taken = [(s, about[i]["source"]) for i, s, created in got if not created]
    assert len(taken) == len(set(taken))


def test_split_by_vectors_keeps_the_largest_stories(spark):
    """A story of 10,500 members in three clouds keeps all of them, each with its nearest mean; fits by rows end where a plain fit ends."""
    import numpy as np

    rng = np.random.default_rng(1)
    mid = np.eye(4)[:3] * 10

    def story(s, n):
        return [(s, s * 100_000 + i, (mid[i % 3] + rng.normal(0, 0.5, 4)).astype("float32").tolist()) for i in range(n)]

    rows = story(1, 10_500) + story(2, 1_500) + story(3, 60) + story(4, 9)
    vec = {i: (s, np.array(x)) for s, i, x in rows}
    m = spark.createDataFrame(rows, "story_id long, doc_id long, embedding array<float>").repartition(8)
    got = {r["doc_id"]: (r["story_id"], r["part"]) for r in C.split_by_vectors(m).collect()}
    assert set(got) == {i for s, i, _ in rows if s != 4}
    for s in (1, 2, 3):
        mine = [i for i, (t, _) in got.items() if t == s]
        mean = {p: np.mean([vec[i][1] for i in mine if got[i][1] == p], axis=0) for p in {got[i][1] for i in mine}}
        assert all(got[i][1] == min(mean, key=lambda p: ((vec[i][1] - mean[p]) ** 2).sum()) for i in mine)


def test_two_clouds_are_apart(spark):
    """The simplified silhouette against plain numbers: two clouds far apart are due to be split, one cloud and a young or small story are not."""
    import numpy as np

    rng = np.random.default_rng(2)
    t0 = dt.datetime(2024, 1, 1)

    def story(s, n, gap, days):
        return [(s, s * 1000 + i, t0 + dt.timedelta(days=days * i / (n - 1)), (rng.normal(0, 0.3, 4) + (gap if i % 2 else 0)).astype("float32").tolist()) for i in range(n)]

    rows = story(1, 40, 3.0, 5) + story(2, 40, 0.0, 5) + story(3, 40, 3.0, 2) + story(4, 9, 3.0, 5) + [(5, 5000 + i, t0 + dt.timedelta(days=i), [1.0, 1.0, 0.0, 0.0]) for i in range(12)] + [(6, 6000, t0, None)]
    m = spark.createDataFrame(rows, "story_id long, doc_id long, published_at timestamp, embedding array<float>").repartition(4)
    got = {r["story_id"]: (r["silhouette"], r["n"]) for r in C.separation(m).collect()}
    assert set(got) == {1, 2, 3, 5} and got[5] == (0.0, 12)
    for s in (1, 3):
        x = np.array([v for k, _, _, v in rows if k == s], "float64")
        mean = [x[::2].mean(axis=0), x[1::2].mean(axis=0)]
        d = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in mean], axis=1)
        own, other = d.min(axis=1), d.max(axis=1)
        assert abs(got[s][0] - ((other - own) / other).mean()) < 1e-5 and got[s][0] > 0.6
    assert got[2][0] < 0.6
    assert [r["story_id"] for r in C.split_due(m).collect()] == [1]


def test_split_parts_do_not_hang_on_the_size_of_a_task(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(s, 100 * s + i, (np.eye(3)[i % 3] * 5 + rng.normal(0, 0.2, 3)).astype("float32").tolist()) for s in (1, 2) for i in range(60)]
    m = spark.createDataFrame(rows, "story_id long, doc_id long, embedding array<float>")
    one = sorted(tuple(r) for r in C.split_by_vectors(m).collect())
    monkeypatch.setattr(C, "STORY_ROWS", 7)
    assert sorted(tuple(r) for r in C.split_by_vectors(m).collect()) == one and len(one) == 120


def test_changed_rows_by_twenty(spark, tmp_path):
    """95 rows in three files are five batches; a query that fails in the middle of a file goes on at the row."""
    from storyloom.sources import rows as CR

    folder = f"file://{tmp_path}/in"
    for a, b in ((0, 50), (50, 57), (57, 95)):
        spark.range(a, b).coalesce(1).select("id", F.timestamp_seconds("id").alias("t"), F.array("id").alias("x")).write.mode("append").parquet(folder)
        time.sleep(0.05)
    schema = spark.read.parquet(folder).schema
    seen, fail = {}, [True]

    def each(batch, number):
        if number == 2 and fail.pop():
            fail.append(False)
            raise RuntimeError("lost")
        seen[number] = [r["id"] for r in batch.collect() if r["t"] == dt.datetime(1970, 1, 1) + dt.timedelta(seconds=r["id"]) and r["x"] == [r["id"]]]

    with pytest.raises(Exception, match="lost"):
        CR.drain_rows(CR.row_changes(spark, folder, schema), str(tmp_path / "state"), each)
    assert sorted(seen) == [0, 1]
    fail[:] = [False]
    CR.drain_rows(CR.row_changes(spark, folder, schema), str(tmp_path / "state"), each)
    assert [seen[n] for n in sorted(seen)] == [list(range(20 * k, min(20 * k + 20, 95))) for k in range(5)]


def test_changed_rows_are_decoded_once(tmp_path, monkeypatch):
    """Triggers go on where the last one ended; a reader that starts anew passes over whole row groups; lanes share the files out."""
    import pickle

    import pyarrow as pa
    import pyarrow.parquet as pq

    from storyloom.sources.rows import ChangedRows

    decoded, real = [], pq.ParquetFile.iter_batches

    def counted(self, *a, **k):
        for batch in real(self, *a, **k):
            decoded.append(batch.num_rows)
            yield batch

    monkeypatch.setattr(pq.ParquetFile, "iter_batches", counted)
    for i, n in enumerate((6000, 0, 4100)):
        pq.write_table(pa.table({"id": pa.array(range(10_000 * i, 10_000 * i + n), pa.int64())}), tmp_path / f"part-0000{i}-x.parquet", row_group_size=2000)
        time.sleep(0.02)
    every = [(i,) for i in [*range(6000), *range(20_000, 24_100)]]

    def through(reader, at):
        places, out = [at], []
        while True:
            rows, at = reader.read(at)
            rows = list(rows)
            if not rows:
                assert reader.read(at)[1] == at
                return places, out
            out += rows
            places.append(at)
            assert len(rows) <= reader.rows

    reader = ChangedRows(f"file://{tmp_path}", 300, ["id"])
    places, out = through(reader, reader.initialOffset())
    assert out == every and len(places) == 1 + 34 and sum(decoded) == len(every)
    decoded.clear()
    again = pickle.loads(pickle.dumps(reader))
    assert through(again, places[15])[1] == every[4500:] and sum(decoded) == 2000 + 4100
    for a, b in ((0, 3), (15, 16), (18, 25), (34, 34)):
        assert list(reader.readBetweenOffsets(places[a], places[b])) == every[300 * a : 300 * b]
    lanes = [through(r, r.initialOffset())[1] for r in (ChangedRows(f"file://{tmp_path}", 300, ["id"], k, 2) for k in range(2))]
    assert lanes == [every, []] and through(ChangedRows(f"file://{tmp_path}", 7, ["id"], 2, 3), reader.initialOffset())[1] == every[6000:]


def test_lanes_of_changed_rows(spark, tmp_path):
    """Three lanes run side by side, each in its files' order; together they give every row once."""
    from storyloom.sources import rows as CR

    folder, seen = f"file://{tmp_path}/in", {}
    spark.range(0, 100, numPartitions=3).write.parquet(folder)
    streams = [CR.row_changes(spark, folder, spark.read.parquet(folder).schema, 10, k, 3) for k in range(3)]
    for _ in range(2):  # the second time there is nothing new
        CR.drain_lanes(streams, lambda k: str(tmp_path / f"state{k}"), lambda df, k, n: seen.setdefault((k, n), [r["id"] for r in df.collect()]))
    assert [i for key in sorted(seen) for i in seen[key]] == list(range(100)) and max(map(len, seen.values())) == 10 and {k for k, _ in seen} == {0, 1, 2}


@pytest.mark.parametrize("forest", [True, False])
def test_stored_scorer(spark, tmp_path, forest):
    """What is loaded scores as what was saved, and by hand: pairs with a title overlap are alike, so that feature weighs most."""
    rows = [(i, i + 1000, int(i % 2)) for i in range(200)]
    f = spark.createDataFrame(rows, "a long, b long, label int").select("a", "b", "label", *[(F.col("label") * 0.8 + (F.col("a") % 7) / 100 if n == "title_overlap" else (F.col("a") * 7 % 13) / 13.0).alias(n) for n in J.FEATURES])
    model, rest = J.train_scorer(f, trees=5, depth=3, forest=forest)
    J.save_scorer(model, f"file://{tmp_path}/m")
    again = J.load_scorer(f"file://{tmp_path}/m")
    score = lambda m: sorted((r["a"], r["b"], r["score"]) for r in J.score_pairs(m, rest).collect())
    assert score(model) == score(again) and len(score(model)) > 20
    assert all((s > 0.5) == bool(a % 2) for a, _, s in score(again))
    weights = {r["feature"]: r["importance"] for r in J.importances(again, spark).collect()}
    assert max(weights, key=weights.get) == "title_overlap"
    c = spark.createDataFrame([(1, 1001), (1, 1003), (1, 1)], "query_id long, doc_id long")
    scored = spark.createDataFrame([(1, 1001, 0.7), (1, 1003, 0.69), (1, 1, 1.0)], "query_id long, doc_id long, score double")
    assert [tuple(r) for r in J.similar_articles(c, None, 0.7, 10, scored).collect()] == [(1, 1001, 0.7, 1)]


def test_batches_are_tracked(spark):
    """Retrieved with an error: failed; ended: completed, with errored, expired and unknown results counted as errors; running: as it was."""
    maps = "story_categories map<long,string>, story_counts map<long,int>"
    t = spark.createDataFrame([("a", "submitted", {1: "us"}, {1: 3}), ("b", "in_progress", {}, {}), ("c", "submitted", {}, {}), ("d", "completed", {}, {}), ("e", "submitted", {}, {}), ("f", "submitted", None, None)], f"batch_id string, status string, {maps}")
    b = spark.createDataFrame([("a", "ended", None), ("b", "in_progress", None), ("c", "ended", "gone"), ("d", "ended", None), ("f", "ended", None)], "batch_id string, processing string, error string")
    r = spark.createDataFrame([("a", 1, "succeeded", " Fine words here "), ("a", 2, "errored", None), ("a", 3, "expired", None), ("a", 4, None, None), ("b", 5, "succeeded", "x"), ("c", 6, "succeeded", "y")], "batch_id string, story_id long, type string, text string")
    asof = F.lit("2024-01-02").cast("timestamp")
    got = {x["batch_id"]: (x["status"], x["ended_at"], x["succeeded_count"], x["errored_count"], x["error"]) for x in C.update_tracking(t, b, r, asof).collect()}
    end = dt.datetime(2024, 1, 2)
    assert got == {"a": ("completed", end, 1, 3, None), "b": ("in_progress", None, None, None, None), "c": ("failed", None, None, None, "gone"), "d": ("completed", None, None, None, None), "e": ("submitted", None, None, None, None), "f": ("completed", end, 0, 0, None)}
    stories = spark.createDataFrame([(i,) for i in range(1, 8)], "story_id long")
    made = C.ingest_batch_results(r, stories, batches=b)[1]
    usage = spark.createDataFrame([("a", 1, 1000, 400, 100)], "batch_id string, story_id long, input long, cached long, output long")
    assert [tuple(x) for x in C.batch_summaries(made, t, usage).collect()] == [("a", 1, "Fine words here", 3, 1, "us", 3, 0.00057)]


def test_client_view_address(spark):
    detail = spark.createDataFrame([(1, "t", "us", 1, "s", True, 50), (2, "t", "us", 1, "s", True, 50), (3, "t", "us", 1, "s", True, 50)], "story_id long, title string, category string, source_count int, summary string, breaking boolean, importance int")
    urls = spark.createDataFrame([(1, "", 0), (1, "news.example/no-scheme", 1), (1, "https://b.example/x", 3), (1, "ftp://c.example", 2), (2, "http://has white.space", 0), (2, None, 1)], "story_id long, url string, place int")
    got = {r["story_id"]: r["url"] for r in A.client_view(detail, urls, "https://none.example").collect()}
    assert got == {1: "ftp://c.example", 2: "https://none.example", 3: "https://none.example"}


def test_story_checks_by_source_and_time(spark):
    ok = ("src", "A title")
    rows = [(1, "A fine long title", "us", "2024-01-02T03:04:05Z", [ok]), (2, "A fine long title", "us", "2024-02-30", [ok]), (3, "A fine long title", "us", "yesterday", [ok, None, ("x", None)]), (4, "A fine long title", "us", "2024", None), (5, "A fine long title", "us", None, [(None, "t")]), (6, "A fine long title", "us", "2024-01-02 03:04:05+01:00", [ok])]
    df = spark.createDataFrame(rows, "story_id long, title string, category string, last_updated string, sources array<struct<source:string,title:string>>")
    got = {r["story_id"]: r["issues"] for r in A.validate_stories(df).collect()}
    assert got == {2: ["bad time"], 3: ["bad time", "source 1 is nothing", "source 2 lacks a field"], 4: ["no sources", "bad time"], 5: ["no time", "source 0 lacks a field"]}


def test_headlines_are_accepted(spark):
    rows = [("One two three four", "old"), ("One two three fours", "old"), ("Four words of length", "old"), ("Fourwordsbutnotreally of length", "old"), ("word " * 60, "old")]
    got = [r["x"] for r in spark.createDataFrame(rows, "n string, o string").select(X.accept_headline(F.trim("n"), F.col("o")).alias("x")).collect()]
    assert got == ["old", "old", "Four words of length", "old", ("word " * 40).strip() + "..."]


def test_ingest_windows_as_a_stream(spark, tmp_path):
    """A window comes once, when the watermark has passed its end; what comes later than that is left out."""
    t = lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    rows = [("a", t(0, 10)), ("b", t(0, 50)), ("a", t(1, 5)), ("a", t(4)), ("a", t(0, 59)), ("c", t(9))]
    got = _stream(spark, str(tmp_path), rows, "source string, fetched_at timestamp", [[0, 1, 2], [3], [5], [4]], lambda df: K.ingest_windows(df, "1 minute", "2 minutes", sources=True))
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    assert sorted(((r["start"] - base) // 60, r["n"], r["sources"]) for r in got.collect()) == [(0, 2, 2), (1, 1, 1), (4, 1, 1)]


def test_inactive_feeds(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    a = spark.createDataFrame([("x", t(49)), ("y", t(50)), ("y", t(10)), ("z", t(59)), ("w", t(51))], "source string, fetched_at timestamp")
    feeds = spark.createDataFrame([(s,) for s in "wxyvz"], "source string")
    got = {r["source"]: (r["last_fetched"], r["inactive"]) for r in K.feed_activity(feeds, a.filter("source <> 'z'"), F.lit("2024-01-01 01:00:00").cast("timestamp"), 10).collect()}
    assert got == {"w": (t(51), False), "x": (t(49), True), "y": (t(50), True), "v": (None, True), "z": (None, True)}


@pytest.mark.parametrize("summaries", [(None, "", None), (None, "s", None)])
def test_fallback_of_few_is_the_fallback(spark, summaries):
    rows = [(i, summaries[i % 3], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 5)) for i in range(9)]
    df = spark.createDataFrame(rows, "story_id long, summary string, last_updated timestamp")
    one, other = (sorted(r["story_id"] for r in f(df, 4).collect()) for f in (R.with_fallback, R.with_fallback_of_few))
    assert one == other and len(one) == (3 if summaries[1] else 4)


def test_backfill_by_classes(spark):
    """Forty stories and fifty articles of one fingerprint are forty rows, not two thousand; titles equal up to a word meet by similarity, the smallest article first."""
    title = "President announces new climate policy in Washington"
    s = spark.createDataFrame([*[(i, "f", "x", "world") for i in range(40)], (100, "-", title, "world"), (101, "-", title, "world"), (102, "-", "Cooking rice", "world"), (103, None, title, "health")], "story_id long, fp string, title string, category string")
    a = spark.createDataFrame([*[(f"{'f' if i < 50 else i}", i, "Nothing alike" if i < 50 else f"{title} today", "world", dt.datetime(2024, 1, 1)) for i in range(55)]], "fp string, doc_id long, headline string, category string, published_at timestamp")
    got = sorted(tuple(r) for r in J.backfill_sources(s, a).collect())
    assert got == [*[(i, "f", 0, 50, "fingerprint") for i in range(40)], (100, "-", 50, 1, "title"), (101, "-", 50, 1, "title")]


def test_latency_is_exact(spark):
    """Nearest ranks of a key with more values than a sketch holds, skewed ones, of a small key, and of keys with nulls only or null."""
    big = [(i * 7919 % 60_013) ** 2 / 1e4 for i in range(60_000)]
    rows = [("big", v) for v in big] + [("big", None), ("few", 3.0), ("few", 1.0), (None, 5.0), ("none", None)]
    got = {r[0]: tuple(r)[1:] for r in M.latency(spark.createDataFrame(rows, "event_type string, value double").repartition(5)).collect()}
    rank = lambda p: round(sorted(big)[(len(big) * p + 99) // 100 - 1], 6)
    assert got == {"big": (60_001, rank(50), rank(95), rank(99)), "few": (2, 1.0, 3.0, 3.0), None: (1, 5.0, 5.0, 5.0), "none": (1, None, None, None)}


def test_items_of_one_link_stay_apart(spark, tmp_path):
    """Three pages of one address are three items, not nine; white space around it goes."""
    pages = spark.createDataFrame([(1, "http://x/a", "h"), (2, " http://x/a\t", "h"), (3, "http://x/a", "h"), (9, "http://x/b", "h")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["s2_parse_items"](spark, str(tmp_path)).select("page_id", "url").collect())
    assert got == [(i, "http://x/a") for i in (1, 2, 3)]


@pytest.mark.parametrize("cuts", [[15], [3, 6, 9, 15], list(range(1, 16))])
def test_feeds_of_one_group_keep_their_own_state(spark, tmp_path, cuts):
    """All feeds in one group with one timer, the null feed and large numbers too: the rows are those of feeds by themselves."""
    big = (1 << 62) + 1
    name = {1: big, 2: None, 3: 0, 4: 4}
    rows = [(name[f], i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), ok) for i, (f, m, ok) in enumerate([*_MINUTES, (4, 95, True), (3, 200, True)])]
    slices = [range(a, b) for a, b in zip([0, *cuts], cuts)]
    got = _stream(spark, str(tmp_path / "b"), rows, "feed long, event_id long, ts timestamp, ok boolean", slices, lambda df: K.breaker_stream(df, groups=1))
    at = lambda r: int((r["at"] - dt.datetime(2024, 1, 1)).total_seconds() // 60)
    assert sorted((at(r), r["feed"], r["state"], r["consecutive"]) for r in got.collect()) == [(2, big, "open", 3), (32, big, "half_open", 3), (40, big, "open", 4), (45, big, "closed", 0), (51, None, "open", 3), (81, None, "half_open", 3)]
    let = _stream(spark, str(tmp_path / "c"), [r[:3] for r in rows], "feed long, event_id long, ts timestamp", slices, lambda df: K.cooldown(df, 1800, groups=1))
    assert sorted((r["event_id"], r["feed"]) for r in let.collect()) == [(0, big), (2, None), (5, big), (6, None), (10, 0), (11, 0), (12, 4), (14, 0)]


def test_backfill_gives_every_article(spark):
    """A story gets every article of its fingerprint, as j3_backfill_sources gives it, and one of a like title where there is none."""
    from storyloom import plans
    from tests.oracle import SF

    title = "President announces new climate policy in Washington"
    s = spark.createDataFrame([*[(i, "f", "x", "world") for i in range(4)], (100, "-", title, "world"), (103, None, title, "health")], "story_id long, fp string, title string, category string")
    a = spark.createDataFrame([*[(f"{'f' if i < 50 else i}", i, "Nothing alike" if i < 50 else f"{title} today", "world", dt.datetime(2024, 1, 1)) for i in range(55)]], "fp string, doc_id long, headline string, category string, published_at timestamp")
    got = sorted(tuple(r) for r in J.backfill_links(s, a).collect())
    assert got == [*[(i, j, "fingerprint") for i in range(4) for j in range(50)], (100, 50, "title")]
    assert plans.QUERIES["j3_backfill_sources"](spark, SF).columns == ["story_id", "doc_id", "how"]


def test_every_article_has_its_similar_ones(spark):
    """r6_similar_articles asks for every article, not for some; within a radius the exact search gives what it gives without one."""
    from storyloom import plans
    from tests.oracle import SF

    asked = {r["query_id"] for r in plans.QUERIES["r6_similar_articles"](spark, SF).collect()}
    assert any(i % 50 for i in asked) and "% 50" not in plans.ORACLE_SQL["r6_similar_articles"].split(" tk AS ")[1]
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = v.withColumnRenamed("vec_id", "query_id")
    for k in (2, 20):
        every = J.vector_topk(q, v, k).filter("distance <= 1.3")
        assert sorted(map(tuple, J.vector_topk(q, v, k, within=1.3).filter("distance <= 1.3").collect())) == sorted(map(tuple, every.collect()))
