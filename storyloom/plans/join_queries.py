"""Registered queries of joins, retrieval and scoring."""

import uuid

from pyspark.sql import functions as F

from .. import vocab
from ..functions import similarity as Z
from ..functions import text as X
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources.io import durable, shared_folder
from . import views as V
from .text_queries import BARE, ENTITIES, JAC, SIM, WORDS
from .views_sql import T, query

COS = "list_dot_product({0}::double[], {1}::double[]) / (sqrt(list_dot_product({0}::double[], {0}::double[])) * sqrt(list_dot_product({1}::double[], {1}::double[])))"
CENT = """, dims AS (SELECT label AS story_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), mean AS (SELECT story_id, i, avg(x) AS m FROM dims GROUP BY 1, 2),
 raw AS (SELECT story_id, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS n FROM mean GROUP BY 1), cent AS (SELECT story_id, list_transform(c, lambda x: x / n) AS centroid FROM raw)"""


@query(f", p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, b, round({COS.format('x', 'y')}, 5) AS cosine FROM p")
def e1_cosine(spark, d):
    v = V.vectors(spark, d)
    j = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")
    return j.select("a", "b", F.round(Z.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query(f"{CENT} SELECT story_id, len(centroid)::int AS dims, round(centroid[1], 6) AS x0, round(centroid[64], 6) AS x63 FROM cent")
def e2_centroids(spark, d):
    c = J.centroids(V.vectors(spark, d))
    return c.select("story_id", F.size("centroid").alias("dims"), F.round(F.col("centroid")[0], 6).alias("x0"), F.round(F.col("centroid")[63], 6).alias("x63"))


def _vector_stories(spark, d):
    v = V.vectors(spark, d)
    a = V.articles(spark, d).select("doc_id", "headline", "published_at")
    about = v.join(a, v.vec_id == a.doc_id).groupBy(v.story_id).agg(F.min_by("headline", "doc_id").alias("title"), F.max("published_at").alias("last_updated"))
    return J.centroids(v).join(about, "story_id")


@query(f"""{CENT}, about AS (SELECT label AS story_id, arg_min(headline, doc_id) AS title FROM embeddings JOIN articles ON vec_id = doc_id GROUP BY 1),
 sc AS (SELECT doc_id, a.headline, c.story_id, t.title, round({COS.format('embedding', 'centroid')}, 6) AS score FROM embeddings e JOIN articles a ON e.vec_id = a.doc_id CROSS JOIN cent c JOIN about t ON t.story_id = c.story_id),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, story_id) AS r FROM sc) WHERE r = 1)
 SELECT doc_id, story_id, score FROM best WHERE score >= 0.3 OR score >= 0.2 AND len(list_intersect(list_distinct(list_transform(list_filter({WORDS.format('headline')}, lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{{Lu}}')), lambda w: lower(w))),
 list_distinct(list_transform(list_filter({WORDS.format('title')}, lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{{Lu}}')), lambda w: lower(w))))) >= 2""")
def j1_match_stories(spark, d):
    v = V.vectors(spark, d)
    a = V.articles(spark, d).join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    return J.match_stories(a, _vector_stories(spark, d), 0.3, 0.2)


def _fp(c):
    return f"md5(trim({BARE.format(c)}, ' '))[1:12]"


@query(f"SELECT doc_id, fp, s.story_id, stories FROM (SELECT doc_id, {_fp('headline')} AS fp FROM articles) a JOIN (SELECT {_fp('title')} AS fp, min(story_id) AS story_id, count(*) AS stories FROM stories GROUP BY 1) s USING (fp)")
def j2_match_fingerprint(spark, d):
    s = V.stories(spark, d).select("story_id", X.title_fp(F.col("title")).alias("fp"))
    return J.match_fingerprint(V.articles(spark, d).select("doc_id", X.title_fp(F.col("headline")).alias("fp")), s)


@query(f""", sj AS (SELECT story_id, CASE WHEN story_id % 2 = 0 THEN {_fp('title')} ELSE '-' END AS fp, title, category FROM stories WHERE source_count = 1), aj AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_fp('headline')} ELSE doc_id::varchar END AS fp, headline, category, published_at FROM articles),
 eq AS (SELECT story_id, doc_id FROM sj JOIN aj USING (fp)), pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, doc_id) AS r FROM aj) WHERE r <= 500),
 prs AS (SELECT story_id AS x, doc_id AS y, title AS h, headline AS g FROM sj JOIN pool USING (category) WHERE story_id NOT IN (SELECT story_id FROM eq)){SIM}
 SELECT story_id, doc_id, 'fingerprint' AS how FROM eq UNION ALL SELECT x, y, 'title' FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY similarity DESC, y) AS r FROM sm WHERE similarity > 0.6) WHERE r = 1""")
def j3_backfill_sources(spark, d):
    s = V.stories(spark, d).filter("source_count = 1").select("story_id", F.when(F.col("story_id") % 2 == 0, X.title_fp(F.col("title"))).otherwise("-").alias("fp"), "title", "category")
    a = V.articles(spark, d).select(F.when(F.col("doc_id") % 3 == 0, X.title_fp(F.col("headline"))).otherwise(F.col("doc_id").cast("string")).alias("fp"), "doc_id", "headline", "category", "published_at")
    return J.backfill_links(s, a)


def _with_members(spark, d):
    return V.members(spark, d).groupBy("story_id").agg(F.sort_array(F.collect_list("doc_id")).alias("members"))


@query("SELECT story_id, source, max(doc_id) AS doc_id FROM articles GROUP BY 1, 2")
def j4_story_sources(spark, d):
    return J.story_sources(_with_members(spark, d), V.articles(spark, d))


@query("SELECT doc_id, story_id FROM articles")
def j5_membership(spark, d):
    return J.membership(_with_members(spark, d))


_SLOT = "('0x' || md5('42:' || {0} || ':' || doc_id)[1:8])::bigint"
_POSITIVE = """, pos AS (SELECT x.doc_id AS a, y.doc_id AS b, 1::int AS label FROM articles x JOIN articles y ON x.story_id = y.story_id AND x.doc_id < y.doc_id ORDER BY md5('42:' || x.doc_id || ':' || y.doc_id) LIMIT 300)"""


@query(f"{_POSITIVE} SELECT * FROM pos")
def j6_positive_pairs(spark, d):
    return J.positive_pairs(V.members(spark, d), 300)


_HARD = f"""{ENTITIES}, dn AS (SELECT count(*) AS n, least(count(*), 6000) AS drawn FROM articles), pl AS (SELECT doc_id, unnest(range(1, (SELECT (6000 + drawn - 1) // drawn FROM dn) + 1)) AS r FROM articles, dn WHERE {_SLOT.format("'pool'")} * n < 6000 * 4294967296),
 ps AS (SELECT *, {_SLOT.format('r')} % (SELECT greatest(drawn // 2, 1) FROM dn) AS slot FROM pl), rp AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM ps x JOIN ps y ON x.r = y.r AND x.slot = y.slot AND x.doc_id < y.doc_id),
 en AS (SELECT doc_id, list(DISTINCT lower(w)) AS e FROM ents GROUP BY 1), ab AS (SELECT doc_id, story_id, list_distinct({WORDS.format('lower(headline)')}) AS t, coalesce(e, []) AS e FROM articles LEFT JOIN en USING (doc_id)),
 hard AS (SELECT a, b, round(j, 6)::double AS jaccard, round(k, 6)::double AS entities, 0::int AS label FROM (SELECT a, b, {JAC.format('x.t', 'y.t')} AS j, {JAC.format('x.e', 'y.e')} AS k FROM rp JOIN ab x ON x.doc_id = a JOIN ab y ON y.doc_id = b WHERE x.story_id <> y.story_id)
 WHERE (j > 0.1 AND j < 0.6) OR (k > 0.2 AND k < 0.8) ORDER BY md5('42:' || a || ':' || b) LIMIT 300)"""


@query(f"{_HARD} SELECT * FROM hard")
def j7_hard_negatives(spark, d):
    return J.hard_negatives(V.with_entities(V.articles(spark, d)), 300)


_EASY = """, sc8 AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || doc_id)) AS r FROM articles), easy AS (SELECT x.doc_id AS a, y.doc_id AS b, 0::int AS label FROM sc8 x JOIN sc8 y ON x.r = y.r AND x.category < y.category WHERE x.r <= 20 ORDER BY md5('42:' || x.doc_id || ':' || y.doc_id) LIMIT 200)"""


@query(f"{_EASY} SELECT * FROM easy")
def j8_easy_negatives(spark, d):
    return J.easy_negatives(V.articles(spark, d), 20, 200)


@query("SELECT story_id FROM stories WHERE last_updated >= TIMESTAMP '2024-01-01 10:00:00' - INTERVAL 10 MINUTE AND NOT breaking AND story_id % 3 <> 0")
def j10_unseen(spark, d):
    s = V.stories(spark, d)
    return J.unseen_stories(s, s.filter("breaking"), s.filter("story_id % 3 = 0"), F.lit("2024-01-01 10:00:00").cast("timestamp")).select("story_id")


@query(f"SELECT 'src' || f.feed AS source FROM feeds f WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.source = 'src' || f.feed AND fetched_at > {T} - INTERVAL 24 HOUR AND fetched_at <= {T})")
def j11_missing_sources(spark, d):
    expected = V.feeds(spark, d).select(F.concat(F.lit("src"), F.col("feed").cast("string")).alias("source"))
    return J.missing_sources(expected, V.articles(spark, d), V.asof())


@query("SELECT story_id, c_custkey AS user_id FROM stories, customer WHERE source_count BETWEEN 3 AND 4 AND NOT notified AND first_seen > TIMESTAMP '2024-01-01 02:05:00' - INTERVAL 30 MINUTE AND first_seen <= TIMESTAMP '2024-01-01 02:05:00' AND c_acctbal > 5000")
def j12_notifications(spark, d):
    prefs = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 5000).alias("opted_in"))
    return J.notification_rows(V.stories(spark, d), prefs, F.lit("2024-01-01 02:05:00").cast("timestamp"))


@query("SELECT s.story_id, coalesce(last_updated <= r.ts, false) AS read FROM stories s LEFT JOIN (SELECT story_id, min(ts) AS ts FROM interactions WHERE kind = 'view' GROUP BY 1) r USING (story_id)")
def j13_read_state(spark, d):
    reads = V.interactions(spark, d).filter("kind = 'view'").groupBy("story_id").agg(F.min("ts").alias("read_at"))
    return J.with_read_state(V.stories(spark, d), reads).select("story_id", "read")


_CLUES = "|".join(vocab.PLACE_CLUES)
_TOKENS = "list_distinct(list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))"
_LINKS = f"""{ENTITIES}, kb AS (SELECT n_nationkey AS qid, lower({'list_extract([' + ', '.join(repr(c) for c in vocab.COUNTRIES) + '], n_nationkey % 15 + 1)'}) AS label, lower(n_name) AS alias, n_nationkey * 10 AS sitelinks, CASE WHEN n_nationkey % 4 = 0 THEN 'entity' ELSE 'country' END AS kind, 'country based in region ' || n_regionkey AS d FROM nation),
 lk AS (SELECT e.doc_id, e.w AS mention, qid, lower(e.w) AS q, lower(a.headline) AS c, label, alias, sitelinks, kind, d, e.type FROM ents e JOIN articles a USING (doc_id) JOIN kb ON list_has_any({WORDS.format('lower(e.w)')}, list_concat({WORDS.format('label')}, {WORDS.format('alias')}))),
 ls AS (SELECT doc_id, mention, qid, round(0.3 * least(sitelinks / 100, 1.0) + CASE WHEN q = label THEN 0.4 WHEN contains(label, q) THEN 0.2 ELSE 0 END + CASE WHEN q = alias THEN 0.3 WHEN contains(alias, q) THEN 0.15 ELSE 0 END + 0.2 * CASE WHEN type = 'LOCATION' AND kind = 'country' THEN 1.0 WHEN kind = 'entity' THEN 0.5 ELSE 0 END
 + 0.2 * least(0.5 * len(list_intersect({_TOKENS.format('d')}, {_TOKENS.format('c')})) / len({_TOKENS.format('d')}) + CASE WHEN contains(c, label) THEN 0.3 ELSE 0 END + CASE WHEN kind = 'country' AND regexp_matches(c, '{_CLUES}') THEN 0.2 ELSE 0 END, 1.0), 6)::double AS score FROM lk),
 links AS (SELECT doc_id, mention, qid, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mention ORDER BY score DESC, qid) AS place FROM ls WHERE score > 0.6) WHERE place = 1)"""


def _links(spark, d, ids=None):
    """Links of all articles' entities, or of those articles whose doc_id is in ids."""
    label = F.element_at(F.array(*[F.lit(c) for c in vocab.COUNTRIES]), (F.col("n_nationkey") % 15 + 1).cast("int"))
    kind = F.when(F.col("n_nationkey") % 4 == 0, "entity").otherwise("country")
    told = F.concat(F.lit("Country based in region "), F.col("n_regionkey").cast("string"))
    kb = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), label.alias("label"), F.array("n_name").alias("aliases"), (F.col("n_nationkey") * 10).alias("sitelinks"), kind.alias("type"), told.alias("description"))
    a = V.articles(spark, d) if ids is None else V.articles(spark, d).join(ids, "doc_id", "left_semi")
    m = V.with_entities(a).select("doc_id", F.col("headline").alias("context"), F.explode("entities").alias("e")).select("doc_id", "context", F.col("e.text").alias("mention"), F.col("e.type").alias("type"))
    return J.link_entities(m, kb)


@query(f"{_LINKS} SELECT doc_id, mention, qid, score FROM links")
def j14_link_entities(spark, d):
    return _links(spark, d)


def _bits(half):
    return " + ".join(f"CASE WHEN 2 * sum(({half} >> {i}) & 1) > count(*) THEN {1 << i} ELSE 0 END" for i in range(32))


_WEEK = "604800"
_J15 = f""", xa AS (SELECT doc_id, epoch(published_at) AS t, lower(trim(headline)) AS k, lower(headline || description) AS txt FROM articles), xb AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t, doc_id) <= {_WEEK} THEN 0 ELSE 1 END AS new FROM xa),
 xc AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t, doc_id) AS s FROM xb), xd AS (SELECT *, first_value(doc_id) OVER (PARTITION BY k, s ORDER BY t, doc_id) AS f FROM xc),
 xg AS (SELECT doc_id, t, unnest(CASE WHEN len(w) < 3 THEN [txt] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM (SELECT *, {WORDS.format('txt')} AS w FROM xd WHERE doc_id = f)),
 xh AS (SELECT doc_id, t, ('0x' || md5(g)[17:24])::bigint AS hi, ('0x' || md5(g)[25:32])::bigint AS lo FROM xg), xs AS (SELECT doc_id, t, ({_bits('hi')})::bigint AS hi, ({_bits('lo')})::bigint AS lo FROM xh GROUP BY doc_id, t),
 ya AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY hi, lo ORDER BY t, doc_id) <= {_WEEK} THEN 0 ELSE 1 END AS new FROM xs), yb AS (SELECT *, sum(new) OVER (PARTITION BY hi, lo ORDER BY t, doc_id) AS s FROM ya),
 yc AS (SELECT doc_id, hi, lo, t, first_value(doc_id) OVER w AS f, min(t) OVER (PARTITION BY hi, lo, s) AS since, max(t) OVER (PARTITION BY hi, lo, s) AS until FROM yb WINDOW w AS (PARTITION BY hi, lo, s ORDER BY t, doc_id)), yr AS (SELECT * FROM yc WHERE doc_id = f)"""


@query(f"""{_J15} SELECT f AS a, doc_id AS b, 0::int AS distance, 'exact' AS kind FROM xd WHERE doc_id <> f UNION ALL SELECT f, doc_id, 0, 'near' FROM yc WHERE doc_id <> f
 UNION ALL SELECT x.doc_id, y.doc_id, (bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)))::int, 'near' FROM yr x JOIN yr y ON (x.since < y.since OR x.since = y.since AND x.doc_id < y.doc_id) AND bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) BETWEEN 1 AND 3 AND y.since - x.until <= {_WEEK}""")
def j15_near_duplicates(spark, d):
    return J.near_duplicates(V.articles(spark, d))


@query("SELECT doc_id, count(*) AS n, min(s.story_id) AS first FROM articles a JOIN stories s ON a.category = s.category AND s.first_seen >= a.published_at - INTERVAL 7 DAY AND s.first_seen <= a.published_at + INTERVAL 6 HOUR GROUP BY 1")
def j16_candidate_window(spark, d):
    return J.candidate_window(V.articles(spark, d), V.stories(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("story_id").alias("first"))


@query("SELECT doc_id, story_id, place::int AS place FROM (SELECT doc_id, s.story_id, row_number() OVER (PARTITION BY doc_id ORDER BY s.first_seen DESC, s.story_id DESC) AS place FROM articles a JOIN stories s ON a.category = s.category AND s.first_seen >= a.published_at - INTERVAL 7 DAY AND s.first_seen <= a.published_at + INTERVAL 6 HOUR) WHERE place <= 20")
def j16_latest_in_window(spark, d):
    return R.latest_in_window(V.articles(spark, d), V.stories(spark, d), 20)


@query(", b AS (SELECT user_id, category, sum(CASE kind WHEN 'view' THEN 1 WHEN 'like' THEN 3 WHEN 'save' THEN 5 END) AS w FROM interactions JOIN stories USING (story_id) WHERE kind IN ('view', 'like', 'share', 'save') GROUP BY 1, 2) SELECT user_id, category, round(w / max(w) OVER (PARTITION BY user_id), 6) AS affinity FROM b")
def j17_category_affinity(spark, d):
    return J.category_affinity(V.interactions(spark, d), V.stories(spark, d), vocab.AFFINITY)


def _corpus(spark, d):
    return V.articles(spark, d).select("doc_id", F.concat_ws(" ", "title", "description").alias("text"))


_TOK = "list_filter(" + WORDS.format("lower({0})") + ", lambda w: length(w) > 2 AND w NOT IN {1})"


def _bm(queries):
    """SQL of sc (query_id, doc_id, score) for queries (query_id, text)."""
    return f""", dd AS (SELECT doc_id, {_TOK.format("title || ' ' || description", vocab.STOP_RETRIEVAL)} AS w FROM articles), dl AS (SELECT * FROM dd WHERE len(w) > 0), nn AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dl), pp AS (SELECT doc_id, len(w) AS l, unnest(w) AS t FROM dl), tf AS (SELECT t, doc_id, l, count(*) AS tf FROM pp GROUP BY 1, 2, 3),
 df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), qq AS (SELECT DISTINCT query_id, unnest({_TOK.format('text', vocab.STOP_QUERY)}) AS t FROM ({queries})), sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / mean))), 4) AS score FROM qq JOIN df USING (t) JOIN tf USING (t), nn GROUP BY 1, 2)"""


@query(f"{_bm('SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id, count(*) AS n, round(max(score), 3) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 50 GROUP BY 1")
def e5_bm25(spark, d):
    q = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.search_postings(q, R.build_postings(_corpus(spark, d)), 50).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 3).alias("best"))


_L2 = "round(list_sum(list_transform(list_zip(q.embedding::double[], c.embedding::double[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
_TOP = f", tk AS (SELECT q.vec_id AS query_id, c.vec_id, {_L2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)"


def _topk(spark, d, k):
    v = V.vectors(spark, d)
    return J.vector_topk(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, k)


@query(f"{_TOP} SELECT query_id, vec_id, round(distance, 4) AS distance, rank::int AS rank FROM tk WHERE rank <= 10")
def e6_vector_topk(spark, d):
    return _topk(spark, d, 10).withColumn("distance", F.round("distance", 4))


@query()
def e6_vector_index(spark, d):
    """The vectors whose number is divisible by 50 against all, by an index of cells; as many are looked at as hold 95 % of a draw's exact neighbours."""
    v = V.vectors(spark, d)
    index = R.build_cells(v)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.search_cells(q, index, 10, R.probes_for(index, 10))


_TOPF = f""", ev AS (SELECT vec_id, embedding, category, published_at, source FROM embeddings JOIN articles ON vec_id = doc_id), tf6 AS (SELECT q.vec_id AS query_id, c.vec_id, {_L2} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_L2}, c.vec_id) AS rank FROM ev q JOIN ev c
 ON q.category = c.category AND q.source <> c.source AND c.published_at >= q.published_at - INTERVAL 7 DAY AND c.published_at <= q.published_at + INTERVAL 6 HOUR WHERE q.vec_id % 50 = 0)"""


def _topk_near(spark, d, k):
    """Of other sources, of one category, published from a week before to six hours after the query's article."""
    about = ("category", "published_at", "source")
    v = V.vectors(spark, d).join(V.articles(spark, d).select(F.col("doc_id").alias("vec_id"), *about), "vec_id")
    when = (F.col("published_at") >= F.col("q_published_at") - F.expr("interval 7 days")) & (F.col("published_at") <= F.col("q_published_at") + F.expr("interval 6 hours"))
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return J.vector_topk(q, v, k, where=(F.col("category") == F.col("q_category")) & (F.col("source") != F.col("q_source")) & when, about=about)


@query(f"{_TOPF} SELECT query_id, vec_id, round(distance, 4) AS distance, rank::int AS rank FROM tf6 WHERE rank <= 10")
def e6_vector_topk_filtered(spark, d):
    return _topk_near(spark, d, 10).withColumn("distance", F.round("distance", 4))


_ARMS = f"{_TOPF}{_bm('SELECT doc_id AS query_id, headline AS text FROM articles WHERE doc_id % 50 = 0')}, kw AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc), arms AS (SELECT query_id, vec_id AS doc_id, rank FROM tf6 WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, rank FROM kw WHERE rank <= 15)"


def _arms(spark, d, k=15):
    """The vector hits and the keyword hits of the articles whose number is divisible by 50."""
    q = V.articles(spark, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("headline").alias("text"))
    return _topk_near(spark, d, k).select("query_id", F.col("vec_id").alias("doc_id"), "rank"), R.search_postings(q, R.build_postings(_corpus(spark, d)), k).select("query_id", "doc_id", "rank")


@query(f"{_ARMS} SELECT query_id, doc_id, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS rank FROM (SELECT query_id, doc_id, min(rank) AS best FROM arms GROUP BY 1, 2)) WHERE rank <= 30")
def r5_hybrid(spark, d):
    return J.hybrid_candidates(*_arms(spark, d), 30).select("query_id", "doc_id", "rank")


_TOP_OF_ALL = _TOP.replace(" WHERE q.vec_id % 50 = 0", "")


@query(f"{_TOP_OF_ALL} SELECT query_id, vec_id AS doc_id, round(1 - distance / 2, 3) AS score FROM tk WHERE rank <= 20 AND query_id <> vec_id AND 1 - distance / 2 >= 0.35")
def r6_similar_articles(spark, d):
    """The similar articles of every article. Vectors are of length one, so a score of 0.35 is a squared distance of 1.3."""
    v = V.vectors(spark, d)
    near = J.vector_topk(v.select(F.col("vec_id").alias("query_id"), "embedding"), v, 20, within=1.3)
    c = near.select("query_id", F.col("vec_id").alias("doc_id"), (1 - F.col("distance") / 2).alias("score"))
    return J.similar_articles(c, v, 0.35, 20).select("query_id", "doc_id", F.round("score", 3).alias("score"))


def _pairs(spark, d):
    return J.pair_dataset(J.positive_pairs(V.members(spark, d), 300), J.hard_negatives(V.with_entities(V.articles(spark, d)), 300), J.easy_negatives(V.articles(spark, d), 20, 200))


def _described(spark, d, pairs):
    """The articles of pairs (a, b) with what pair_features needs of them."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    a = V.with_entities(V.articles(spark, d).join(ids, "doc_id", "left_semi"))
    a = a.withColumn("signature", X.event_signature(F.col("headline"), F.col("description"), F.col("entities")))
    qids = _links(spark, d, ids).groupBy("doc_id").agg(F.collect_set("qid").alias("qids"))
    return a.join(qids, "doc_id", "left").withColumn("qids", F.coalesce("qids", F.array().cast("array<int>")))


def _features(spark, d):
    pairs = durable(_pairs(spark, d))
    return J.pair_features(pairs, _described(spark, d, pairs), V.vectors(spark, d))


@query()
def e7_pair_features(spark, d):
    return _features(spark, d)


@query()
def e8_rule_score(spark, d):
    return J.rule_score(_features(spark, d)).select("a", "b", "label", "score")


@query()
def e9_learned_scorer(spark, d):
    """The held-back pairs' figures of a model of 100 trees of depth 6."""
    model, rest = J.train_scorer(durable(_features(spark, d).repartition(2)))
    return M.pair_metrics(J.score_pairs(model, rest), 0.5)


def _forest(spark, d):
    return J.train_scorer(durable(_features(spark, d).repartition(2)), trees=20, depth=5, forest=True)


@query()
def e9_importances(spark, d):
    """How much each feature weighs in a forest, the form for labels that boosting can't take."""
    return J.importances(_forest(spark, d)[0], spark)


@query()
def e9_stored_scorer(spark, d):
    """A forest, saved, loaded and applied to the candidates of the articles whose number is divisible by 50: their ten most similar articles."""
    path = f"{shared_folder(spark)}/scorer-{uuid.uuid4()}"
    J.save_scorer(_forest(spark, d)[0], path)
    c = durable(J.hybrid_candidates(*_arms(spark, d), 30).select("query_id", "doc_id"))
    scored = J.score_candidates(J.load_scorer(path), c, _described(spark, d, c.toDF("a", "b")), V.vectors(spark, d))
    return J.similar_articles(c, V.vectors(spark, d), 0.0, 10, scored)


_FACTORS = f"""{ENTITIES}, fa AS (SELECT a.doc_id, a.story_id, a.headline, a.published_at, a.category, coalesce(names, []) AS names, place FROM articles a LEFT JOIN (SELECT doc_id, list(DISTINCT lower(w)) AS names, lower(arg_min(w, r) FILTER (type = 'LOCATION')) AS place FROM ents GROUP BY 1) n ON n.doc_id = a.doc_id),
 fn AS (SELECT story_id, list(DISTINCT lower(w)) AS names FROM ents JOIN articles USING (doc_id) GROUP BY 1), fp AS (SELECT story_id, arg_min_null(place, doc_id) AS place FROM fa GROUP BY 1),
 sd AS (SELECT a.story_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings JOIN articles a ON a.doc_id = vec_id), sm0 AS (SELECT story_id, i, avg(x) AS m FROM sd GROUP BY 1, 2), sr AS (SELECT story_id, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS n FROM sm0 GROUP BY 1), sct AS (SELECT story_id, list_transform(c, lambda x: x / n) AS centroid FROM sr),
 fc AS (SELECT a.doc_id, s.story_id, a.published_at, CASE WHEN embedding IS NULL OR centroid IS NULL THEN 0.0 ELSE round({COS.format('embedding', 'centroid')}, 6) END AS cosine, {JAC.format('a.names', 'coalesce(n.names, [])')} AS entities, list_distinct({WORDS.format('lower(a.headline)')}) AS u, list_distinct({WORDS.format('lower(s.title)')}) AS v,
 abs(epoch(a.published_at) - epoch(s.last_updated)) / 3600 / CASE WHEN s.breaking THEN 24.0 ELSE 72.0 END AS far, coalesce(a.place = p.place, false) AS same FROM fa a JOIN stories s ON a.category = s.category AND s.first_seen >= a.published_at - INTERVAL 7 DAY AND s.first_seen <= a.published_at + INTERVAL 6 HOUR
 LEFT JOIN fn n ON n.story_id = s.story_id LEFT JOIN fp p ON p.story_id = s.story_id LEFT JOIN embeddings e ON e.vec_id = a.doc_id LEFT JOIN sct c ON c.story_id = s.story_id WHERE a.doc_id % 50 = 0),
 fs AS (SELECT doc_id, story_id, published_at, round(0.55 * cosine + 0.20 * entities + 0.10 * ({JAC.format('u', 'v')}) + 0.10 * exp(-(far * far)) + 0.05 * same::int, 6)::double AS score FROM fc)"""


def _scored(spark, d):
    """The articles whose number is divisible by 50, against all stories of their window."""
    a = V.with_entities(V.articles(spark, d))
    names = F.array_distinct(F.transform("entities", lambda e: F.lower(e["text"])))
    place = F.lower(F.get(F.filter("entities", lambda e: e["type"] == "LOCATION"), F.lit(0))["text"])
    a = a.withColumns({"names": names, "place": place})
    v = V.vectors(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    centres = J.centroids(v.join(a.select("doc_id", "story_id"), "doc_id"), vector="vector")
    known = a.select("story_id", F.explode("names").alias("n")).groupBy("story_id").agg(F.collect_set("n").alias("names"))
    s = V.stories(spark, d).join(a.groupBy("story_id").agg(F.min_by("place", "doc_id").alias("place")), "story_id").join(known, "story_id", "left").join(centres, "story_id", "left")
    s = s.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    mine = a.filter("doc_id % 50 = 0").join(v, "doc_id", "left")
    return J.multi_factor_score(J.story_factors(J.candidate_window(mine, s), mine, s))


@query(f"{_FACTORS} SELECT doc_id, story_id, score FROM fs")
def e10_multi_factor(spark, d):
    return _scored(spark, d).select("doc_id", "story_id", "score")


@query(f"""{_FACTORS}, ag AS (SELECT doc_id, avg(score) AS m, stddev_pop(score) AS d, count(*) AS n FROM fs GROUP BY 1), bs AS (SELECT *, (epoch({T}) - epoch(published_at)) / 3600 AS age FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, story_id) AS r FROM fs) WHERE r = 1)
 SELECT doc_id, story_id, score FROM bs JOIN ag USING (doc_id) WHERE score >= CASE WHEN age < 12 THEN 0.62 WHEN age < 72 THEN 0.58 ELSE 0.52 END OR (n > 1 AND score >= round(m + 2 * d, 6))""")
def e11_assign_clusters(spark, d):
    age = (V.asof().cast("double") - F.col("published_at").cast("double")) / 3600
    return J.assign_clusters(_scored(spark, d).join(V.articles(spark, d).select("doc_id", age.alias("age_hours")), "doc_id"))


@query(f"{_ARMS} SELECT DISTINCT query_id, doc_id FROM arms")
def u1_union_hits(spark, d):
    x, y = _arms(spark, d)
    return x.select("query_id", "doc_id").union(y.select("query_id", "doc_id")).distinct()


@query(f"{_POSITIVE}{_HARD}{_EASY} SELECT a, b, label FROM pos UNION ALL SELECT a, b, label FROM hard UNION ALL SELECT a, b, label FROM easy")
def u2_pair_dataset(spark, d):
    return _pairs(spark, d)


@query("SELECT 'src' || feed AS source FROM feeds EXCEPT SELECT DISTINCT source FROM articles")
def u3_set_difference(spark, d):
    return V.feeds(spark, d).select(F.concat(F.lit("src"), F.col("feed").cast("string")).alias("source")).subtract(V.articles(spark, d).select("source"))


@query("SELECT feed, count(*) AS n, count(error) AS errors FROM (SELECT feed, NULL AS error FROM fetch_log WHERE ok UNION ALL SELECT feed, error FROM fetch_log WHERE NOT ok) GROUP BY 1")
def u4_union_events(spark, d):
    log = V.fetch_log(spark, d)
    both = log.filter("ok").select("feed").unionByName(log.filter("not ok").select("feed", "error"), allowMissingColumns=True)
    return both.groupBy("feed").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@query(f", p AS (SELECT a.doc_id AS x, list_distinct({WORDS.format('lower(a.headline)')}) AS u, list_distinct({WORDS.format('lower(b.headline)')}) AS v FROM articles a JOIN articles b ON b.doc_id = a.doc_id + 1) SELECT x, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 6) AS jaccard FROM p")
def u5_set_ratio(spark, d):
    a = V.articles(spark, d).select("doc_id", Z.token_set(F.col("headline")).alias("u"))
    j = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("u").alias("v")), "doc_id")
    return j.select(F.col("doc_id").alias("x"), F.round(Z.jaccard(F.col("u"), F.col("v")), 6).alias("jaccard"))
