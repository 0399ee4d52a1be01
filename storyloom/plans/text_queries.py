"""Registered queries of cleaning, ids, categories, signatures, filters and title similarity."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..functions import similarity as Z
from ..functions import text as X
from ..operators import articles as A
from . import views as V
from .views_sql import T, any_of, any_pattern, lst, query

BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
CLEAN = r"trim(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length(c) AS n_clean, md5(c) AS digest FROM (SELECT page_id, {CLEAN.format('html')} AS c FROM pages)")
def p1_clean_text(spark, d):
    rows = A.clean_columns(V.table(spark, d, "pages"), ["html"], decode=False)
    return rows.select("page_id", F.length("html").cast("long").alias("n_clean"), F.md5(F.col("html").cast("binary")).alias("digest"))


@query()
def p1_clean_entities(spark, d):
    rows = A.clean_columns(V.table(spark, d, "pages"), ["html"])
    return rows.select("page_id", F.length("html").alias("n_clean"), F.md5(F.col("html").cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(description) <= 80 THEN description ELSE regexp_replace(substr(description, 1, 80), ' [^ ]*$', '') || '...' END AS description FROM articles")
def p2_truncate(spark, d):
    return A.truncate_column(V.articles(spark, d), "description", 80).select("doc_id", "description")


@query("SELECT doc_id, source || '_' || strftime(published_at, '%Y%m%d') || '_' || md5(url)[1:8] AS id FROM articles")
def p4_article_id(spark, d):
    return A.with_article_id(V.articles(spark, d)).select("doc_id", "id")


@query(f"SELECT doc_id, md5(trim({BARE.format('title')}, ' '))[1:12] AS fp FROM articles")
def p6_title_fp(spark, d):
    return V.articles(spark, d).select("doc_id", X.title_fp(F.col("title")).alias("fp"))


ENT = f"""list_filter({WORDS.format("headline || ' ' || description")}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND length(w) > 2)"""
TYPED = f"""SELECT doc_id, headline, list_transform(list_filter(list_transform({ENT}, lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')), lambda w: true), lambda w: w) AS ws FROM articles"""
ENTITIES = f""", base AS ({TYPED}), u AS (SELECT doc_id, headline, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM base),
 firsts AS (SELECT doc_id, headline, w, min(i) AS i FROM u GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM firsts),
 ents AS (SELECT doc_id, w, r, CASE WHEN w IN {tuple(vocab.COUNTRIES)} OR ends_with(w, 'land') OR ends_with(w, 'stan') THEN 'LOCATION' ELSE 'ORGANIZATION' END AS type FROM rk WHERE r <= 20)"""


@query(f"{ENTITIES} SELECT doc_id, cast(r AS int) AS place, w AS entity, type FROM ents")
def p13_entities(spark, d):
    rows = V.with_entities(V.articles(spark, d))
    return rows.select("doc_id", F.posexplode("entities").alias("i", "e")).select("doc_id", (F.col("i") + 1).alias("place"), F.col("e.text").alias("entity"), F.col("e.type").alias("type"))


@query(f"""{ENTITIES}, sc AS (SELECT e.doc_id, w, r, round(CASE WHEN contains(lower(headline), lower(w)) THEN 1.0 ELSE 0.0 END + 0.5 * (1 - (strpos(headline || ' ' || description, w) - 1) / 5000) + 0.3 * (0.5 + CASE WHEN upper(w) = w AND lower(w) <> w THEN 0.1 ELSE 0 END), 6)::double AS s FROM ents e JOIN articles a USING (doc_id))
 SELECT doc_id, place::int AS place, w AS entity, s AS salience FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, r) AS place FROM sc) WHERE place <= 10""")
def p14_rank_entities(spark, d):
    rows = A.rank_entities(V.with_entities(V.articles(spark, d)))
    return rows.select("doc_id", F.posexplode("ranked").alias("i", "e")).select("doc_id", (F.col("i") + 1).alias("place"), F.col("e.text").alias("entity"), F.col("e.salience").alias("salience"))


_CONTENT = f"list_filter(list_filter(regexp_split_to_array(trim({BARE.format('headline')}, ' '), '\\s+'), lambda w: length(w) > 3), lambda w: w NOT IN {vocab.STOP_FINGERPRINT})"


@query(f"""{ENTITIES}, el AS (SELECT doc_id, list(lower(w) ORDER BY r DESC) FILTER (type <> 'LOCATION') AS people, list(lower(w) ORDER BY r) FILTER (type = 'LOCATION') AS places, list(lower(w) ORDER BY r) AS every FROM ents GROUP BY 1),
 fk AS (SELECT a.doc_id, {_CONTENT} AS content, list_filter({_CONTENT}, lambda w: w NOT IN {vocab.GENERIC_VERBS})[1:6] AS key, list_concat(list_concat(coalesce(people, []), coalesce(places, [])), coalesce(every, []))[1:3] AS three FROM articles a LEFT JOIN el ON el.doc_id = a.doc_id),
 ft AS (SELECT doc_id, CASE WHEN len(list_distinct(list_concat(key, three))) < 3 THEN list_distinct(list_concat(content[1:5], three)) ELSE list_distinct(list_concat(key, three)) END AS terms FROM fk) SELECT doc_id, md5(array_to_string(list_sort(terms), '_'))[1:8] AS fp FROM ft""")
def p7_story_fp(spark, d):
    return V.with_entities(V.articles(spark, d)).select("doc_id", X.story_fp(F.col("headline"), F.col("entities")).alias("fp"))


@query(f"SELECT story_id, md5(string_agg(fp, '_' ORDER BY fp))[1:16] AS fp FROM (SELECT story_id, md5(trim({BARE.format('title')}, ' '))[1:12] AS fp FROM articles) GROUP BY 1")
def p8_event_fp(spark, d):
    a = V.articles(spark, d).select("story_id", X.title_fp(F.col("title")).alias("fp"))
    return a.groupBy("story_id").agg(X.event_fp(F.collect_list("fp")).alias("fp"))


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'Source One' WHEN 'src2' THEN 'Source Two' ELSE upper(source[1]) || source[2:] END AS source_name FROM articles")
def p9_source_name(spark, d):
    names = spark.createDataFrame([("src1", "Source One"), ("src2", "Source Two")], "source string, name string")
    return A.with_source_name(V.articles(spark, d), names).select("doc_id", "source_name")


@query(f"""SELECT c_custkey, CASE WHEN k IN {vocab.CATEGORIES} THEN k {' '.join(f"WHEN k = '{a}' THEN '{b}'" for a, b in vocab.CATEGORY_ALIASES.items())} ELSE 'world' END AS category
 FROM (SELECT c_custkey, list_extract(['Tech', ' finance', 'Sports', 'general', 'nowhere', 'UK'], cast(c_custkey % 6 + 1 AS int)) AS raw, lower(trim(raw)) AS k FROM customer)""")
def p10_normalize_category(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Tech", " finance", "Sports", "general", "nowhere", "UK")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return V.table(spark, d, "customer").select("c_custkey", X.normalize_category(raw).alias("category"))


_SCORES = {c: " + ".join(f"{w} * len(list_filter({lst(ws)}, lambda k: contains(t, k)))" for x, w, ws in vocab.KEYWORDS if x == c) for c in dict.fromkeys(x for x, _, _ in vocab.KEYWORDS)}
_BEST = "greatest(" + ", ".join(f"100 * ({s}) + {50 - i}" for i, s in enumerate(_SCORES.values())) + ")"
_NAMES = " ".join(f"WHEN {50 - i} THEN '{c}'" for i, c in enumerate(_SCORES))
_SECT = " ".join(f"WHEN regexp_matches(lower(url), '{any_of(m)}') THEN '{n}'" for n, m in vocab.SECTIONS)
LIFE = f"regexp_matches(lower(headline), '{any_pattern(vocab.LIFESTYLE)}')"


@query(f"""SELECT doc_id, CASE WHEN {LIFE} THEN 'lifestyle' {_SECT} WHEN b >= 100 THEN CASE b % 100 {_NAMES} END ELSE 'world' END AS category
 FROM (SELECT *, {_BEST} AS b FROM (SELECT *, lower(headline || ' ' || description) AS t FROM articles))""")
def p11_categorize(spark, d):
    return V.articles(spark, d).select("doc_id", X.categorize(F.col("headline"), F.col("description"), F.col("url")).alias("category"))


_LIGHT = " ".join(f"WHEN regexp_matches(lower(headline || ' ' || description || ' ' || url), '{any_of(w)}') THEN '{n}'" for n, w in vocab.LIGHT_KEYWORDS)


@query(f"SELECT doc_id, CASE WHEN {LIFE} THEN 'lifestyle' WHEN doc_id % 4 = 1 THEN 'technology' WHEN doc_id % 4 = 2 THEN 'sports' {_LIGHT} ELSE 'world' END AS category FROM articles")
def p12_categorize_light(spark, d):
    feed = F.when(F.col("doc_id") % 4 == 1, "tech").when(F.col("doc_id") % 4 == 2, "sports").when(F.col("doc_id") % 4 == 3, "general")
    return V.articles(spark, d).select("doc_id", X.categorize_light(F.col("headline"), F.col("description"), F.col("url"), feed).alias("category"))


def _any(table, col="t"):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({col}, '{any_of(w)}') THEN '{n}' END" for n, w in table) + "], lambda x: x IS NOT NULL)"


_SIG = f"""{ENTITIES}, five AS (SELECT doc_id, list(lower(w) ORDER BY r) FILTER (r <= 5) AS names FROM ents GROUP BY 1),
 sg AS (SELECT doc_id, coalesce(names, []) AS names, v, toks, {_any(vocab.EVENT_TYPES)} AS types, {_any(vocab.SCALES)} AS scale, {_any(vocab.TEMPORAL)} AS temporal FROM (SELECT doc_id, t, toks, list_sort(list_filter(list_transform({lst(vocab.ACTIONS)}, lambda v: {{'p': coalesce(list_position(toks, v), 0), 'v': v}}), lambda x: x.p > 0))[1:3] AS v
 FROM (SELECT doc_id, lower(headline || ' ' || description) AS t, list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS toks FROM articles)) LEFT JOIN five USING (doc_id)),
 sig AS (SELECT *, list_transform(v, lambda x: x.v) AS verbs, round(least(0.4 * len(v) / 3 + 0.3 * least(len(types), 2) / 2 + 0.2 * least(len(scale), 2) / 2, 1.0), 6)::double AS confidence FROM sg),
 sh AS (SELECT *, array_to_string(list_filter([CASE WHEN len(verbs) > 0 THEN 'actions:' || array_to_string(list_sort(verbs), ',') END, CASE WHEN len(types) > 0 THEN 'types:' || array_to_string(list_sort(types), ',') END,
 CASE WHEN len(names) > 0 THEN 'entities:' || array_to_string(list_sort(names[1:2]), ',') END], lambda x: x IS NOT NULL), '|') AS parts FROM sig)"""


@query(f"""{_SIG} SELECT doc_id, array_to_string(verbs, ',') AS verbs, array_to_string(list_transform(v, lambda x: array_to_string(toks[greatest(x.p - 2, 1):x.p + 2], ' ')), '|') AS contexts, array_to_string(types, ',') AS event_types, array_to_string(scale, ',') AS scale,
 array_to_string(temporal, ',') AS temporal, array_to_string(names, ',') AS entities, confidence, md5(CASE WHEN parts = '' THEN 'none' ELSE parts END)[1:12] AS hash FROM sh""")
def p15_event_signature(spark, d):
    s = V.with_entities(V.articles(spark, d)).select("doc_id", X.event_signature(F.col("headline"), F.col("description"), F.col("entities")).alias("s"))
    j = lambda c: F.array_join(c, ",")
    verbs, contexts = F.transform("s.actions", lambda a: a["verb"]), F.transform("s.actions", lambda a: a["context"])
    return s.select("doc_id", j(verbs).alias("verbs"), F.array_join(contexts, "|").alias("contexts"), j("s.event_types").alias("event_types"), j("s.scale").alias("scale"), j("s.temporal").alias("temporal"), j(X.key_names(F.col("s.entities"))).alias("entities"), F.col("s.confidence").alias("confidence"), F.col("s.hash").alias("hash"))


@query(rf"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domain, length(c) AS n_body, md5(c) AS body FROM (SELECT page_id, url, {CLEAN.format('html')} AS c FROM pages)")
def p16_normalize(spark, d):
    """Domains, and the stripped bodies of all pages by length and digest."""
    rows = A.normalize_articles(V.table(spark, d, "pages").withColumnRenamed("html", "text"))
    return rows.select("page_id", "domain", F.length("body").cast("long").alias("n_body"), F.md5(F.col("body").cast("binary")).alias("body"))


_RAW = "CASE turn % 4 WHEN 0 THEN 'Here''s a concise summary: ' || text WHEN 1 THEN text || '. This summary provides facts' WHEN 2 THEN 'Summary: ' || text ELSE text END"


def _conv(spark, d):
    t = F.col("text")
    raw = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Here's a concise summary: "), t)).when(F.col("turn") % 4 == 1, F.concat(t, F.lit(". This summary provides facts"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("Summary: "), t)).otherwise(t)
    return V.table(spark, d, "conversations").select("conv_id", "turn", "text", raw.alias("raw"))


def _fold(c, patterns):
    for p in patterns:
        c = f"trim(regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '', 'i'), ' ')"
    return c


@query(f"SELECT conv_id, turn, {_fold(_fold(f'trim({_RAW}, chr(32))', vocab.SUMMARY_STARTS), vocab.SUMMARY_ENDS)} AS summary FROM conversations")
def p17_clean_summaries(spark, d):
    return _conv(spark, d).select("conv_id", "turn", X.clean_summary(F.col("raw")).alias("summary"))


@query(r"""SELECT doc_id, cleaned, CASE WHEN len(string_split_regex(cleaned, '\s+')) < 4 OR length(cleaned) < 20 THEN 'The headline before' WHEN length(cleaned) > 200 THEN regexp_replace(substr(cleaned, 1, 200), ' [^ ]*$', '') || '...' ELSE cleaned END AS accepted
 FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'Big news' WHEN doc_id % 5 = 4 THEN trim(repeat(headline || ' ', 10)) ELSE headline END AS cleaned FROM articles WHERE NOT regexp_matches(headline, '[''"]$|(?i)(note|reason):'))""")
def p18_clean_headlines(spark, d):
    """Cleaned headlines, and what is accepted of them: short ones leave the headline before, long ones are cut."""
    h = F.col("headline")
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.concat(F.lit('"'), h, F.lit('"'))).when(k == 1, F.concat(F.lit("Updated headline: "), h, F.lit("\nRationale: newer facts"))).when(k == 2, F.concat(h, F.lit(" | Live"))).when(k == 3, "Big news").otherwise(F.repeat(F.concat(h, F.lit(" ")), F.lit(10)))
    rows = V.articles(spark, d).select("doc_id", X.clean_headline(raw).alias("cleaned"))
    return rows.withColumn("accepted", X.accept_headline(F.col("cleaned"), F.lit("The headline before")))


@query(f"SELECT conv_id, turn, regexp_matches(lower(CASE WHEN conv_id % 7 = 0 THEN 'I cannot say. ' || text ELSE text END), '{any_of(vocab.REFUSALS_LIVE)}') AS refused FROM conversations")
def p19_refusals(spark, d):
    t = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("I cannot say. "), F.col("text"))).otherwise(F.col("text"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", X.refusal(t).alias("refused"))


_FALLBACK = f"""SELECT story_id, array_to_string({WORDS.format('s')}[1:100], ' ') AS summary FROM (SELECT story_id, CASE WHEN count(*) = 1 THEN arg_min(headline, doc_id) || '. According to ' || min(source) || ', ' || substr(arg_min(description, doc_id), 1, 300)
 ELSE arg_min(headline, doc_id) || '. Multiple sources including ' || array_to_string(list(source ORDER BY doc_id)[1:3], ', ') || ' are reporting on this story. ' || substr(arg_min(description, doc_id), 1, 300) END AS s FROM articles GROUP BY 1)"""


@query(f" {_FALLBACK}")
def p20_fallback_summary(spark, d):
    return A.fallback_summary(V.stories(spark, d), V.articles(spark, d))


@query(""", m AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY doc_id) AS r FROM articles) SELECT story_id, CASE WHEN count(*) = 1 THEN 'single' ELSE 'multi' END AS template,
 md5(string_agg('Source ' || r || ': ' || source || chr(10) || 'Title: ' || headline || chr(10) || 'Content: ' || substr(text, 1, 1000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r)) AS prompt FROM m WHERE r <= 6 GROUP BY 1""")
def p21_summary_requests(spark, d):
    return A.summary_requests(V.articles(spark, d)).withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


@query("""SELECT story_id, CASE WHEN story_id % 2 = 0 THEN 'Short facts of ' || story_id ELSE 'plain answer here' END AS summary, CASE WHEN story_id % 2 = 0 THEN 'health' ELSE category END AS category, cast(2 AS int) AS version,
 cast(CASE WHEN story_id % 2 = 0 THEN 4 ELSE 3 END AS int) AS words FROM stories""")
def p22_apply_summaries(spark, d):
    s = V.stories(spark, d).withColumn("version", F.lit(1))
    json = F.concat(F.lit('```json\n{"summary": "Short facts of '), F.col("story_id").cast("string"), F.lit('", "category": "health"}\n```'))
    r = s.select("story_id", F.when(F.col("story_id") % 2 == 0, json).otherwise(F.lit("plain answer here")).alias("response"))
    return A.apply_summaries(s, r)


@query("""SELECT l_orderkey, l_linenumber, ((l_extendedprice - l_quantity) * a + l_quantity * b + l_suppkey * c) / 1e6 / (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS cost
 FROM lineitem JOIN (VALUES ('O', 3.0::double, 0.3::double, 15.0::double), ('F', 1.0::double, 0.1::double, 5.0::double)) p(m, a, b, c) ON l_linestatus = m""")
def p23_cost(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("model"), F.col("l_extendedprice").alias("tokens_in"), F.col("l_quantity").alias("cached"), F.col("l_suppkey").alias("tokens_out"), (F.col("l_returnflag") == "R").alias("batch"))
    prices = spark.createDataFrame([("O", 3.0, 0.3, 15.0), ("F", 1.0, 0.1, 5.0)], "model string, a double, b double, c double")
    return A.with_cost(rows, prices).select("l_orderkey", "l_linenumber", "cost")


@query(f"""SELECT story_id, cast(source_count AS int) AS unique_sources, CASE WHEN length(coalesce(summary, '')) > 0 THEN 'available' WHEN epoch({T}) - epoch(first_seen) < 180 THEN 'generating' ELSE 'absent' END AS summary_state,
 (SELECT array_to_string(list_sort(list_distinct(list(source))), ',') FROM articles a WHERE a.story_id = stories.story_id) AS sources FROM stories""")
def p25_story_detail(spark, d):
    rows = A.story_detail(V.stories(spark, d), V.members(spark, d), V.asof())
    return rows.select("story_id", "unique_sources", "summary_state", F.array_join("sources", ",").alias("sources"))


_STATUS = "CASE WHEN source_count >= 5 THEN 'TOP_STORY' WHEN source_count >= 3 THEN 'VERIFIED' WHEN source_count = 2 THEN 'DEVELOPING' ELSE 'NEW' END"


@query("SELECT story_id, title, category, summary, source_count, first_seen, last_updated, importance, breaking FROM stories")
def p24_feed_columns(spark, d):
    """Stories with their centroids, as a feed reads them: without."""
    v = V.vectors(spark, d).select("story_id", F.col("embedding").alias("centroid")).dropDuplicates(["story_id"])
    return A.feed_columns(V.stories(spark, d).join(v, "story_id", "left"))


@query(f"""SELECT s.story_id, s.title, s.category, cast(greatest(1, len({WORDS.format("coalesce(summary, '')")}) // 200) AS int) AS minutes, {_STATUS} AS status, round(least(source_count, 10) / 10, 6) AS credibility, round(CASE WHEN breaking THEN 0.9 ELSE importance / 10 END, 6) AS trending, coalesce(u.url, 'https://news.example/unavailable') AS url
 FROM stories s LEFT JOIN (SELECT story_id, arg_min(url, doc_id) AS url FROM articles WHERE doc_id % 4 >= 2 GROUP BY 1) u ON u.story_id = s.story_id""")
def p26_client_view(spark, d):
    """Addresses of some sources are empty or have no scheme."""
    k = F.col("doc_id") % 4
    url = F.when(k == 0, "").when(k == 1, F.regexp_replace("url", "^https://", "")).otherwise(F.col("url"))
    return A.client_view(V.stories(spark, d), V.articles(spark, d).select("story_id", url.alias("url"), F.col("doc_id").alias("place")), "https://news.example/unavailable")


@query(f"""SELECT story_id, epoch(last_updated) - epoch(first_seen) >= 1800 AS updated, CASE WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END AS age,
 trim(regexp_replace(coalesce(summary, ''), '^#+\\s*', ''), ' ') AS shown FROM (SELECT *, cast(floor((epoch({T}) - epoch(first_seen)) / 60) AS bigint) AS m FROM stories WHERE first_seen <= {T})""")
def p27_display(spark, d):
    s = V.stories(spark, d).filter(F.col("first_seen") <= V.asof())
    return A.display_columns(s, V.asof()).select("story_id", "updated", "age", "shown")


@query("SELECT story_id, CASE WHEN source_count >= 5 THEN 'TOP_STORY' WHEN source_count >= 3 THEN 'VERIFIED' WHEN source_count = 2 THEN 'DEVELOPING' ELSE 'NEW' END AS status FROM stories")
def p28_status(spark, d):
    return A.with_status(V.stories(spark, d)).select("story_id", "status")


@query("SELECT md5(cast(cast(epoch(max(last_updated)) AS bigint) AS varchar) || '|category=world|limit=20') AS etag FROM stories")
def p30_etag(spark, d):
    return A.etag(V.stories(spark, d), {"limit": "20", "category": "world"})


@query("SELECT doc_id, trim(headline || ' ' || substr(description, 1, 500), ' ') AS embedding_text FROM articles")
def p31_embedding_text(spark, d):
    return A.embedding_text(V.articles(spark, d)).select("doc_id", "embedding_text")


@query(""", e AS (SELECT a.vec_id, unnest(a.embedding)::double AS x, unnest(b.embedding)::double AS y, generate_subscripts(a.embedding, 1) AS i FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), z AS (SELECT *, 0.7 * x + 0.3 * y AS b FROM e),
 n AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 1.0 ELSE sqrt(sum(b * b)) END AS n FROM z GROUP BY 1) SELECT vec_id, max(CASE WHEN i = 1 THEN v END) AS x0, max(CASE WHEN i = 64 THEN v END) AS x63 FROM (SELECT vec_id, i, round(CASE WHEN vec_id % 4 = 0 THEN x ELSE b / n END, 5) AS v FROM z JOIN n USING (vec_id)) GROUP BY 1""")
def p31_blend_vectors(spark, d):
    """Each vector blended with the next one's, which stands for its entities'; one in four has none."""
    v = V.vectors(spark, d)
    names = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("entity_vector"))
    rows = v.select("vec_id", F.col("embedding").alias("text_vector")).join(names, "vec_id").withColumn("entity_vector", F.when(F.col("vec_id") % 4 != 0, F.col("entity_vector")))
    out = A.blend_vectors(rows)
    return out.select("vec_id", F.round(F.col("embedding")[0], 5).alias("x0"), F.round(F.col("embedding")[63], 5).alias("x63"))


_CAP = f"{WORDS.format('trim(headline)')}"
_PROMO = f"""(regexp_matches(t, '{any_of(vocab.PROMO_PHRASES)}') OR regexp_matches(t, '{any_pattern(vocab.PROMO_PATTERNS)}') OR regexp_matches(lower(url), '{any_of(vocab.PROMO_URLS)}') OR regexp_matches(lower(headline), '^the \\d+ best .* to (?:shop|buy)')
 OR (len({_CAP}) <= 4 AND len(list_filter({_CAP}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) * 10 >= len({_CAP}) * 7 AND (regexp_matches(t, '{any_of(vocab.DINING)}') OR regexp_matches(lower(url), '{any_of(vocab.DINING_URLS)}')
 OR (regexp_matches(lower(url), '{any_of(vocab.VENUE_URLS)}') AND NOT regexp_matches(lower(headline), '{any_of(vocab.NEWS_WORDS)}')))))"""


@query(f"SELECT doc_id FROM (SELECT *, lower(headline || ' ' || description) AS t FROM articles) WHERE NOT {_PROMO}")
def f1_drop_promotional(spark, d):
    return A.drop_promotional(V.articles(spark, d)).select("doc_id")


@query(f"SELECT doc_id FROM articles WHERE NOT regexp_matches(lower(headline || ' ' || description || ' ' || url), '{any_of(vocab.PROMO_LIGHT)}')")
def f2_drop_promotional_light(spark, d):
    return A.drop_promotional_light(V.articles(spark, d)).select("doc_id")


@query("SELECT pattern, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(title), '{p.replace(chr(39), chr(39) * 2)}') THEN '{p.replace(chr(39), chr(39) * 2)}' END" for p in (*vocab.PROMO_PHRASES, *vocab.PROMO_PATTERNS)) + "], lambda x: x IS NOT NULL)) AS pattern FROM stories) GROUP BY 1")
def f3_promotional_sweep(spark, d):
    return A.promotional_sweep(V.stories(spark, d))[0]


@query(""", m AS (SELECT story_id, count(*) AS n, count(*) FILTER (regexp_matches(lower(source), 'test|example|dummy|src1$')) AS t FROM articles GROUP BY 1)
 SELECT story_id, reason FROM (SELECT story_id, CASE WHEN regexp_matches(lower(title), '\\btest\\b|lorem ipsum|example story') THEN 'title' WHEN t * 2 > n THEN 'sources' WHEN n > 100 THEN 'count' END AS reason FROM stories JOIN m USING (story_id)) WHERE reason IS NOT NULL""")
def f4_test_stories(spark, d):
    return A.flag_test_stories(V.stories(spark, d), V.members(spark, d))


@query(f"SELECT story_id FROM stories WHERE last_updated >= {T} - INTERVAL 2 DAY AND category NOT IN ('lifestyle', 'entertainment') AND source_count >= 2")
def f5_visible(spark, d):
    return A.visible_stories(V.stories(spark, d), "top_stories", V.asof()).select("story_id")


@query(f"SELECT story_id FROM stories WHERE length(coalesce(summary, '')) = 0 AND source_count >= 1 AND story_id % 5 <> 0 AND last_updated >= {T} - INTERVAL 24 HOUR ORDER BY last_updated DESC, story_id LIMIT 50")
def f8_needs_summary(spark, d):
    s = A.with_status(V.stories(spark, d))
    watched = s.withColumn("status", F.when(F.col("story_id") % 5 == 0, "MONITORING").otherwise(F.col("status")))
    return A.needs_summary(watched, V.asof(), 24, 50).select("story_id")


@query(f"""SELECT doc_id FROM articles WHERE processed AND (epoch({T}) - epoch(published_at)) // 86400 <= 7 AND (doc_id NOT IN (SELECT vec_id FROM embeddings) OR doc_id % 3 = 0 OR (doc_id % 7 = 0 AND doc_id % 100 >= 30) OR doc_id % 11 = 0)""")
def f9_needs_enrichment(spark, d):
    """Of the articles, one in three isn't linked, one in seven has no signature (at a confidence of its last two digits), one in eleven no places."""
    k = F.col("doc_id")
    a = V.articles(spark, d).withColumns({"signature": F.when(k % 7 != 0, "s"), "confidence": (k % 100) / 100, "places": F.when(k % 11 != 0, F.array(F.lit("p")))})
    return A.needs_enrichment(a, V.asof(), V.vectors(spark, d), a.filter(k % 3 != 0).select("doc_id"), 0.3, True).select("doc_id")


@query("""SELECT story_id, issues FROM (SELECT story_id, array_to_string(list_concat(list_filter([CASE WHEN t IS NULL THEN 'no title' END, CASE WHEN c IS NULL THEN 'no category' END, CASE WHEN story_id % 6 = 3 THEN 'no time' END, CASE WHEN length(trim(coalesce(t, ''))) < 10 THEN 'short title' END, CASE WHEN length(coalesce(t, '')) > 200 THEN 'long title' END,
 CASE WHEN n = 0 THEN 'no sources' END, CASE WHEN n > 20 THEN 'many sources' END, CASE WHEN c NOT IN CATS THEN 'unknown category' END, CASE WHEN story_id % 6 IN (1, 2) THEN 'bad time' END], lambda x: x IS NOT NULL),
 CASE WHEN n BETWEEN 1 AND 20 AND story_id % 9 = 4 THEN ['source 0 lacks a field'] WHEN n BETWEEN 1 AND 20 AND story_id % 9 = 5 THEN ['source ' || (n - 1) || ' is nothing'] ELSE [] END), ',') AS issues FROM (SELECT story_id, CASE story_id % 8 WHEN 1 THEN NULL WHEN 2 THEN 'Short' WHEN 3 THEN repeat(title, 20) ELSE title END AS t,
 CASE story_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'nowhere' WHEN 3 THEN 'us' ELSE category END AS c, CASE story_id % 7 WHEN 1 THEN 0 WHEN 2 THEN 21 ELSE source_count + (story_id % 9 = 5)::int END AS n FROM stories)) WHERE issues <> ''""".replace("CATS", str((*vocab.CATEGORIES, "us"))))
def f10_validate(spark, d):
    """Stories, some of them spoilt by their number: titles, categories, times, lists of sources and sources."""
    k = F.col("story_id")
    source = F.struct(F.col("source"), F.when((k % 9 == 4) & (F.col("source") == F.min("source").over(Window.partitionBy("story_id"))), None).otherwise(F.col("headline")).alias("title"))
    listed = V.members(spark, d).filter("source is not null").withColumn("s", source).groupBy("story_id").agg(F.sort_array(F.collect_set("s")).alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | (x["source"] != F.col("all")[i - 1]["source"]))
    s = V.stories(spark, d).join(listed.select("story_id", first.alias("own")), "story_id")
    title = F.when(k % 8 == 1, None).when(k % 8 == 2, "Short").when(k % 8 == 3, F.repeat("title", F.lit(20))).otherwise(F.col("title"))
    category = F.when(k % 5 == 1, None).when(k % 5 == 2, "nowhere").when(k % 5 == 3, "us").otherwise(F.col("category"))
    time = F.when(k % 6 == 1, "soon").when(k % 6 == 2, "2024-13-01T00:00:00Z").when(k % 6 == 3, None).otherwise(F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    none = F.array().cast("array<struct<source:string,title:string>>")
    own = F.when(k % 9 == 5, F.concat("own", F.array(F.lit(None).cast("struct<source:string,title:string>")))).otherwise(F.col("own"))
    many = F.array_repeat(F.struct(F.lit("x").alias("source"), F.lit("y").alias("title")), 21)
    sources = F.when(k % 7 == 1, none).when(k % 7 == 2, many).otherwise(own)
    return A.validate_stories(s.withColumns({"title": title, "category": category, "last_updated": time, "sources": sources})).withColumn("issues", F.array_join("issues", ","))


@query(f"SELECT f.feed FROM feeds f LEFT JOIN (SELECT feed, max(ts) AS p FROM fetch_log WHERE ts <= {T} GROUP BY 1) s USING (feed) WHERE p IS NULL OR floor(epoch({T})) - floor(epoch(p)) >= 21600")
def f11_ready_feeds(spark, d):
    log = V.fetch_log(spark, d).filter(F.col("ts") <= V.asof())
    return A.ready_feeds(V.feeds(spark, d), log.groupBy("feed").agg(F.max("ts").alias("last_poll")), V.asof(), 21600).select("feed")


_P = ", prs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.headline AS h, b.headline AS g FROM articles a JOIN articles b ON b.doc_id = a.doc_id + 7)"


def pairs(spark, d):
    a = V.articles(spark, d)
    return a.select(F.col("doc_id").alias("x"), F.col("headline").alias("h")).join(a.select((F.col("doc_id") - 7).alias("x"), F.col("doc_id").alias("y"), F.col("headline").alias("g")), "x")


def _key(c):
    return f"list_filter({WORDS.format(f'lower({c})')}, lambda w: length(w) > 3 AND w NOT IN {vocab.STOP_TITLE})"


def _prop(c):
    return f"list_distinct(list_filter({WORDS.format(c)}, lambda w: length(w) > 3 AND regexp_matches(w, '^\\p{{Lu}}')))"


#: sm (x, y, similarity) of prs (x, y, h, g).
SIM = f""", sm AS (SELECT x, y, round(CASE WHEN len(kh) = 0 OR len(kg) = 0 THEN jac ELSE 0.40 * len(list_filter(kh, lambda w: list_contains(kg, w))) / least(len(kh), len(kg))
 + CASE WHEN len(ph) > 0 AND len(pg) > 0 THEN 0.40 * len(list_intersect(ph, pg)) / least(len(ph), len(pg)) ELSE 0 END
 + 0.15 * (len(list_filter(kh, lambda w: length(w) > 4 AND contains(lower(g), w))) + len(list_filter(kg, lambda w: length(w) > 4 AND contains(lower(h), w)))) / (len(kh) + len(kg)) + 0.05 * jac END, 6) AS similarity
 FROM (SELECT *, {_key('h')} AS kh, {_key('g')} AS kg, {_prop('h')} AS ph, {_prop('g')} AS pg, len(list_intersect(th, tg)) / len(list_distinct(list_concat(th, tg))) AS jac FROM (SELECT *, list_distinct({WORDS.format('lower(h)')}) AS th, list_distinct({WORDS.format('lower(g)')}) AS tg FROM prs)))"""


@query(f"{_P}{SIM} SELECT x, y, similarity FROM sm")
def e3_title_similarity(spark, d):
    return pairs(spark, d).select("x", "y", F.round(Z.title_similarity(F.col("h"), F.col("g")), 6).alias("similarity"))


@query(f"""{_P} SELECT x, y, len(p) > 0 AND len(q) > 0 AND len(list_intersect(p, q)) = 0 AND len(list_filter(p, lambda v: v NOT IN ('disaster', 'weather'))) > 0 AND len(list_filter(q, lambda v: v NOT IN ('disaster', 'weather'))) > 0 AS conflict
 FROM (SELECT x, y, {_any(vocab.TOPICS, 'lower(h)')} AS p, {_any(vocab.TOPICS, 'lower(g)')} AS q FROM prs)""")
def e4_topic_conflict(spark, d):
    return pairs(spark, d).select("x", "y", Z.topic_conflict(F.col("h"), F.col("g")).alias("conflict"))


JAC = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@query(f"{_SIG} SELECT a.doc_id, round(0.4 * ({JAC.format('a.verbs', 'b.verbs')}) + 0.3 * ({JAC.format('a.types', 'b.types')}) + 0.3 * ({JAC.format('list_distinct(a.names)', 'list_distinct(b.names)')}), 6)::double AS similarity FROM sig a JOIN sig b ON b.doc_id = a.doc_id + 7")
def e12_signature_similarity(spark, d):
    a = V.with_entities(V.articles(spark, d)).select("doc_id", X.event_signature(F.col("headline"), F.col("description"), F.col("entities")).alias("s"))
    b = a.select((F.col("doc_id") - 7).alias("doc_id"), F.col("s").alias("t"))
    return a.join(b, "doc_id").select("doc_id", F.round(Z.signature_similarity(F.col("s"), F.col("t")), 6).alias("similarity"))


@query(f"""{ENTITIES}, loc AS (SELECT doc_id, list(DISTINCT lower(w)) AS l FROM ents WHERE type = 'LOCATION' GROUP BY 1) SELECT p.x, p.y, CASE WHEN len(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))) = 0 THEN 0.0
 ELSE round(len(list_intersect(coalesce(a.l, []), coalesce(b.l, []))) / len(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))), 6) END AS similarity
 FROM (SELECT a.doc_id AS x, b.doc_id AS y FROM articles a JOIN articles b ON b.doc_id = a.doc_id + 30) p LEFT JOIN loc a ON a.doc_id = p.x LEFT JOIN loc b ON b.doc_id = p.y""")
def e13_geo_similarity(spark, d):
    a = V.with_entities(V.articles(spark, d)).select(F.col("doc_id").alias("x"), "entities")
    b = a.select(F.col("x").alias("y"), F.col("entities").alias("other")).withColumn("x", F.col("y") - 30)
    return a.join(b, "x").select("x", "y", F.round(Z.geo_similarity(F.col("entities"), F.col("other")), 6).alias("similarity"))
