"""Column functions over text. All are null-safe where the docstring says so and stay in the JVM, but for decode_entities."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, taken literally."""
    return "(?:" + "|".join(re.sub(r"([.+*?()\[\]{}|^$\\/])", r"\\\1", w) for w in words) + ")"


def any_pattern(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def words(c: Column) -> Column:
    """White-space-separated words; none for an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


@F.pandas_udf(T.StringType())
def _unescape(s):
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def decode_entities(c: Column) -> Column:
    """All named and numeric entities. Rows without an ampersand never leave the JVM's fast path in meaning: they come back as they were."""
    return F.when(c.contains("&"), _unescape(c)).otherwise(c)


def clean_text(c: Column, decode: bool = True) -> Column:
    """Tags out, entities decoded, white space collapsed; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(decode_entities(bare) if decode else bare, r"\s+", " "))


def truncate_words(c: Column, n: int) -> Column:
    """At most n characters, cut at the last space, with an ellipsis; a text with no space in its head is cut at n."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("...")))


def article_id(source: Column, url: Column, published: Column) -> Column:
    return F.concat_ws("_", source, F.date_format(published, "yyyyMMdd"), F.substring(F.md5(url.cast("binary")), 1, 8))


def bare(c: Column) -> Column:
    """Lower case without punctuation; letters and digits of all scripts stay."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")


def title_fp(title: Column) -> Column:
    return F.substring(F.md5(F.trim(bare(title)).cast("binary")), 1, 12)


def _lits(xs: Iterable[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def entities(text: Column) -> Column:
    """array<struct<text, type>>: capitalised words of three characters or more, distinct, the first twenty."""
    capital = F.filter(words(text), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 2))
    place = _lits(vocab.COUNTRIES)
    bare_ = F.transform(capital, lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", ""))
    typed = F.transform(bare_, lambda w: F.struct(w.alias("text"), F.when(F.array_contains(place, w) | w.endswith("land") | w.endswith("stan"), "LOCATION").otherwise("ORGANIZATION").alias("type")))
    return F.slice(F.array_distinct(typed), 1, 20)


def story_fp(title: Column, found: Column) -> Column:
    """Eight hex digits over six key words and three entities, organisations and persons before places."""
    ws = F.filter(F.split(F.trim(bare(title)), r"\s+"), lambda w: F.length(w) > 3)
    content = F.filter(ws, lambda w: ~F.array_contains(_lits(vocab.STOP_FINGERPRINT), w))
    key = F.slice(F.filter(content, lambda w: ~F.array_contains(_lits(vocab.GENERIC_VERBS), w)), 1, 6)
    named = F.filter(found, lambda e: e["type"].isin("PERSON", "ORGANIZATION", "LOCATION"))
    people = F.reverse(F.transform(F.filter(named, lambda e: e["type"] != "LOCATION"), lambda e: F.lower(e["text"])))
    places = F.transform(F.filter(named, lambda e: e["type"] == "LOCATION"), lambda e: F.lower(e["text"]))
    three = F.slice(F.concat(people, places, F.transform(named, lambda e: F.lower(e["text"]))), 1, 3)
    terms = F.array_union(key, three)
    terms = F.when(F.size(terms) < 3, F.array_union(F.slice(content, 1, 5), three)).otherwise(terms)
    return F.substring(F.md5(F.array_join(F.array_sort(terms), "_").cast("binary")), 1, 8)


def event_fp(fps: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(fps), "_").cast("binary")), 1, 16)


def normalize_category(c: Column) -> Column:
    low = F.lower(F.trim(c))
    known = F.when(low.isin(*vocab.CATEGORIES), low)
    alias = reduce(lambda acc, kv: acc.when(low == kv[0], kv[1]), list(vocab.CATEGORY_ALIASES.items())[1:], F.when(low == next(iter(vocab.CATEGORY_ALIASES)), next(iter(vocab.CATEGORY_ALIASES.values()))))
    return F.coalesce(known, alias, F.lit(vocab.DEFAULT_CATEGORY))


def lifestyle(title: Column) -> Column:
    return F.lower(title).rlike(any_pattern(vocab.LIFESTYLE))


def keyword_score(text: Column, keywords, category: str) -> Column:
    parts = [F.size(F.filter(_lits(ws), lambda w: F.contains(text, w))) * weight for c, weight, ws in keywords if c == category]
    return reduce(lambda a, b: a + b, parts)


def categorize(title: Column, description: Column, url: Column, keywords=vocab.KEYWORDS) -> Column:
    """Lifestyle titles, then URL sections, then the best keyword score (first declared of equals), then the default."""
    low = F.lower(url)
    names = list(dict.fromkeys(c for c, _, _ in keywords))

    def best(text: Column) -> Column:
        ranked = [F.struct(keyword_score(text, keywords, c).alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(names)]
        return F.greatest(*ranked)

    out = F.when(lifestyle(title), "lifestyle")
    for name, marks in vocab.SECTIONS:
        out = out.when(low.rlike(any_of(marks)), name)
    # The text is lowered once and scored once a row.
    scored = let(let(F.lower(F.concat_ws(" ", title, description)), best), lambda b: F.when(b["s"] > 0, b["c"]).otherwise(vocab.DEFAULT_CATEGORY))
    return out.otherwise(scored)


def categorize_light(title: Column, description: Column, url: Column, feed_category: Column) -> Column:
    """Lifestyle titles, then the feed's own category, then five keyword groups in order."""
    text = F.lower(F.concat_ws(" ", title, description, url))
    out = F.when(lifestyle(title), "lifestyle").when(feed_category.isNotNull() & ~feed_category.isin("", "general", "unknown"), F.when(feed_category == "tech", "technology").otherwise(feed_category))
    for name, ws in vocab.LIGHT_KEYWORDS:
        out = out.when(text.rlike(any_of(ws)), name)
    return out.otherwise(vocab.DEFAULT_CATEGORY)


def promotional(title: Column, description: Column, url: Column) -> Column:
    text, low = F.lower(F.concat_ws(" ", title, description)), F.lower(url)
    ws = words(F.trim(title))
    capital = F.size(F.filter(ws, lambda w: w.rlike(r"^\p{Lu}")))
    guide = low.rlike(any_of(vocab.VENUE_URLS)) & ~F.lower(title).rlike(any_of(vocab.NEWS_WORDS))
    venue = (F.size(ws) <= 4) & (capital * 10 >= F.size(ws) * 7) & (text.rlike(any_of(vocab.DINING)) | low.rlike(any_of(vocab.DINING_URLS)) | guide)
    return text.rlike(any_of(vocab.PROMO_PHRASES)) | text.rlike(any_pattern(vocab.PROMO_PATTERNS)) | low.rlike(any_of(vocab.PROMO_URLS)) | F.lower(title).rlike(r"^the \d+ best .* to (?:shop|buy)") | venue


def promotional_light(title: Column, description: Column, url: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, description, url)).rlike(any_of(vocab.PROMO_LIGHT))


def _names(text: Column, table) -> Column:
    """Names whose any word occurs in text, in order of declaration."""
    return F.filter(F.array(*[F.when(text.rlike(any_of(ws)), F.lit(n)) for n, ws in table]), lambda x: x.isNotNull())


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def key_entities(found: Column) -> Column:
    """array<struct<text, type, priority>>: the five entities of the highest priority, of equals the first."""
    kind = lambda e: F.when(e["type"] == "PERSON", 3).when(e["type"].isin("ORGANIZATION", "LOCATION"), 2).when(e["type"] == "EVENT", 1).otherwise(0)
    ranked = F.array_sort(F.transform(found, lambda e, i: F.struct((-kind(e)).alias("p"), i.alias("i"), e["text"].alias("text"), e["type"].alias("type"))))
    return F.transform(F.slice(ranked, 1, 5), lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), (-x["p"]).alias("priority")))


def key_names(five: Column) -> Column:
    """The names, in lower case, of those key entities that are persons, organisations or places."""
    return F.transform(F.filter(five, lambda e: e["priority"] >= 2), lambda e: F.lower(e["text"]))


def event_signature(title: Column, description: Column, found: Column) -> Column:
    """struct: up to three verbs by first place with their context, event types, scale, temporal, key entities, confidence, hash."""
    verbs = _lits(vocab.ACTIONS)

    def found_in(x: Column) -> Column:
        text = x["text"]
        three = F.slice(F.array_intersect(x["toks"], verbs), 1, 3)  # in order of their first place
        return F.struct(x["toks"].alias("toks"), x["five"].alias("five"), three.alias("three"), _names(text, vocab.EVENT_TYPES).alias("types"), _names(text, vocab.SCALES).alias("scale"), _names(text, vocab.TEMPORAL).alias("when"))

    def made(x: Column) -> Column:
        toks, five, three, types, scale, when = (x[c] for c in ("toks", "five", "three", "types", "scale", "when"))
        at = lambda v: F.array_position(toks, v).cast("int")
        actions = F.transform(three, lambda v: F.struct(v.alias("verb"), F.array_join(F.slice(toks, F.greatest(at(v) - 2, F.lit(1)), at(v) + 3 - F.greatest(at(v) - 2, F.lit(1))), " ").alias("context"), (at(v) - 1).cast("long").alias("position")))
        sure = 0.4 * F.size(three) / 3 + 0.3 * F.least(F.size(types), F.lit(2)) / 2 + 0.2 * F.least(F.size(scale), F.lit(2)) / 2
        part = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name + ":"), F.array_join(F.array_sort(xs), ",")))
        joined = F.concat_ws("|", part("actions", three), part("types", types), part("entities", key_names(F.slice(five, 1, 2))))
        hashed = F.substring(F.md5(F.when(joined == "", "none").otherwise(joined).cast("binary")), 1, 12)
        return F.struct(actions.alias("actions"), types.alias("event_types"), scale.alias("scale"), when.alias("temporal"), five.alias("entities"), F.round(F.least(sure, F.lit(1.0)), 6).alias("confidence"), hashed.alias("hash"))

    text = F.lower(F.concat_ws(" ", title, description))
    with_words = lambda t: F.struct(t.alias("text"), F.filter(F.split(t, r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("toks"), key_entities(found).alias("five"))
    return let(let(let(text, with_words), found_in), made)


def _fold(c: Column, patterns: Iterable[str]) -> Column:
    for p in patterns:
        c = F.trim(F.regexp_replace(c, f"(?i){p}", ""))
    return c


def clean_summary(c: Column) -> Column:
    """Lead-in and closing remarks about the summary itself removed."""
    return _fold(_fold(F.trim(c), vocab.SUMMARY_STARTS), vocab.SUMMARY_ENDS)


def clean_headline(c: Column) -> Column:
    """What precedes a rationale, its first line, without prefixes, quotes and tags."""
    out = F.trim(F.regexp_replace(F.trim(c), f"(?is){any_of(vocab.HEADLINE_CUTS)}.*$", ""))
    out = F.trim(F.regexp_replace(out, r"(?s)\n.*$", ""))
    out = _fold(out, vocab.HEADLINE_STARTS)
    out = F.trim(F.regexp_replace(out, r"^\"(.*)\"$|^'(.*)'$", "$1$2"))
    return _fold(F.trim(F.regexp_replace(out, r"\"+$|'+$", "")), vocab.HEADLINE_TAGS)


def accept_headline(new: Column, old: Column) -> Column:
    """new where it has four words and twenty characters or more, cut to 200; else old."""
    return F.when((F.size(words(new)) < 4) | (F.length(new) < 20), old).when(F.length(new) > 200, F.concat(F.regexp_replace(F.substring(new, 1, 200), r" [^ ]*$", ""), F.lit("..."))).otherwise(new)


def refusal(c: Column, live: bool = True) -> Column:
    return F.coalesce(F.lower(c).rlike(any_of(vocab.REFUSALS_LIVE if live else vocab.REFUSALS)), F.lit(False))
