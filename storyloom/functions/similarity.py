"""Similarities as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import _lits, _names, key_names, words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, of another length, or zero."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def token_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def _proper(c: Column, lower: bool = False) -> Column:
    out = F.filter(words(c), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}"))
    return F.array_distinct(F.transform(out, F.lower) if lower else out)


def shared_proper(a: Column, b: Column) -> Column:
    """Capitalised words of four characters or more that both titles have, whatever their case."""
    return F.size(F.array_intersect(_proper(a, True), _proper(b, True)))


def title_parts(c: Column) -> Column:
    """What title_similarity compares of a title; a title that meets many others has it made once."""
    low, stop = F.lower(c), _lits(vocab.STOP_TITLE)
    key = F.filter(words(low), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))
    return F.struct(low.alias("low"), key.alias("key"), F.filter(key, lambda w: F.length(w) > 4).alias("long"), _proper(c).alias("proper"), token_set(c).alias("set"))


def similarity_of_parts(p: Column, q: Column) -> Column:
    """title_similarity of two titles by their title_parts."""
    sets = jaccard(p["set"], q["set"])
    ka, kb, pa, pb = p["key"], q["key"], p["proper"], q["proper"]
    match = F.size(F.filter(ka, lambda w: F.array_contains(kb, w))) / F.least(F.size(ka), F.size(kb))
    proper = F.when((F.size(pa) > 0) & (F.size(pb) > 0), F.size(F.array_intersect(pa, pb)) / F.least(F.size(pa), F.size(pb))).otherwise(F.lit(0.0))
    inside = lambda ks, t: F.size(F.filter(ks, lambda w: F.contains(t, w)))
    sub = (inside(p["long"], q["low"]) + inside(q["long"], p["low"])) / (F.size(ka) + F.size(kb))
    w = vocab.TITLE_WEIGHTS
    full = match * w["keywords"] + proper * w["proper"] + sub * w["substring"] + sets * w["jaccard"]
    return F.when((F.size(p["set"]) == 0) | (F.size(q["set"]) == 0), F.lit(0.0)).when((F.size(ka) == 0) | (F.size(kb) == 0), sets).otherwise(full)


def title_similarity(a: Column, b: Column) -> Column:
    """Weighted key words, proper nouns, substrings and word sets; 0 for an empty title, the word sets alone without key words."""
    return similarity_of_parts(title_parts(a), title_parts(b))


def topics(title: Column) -> Column:
    return _names(F.lower(title), vocab.TOPICS)


def topic_conflict(a: Column, b: Column) -> Column:
    """True where both titles have topics, share none, and the conflict isn't one of weather or disaster."""
    x, y = topics(a), topics(b)
    soft = _lits(("disaster", "weather"))
    hard = (F.size(F.array_except(x, soft)) > 0) & (F.size(F.array_except(y, soft)) > 0)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y) & hard


def signature_similarity(a: Column, b: Column) -> Column:
    """0.4 verbs + 0.3 event types + 0.3 key entities, each a set ratio; 0 where a signature is missing."""
    verbs = lambda s: F.transform(s["actions"], lambda x: x["verb"])
    names = lambda s: F.array_distinct(key_names(s["entities"]))
    score = 0.4 * jaccard(verbs(a), verbs(b)) + 0.3 * jaccard(a["event_types"], b["event_types"]) + 0.3 * jaccard(names(a), names(b))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(score)


def geo_similarity(a: Column, b: Column) -> Column:
    """Set ratio of two entity arrays' locations."""
    place = lambda e: F.array_distinct(F.transform(F.filter(e, lambda x: x["type"] == "LOCATION"), lambda x: F.lower(x["text"])))
    return jaccard(place(a), place(b))


def weighted(parts: dict[str, float], get) -> Column:
    return reduce(lambda x, y: x + y, [get(k) * w for k, w in parts.items()])
