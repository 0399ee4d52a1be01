"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Spans come from the regular expressions themselves: split() gives what stands between the matches and
regexp_extract_all() the matches, so the running sum of both lengths is every match's place in code points.

A candidate's value is hashed, and hashes are counted over the distinct repositories and owners that hold them. A value
in many places is an example that people copy; one that a single owner has looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name

#: kind -> (pattern, least characters of what counts, does the last group count instead of the whole).
_VALUE = "[A-Za-z0-9+/_.=-]+"
_WORDS = ("[pP][aA][sS][sS][wW][oO][rR][dD]", "[pP][aA][sS][sS][wW][dD]", "[sS][eE][cC][rR][eE][tT]", "[tT][oO][kK][eE][nN]", "[aA][pP][iI]_?[kK][eE][yY]")
ASSIGN = f"(?:{'|'.join(_WORDS)})[\"']?\\x20*[:=]\\x20*[\"']?({_VALUE})"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
#: What the method looks at besides: long runs with a digit, an upper-case and a lower-case letter.
OPAQUE = "[A-Za-z0-9+/_=-]{20,}"
ORDER = {"assign": 0, "access": 1, "hex": 2, "opaque": 3}
#: A value that at most this many owners hold, in at most this many repositories, looks live.
MOST_OWNERS, MOST_REPOSITORIES = 1, 1
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
JUDGED = SPANS[:-2] + ",owners:bigint,repositories:bigint,live:boolean>>"


def _spans(text: Column, kind: str, pattern: str, value: str, least: int) -> Column:
    """Spans of the leftmost, non-overlapping matches whose value has at least `least` characters."""
    none = F.array().cast(SPANS)
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + F.length(x["piece"])
            e = s + F.length(x["hit"])
            v = F.regexp_extract(x["hit"], value, 1)
            span = F.struct(s.alias("start"), F.lit(ORDER[kind]).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), v.alias("value"))
            return F.struct(e.alias("at"), F.when(F.length(v) >= least, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return F.aggregate(both, start, step, lambda a: a["out"])

    both = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("hit")))
    return F.when(text.rlike(pattern), walk(F.filter(both, lambda x: x["hit"].isNotNull()))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start and then kind. text must not be null."""
    anywhere = f"(?s)({'.*'})"
    return F.sort_array(F.concat(_spans(text, "assign", ASSIGN, f"[:=]\\x20*[\"']?({_VALUE})$", 6), _spans(text, "access", ACCESS, anywhere, 20), _spans(text, "hex", HEX, anywhere, 24)))


def opaque_spans(text: Column) -> Column:
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
    return F.filter(_spans(text, "opaque", OPAQUE, "(?s)(.*)", 20), mixed)


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", repository: str = "source", owner: str | None = None, out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all where None) and a struct column out: base (spans) and spans (base and added ones).

    Each span has its owners, repositories and whether it looks live. Added are opaque runs that no base span overlaps
    and that look live by their ownership over all rows; those that several places hold are examples and stay out. A null
    text is empty; null repositories and owners are one place. owner defaults to the repository. Rows that are equal in
    keep and in their spans are folded with their number and given back as often. Texts of any length are scanned whole;
    an empty table stays empty.

    Rows without a candidate pass by the shuffles. Hashes are counted by (hash, place) and then by hash, each with a
    partial sum before its shuffle, so a value in a third of all rows is one row a task and place; the counts come
    back by a join on the hash, in which a frequent hash's rows can be split.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    named = [F.col(f"`{c}`") for c in keep]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    loose = lambda base, opaque: F.filter(opaque, lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    place = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    rows = docs.select(F.struct(*named).alias("row"), place(repository).alias("repository"), place(owner or repository).alias("owner"), base_spans(body).alias("base"), opaque_spans(body).alias("opaque"))
    if text not in keep:
        rows = durable(rows)  # one pass over the texts; what is kept is small
    has = (F.size("base") > 0) | (F.size("opaque") > 0)
    bare = rows.filter(~has).select("row.*", F.struct(F.array().cast(JUDGED).alias("base"), F.array().cast(JUDGED).alias("spans")).alias(out))
    some = rows.filter(has).select("row", "repository", "owner", "base", F.concat("base", loose(F.col("base"), F.col("opaque"))).alias("spans"))
    some = some.withColumn("ident", F.sha2(F.to_json(F.struct("row", "repository", "owner", "spans"), {"ignoreNullFields": "false"}), 256))
    if text in keep:
        some = durable(some)  # three uses below: the texts with candidates only, found in one pass
    value = F.sha2("span.value", 256).alias("hash")
    each = some.select("repository", "owner", F.explode("spans").alias("span")).select(value, "repository", "owner").distinct()
    known = each.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    folded = some.groupBy("ident").agg(F.count("*").alias("copies"), F.first("row").alias("row"))
    spans = some.select("ident", "spans").distinct().select("ident", F.explode("spans").alias("span")).withColumn("hash", value)
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES)
    span = F.struct(*[F.col(f"span.{x}").alias(x) for x in ("start", "rank", "end", "kind", "value")], "owners", "repositories", live.alias("live"))
    judged = spans.join(known, "hash").groupBy("ident").agg(F.sort_array(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda x: x["rank"] < 3)
    kept = F.filter("all", lambda x: (x["rank"] < 3) | x["live"])
    back = folded.join(judged, "ident").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return bare.unionByName(back.select("row.*", F.struct(base.alias("base"), kept.alias("spans")).alias(out)))


def redact(docs: DataFrame, text: str = "text", repository: str = "source", owner: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that looks live, base or added, replaced by mark; all rows stay. A null text stays null."""
    s = free_name(docs, "__secrets")
    rows = scan(docs, text, repository, owner, s)
    live = F.filter(F.col(f"{s}.spans"), lambda x: x["live"])
    body = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = x["start"] < a["at"]  # overlaps the one before: only moves its end
        grown = F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.substr(body, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), grown.alias("out"))

    done = F.aggregate(live, start, step, lambda a: F.concat(a["out"], F.substr(body, a["at"] + 1, F.length(body))))
    return rows.withColumn(text, F.when(body.isNull() | (F.size(live) == 0), body).otherwise(done)).select(*[F.col(f"`{c}`") for c in docs.columns])


