"""Quality rules as a ledger of bits, in DataFrame functions only.

`measure` takes each text's measurements once; `ledger` evaluates every rule once on them and packs the failures into one
long. Policies are versioned bit masks over the ledger, so a new policy, or what one rule alone removes, is bitwise
arithmetic on stored rows and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements; true where the document breaks the rule."""

    name: str
    fails: str


#: A rule's bit is its place. Rules are only ever appended, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("many_words", "n_words > 100000"),
)
#: Version of a policy -> names of the rules that it enforces.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "symbols"), "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words")}


def mask(names, rules=RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in names)


def measure(docs: DataFrame, text: str = "text", out: str = "m") -> DataFrame:
    """docs and a struct column out of measurements of the whole text; null has none of anything.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (those equal to an
    earlier one), n_repeat_words (words in five-word windows that are found twice or more, the first included). Windows
    are compared by a 64-bit hash of their words. A document is one row and one task's work: no shuffle, no key. Texts of any length are
    measured whole; repeated rows are measured alike, each for itself; an empty table stays empty.
    """
    w, h, r = free_name(docs, "__words"), free_name(docs, "__windows"), free_name(docs, "__repeats")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda x: x != "")
    rows = docs.withColumn(w, words)
    n = F.size(w)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn(h, hashes)
    # Sorted (hash, place): equal hashes are neighbours, so a window repeats where a neighbour has its hash.
    pairs = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")

    def places(s: Column) -> Column:
        k = F.size(s)
        later = F.slice(s, 2, F.greatest(k - 1, F.lit(0)))
        twins = F.filter(F.zip_with(s, later, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none)), lambda x: F.size(x) > 0)
        return F.sort_array(F.array_distinct(F.flatten(twins)))

    rows = rows.withColumn(r, F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.element_at(F.transform(F.array(pairs), places), 1)))
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(F.col(r), first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    line = F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    got = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.element_at(line, 1)["n"].alias("n_lines"),
        F.element_at(line, 1)["d"].alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn(out, got).select(*[F.col(f"`{c}`") for c in docs.columns if c != out], out)


def ledger(measured: DataFrame, rules=RULES, m: str = "m", out: str = "failed") -> DataFrame:
    """measured and a long out whose bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    names = [f.name for f in measured.schema[m].dataType.fields]
    for i, r in enumerate(rules):
        sql = r.fails
        for f in sorted(names, key=len, reverse=True):
            sql = _qualify(sql, f, m)
        bits = bits.bitwiseOR(F.when(F.expr(sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn(out, bits)


def _qualify(sql: str, field: str, struct: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){field}\b", f"{struct}.{field}", sql)


def passes(policy: str, rules=RULES, failed: str = "failed", policies=POLICIES) -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policies[policy], rules)).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, columns as they came."""
    m, f = free_name(docs, "__m"), free_name(docs, "__failed")
    return ledger(measure(docs, text, m), m=m, out=f).filter(passes(policy, failed=f)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(rows: DataFrame, policy: str = "v2", rules=RULES, failed: str = "failed", policies=POLICIES) -> DataFrame:
    """rule, n_failed, n_only (documents that only this rule of the policy removes), n_removed, n_docs; one row a rule.

    One pass of sums over the ledger; a document fails only rule i where the policy's bits of the ledger are exactly 1 << i.
    """
    held = F.col(failed).bitwiseAND(F.lit(mask(policies[policy], rules)).cast("long"))
    kept = [(i, r) for i, r in enumerate(rules) if r.name in policies[policy]]
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    aggs = [F.count("*").alias("d"), count(held != 0).alias("x")]
    for i, _ in kept:
        aggs += [count(held.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"f{i}"), count(held == (1 << i)).alias(f"o{i}")]
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for i, r in kept])
    return rows.agg(*aggs).select(F.explode(each).alias("r"), "x", "d").select("r.*", F.col("x").alias("n_removed"), F.col("d").alias("n_docs"))
