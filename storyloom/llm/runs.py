"""Runs (maximal periodic stretches of words) by grammar compression.

The word ids of a slice of texts are compressed by Re-Pair, each text for itself: pairs of neighbouring symbols that occur
twice or more become symbols of their own, the most frequent first, until none is left. Pairs are replaced by rounds: in
one round go all occurrences of a pair that is more frequent than the pairs on either side (of equals a hash decides). So
rounds are few, and as the occurrences of one round's symbols don't overlap, the expansions of all symbols together are no
longer than the text times the rounds. What is left is joined two by two until each stretch is one symbol.

A run that lies within a symbol's expansion and not within either of its two parts crosses the boundary between them. Runs that
cross it are computed once a symbol, where it first occurs: for each period, the words one period apart are compared to
the left and to the right of the boundary by common extensions (names of blocks of 1, 2, 4 ... words, so an extension is
found in as many steps as its length has binary digits). They are then moved to every place at which the symbol is derived.
Of the intervals so found, each with a period, those within another of the same period are parts of it that a symbol's end cut
off, and of equal intervals the smallest period counts; the rest are the runs.

Words that can't be in a run take no part: all words of a run of 12 words and more with two periods and more stand in a
stretch of 6 words that the text has twice, and others have no pair to be replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, free_name, mix, raw, span_hashes, tokens, with_struct

#: A run has so many words at least, and two periods.
LEAST = 12
#: Words of a stretch that a run's words repeat: a run of period q holds LEAST - q of them or q.
GRAM = LEAST // 2
#: Pairs of words that are compared at once, and bytes of words that are hashed at once.
PAIRS, HASHED = 1 << 20, 4 << 20
_C = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, some bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, side="right")))
        base = starts[at]
        out[at:to] = span_hashes(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive ids."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(size):
        g = mix(g * _C + h[k : k + n])
    return g


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a stretch of GRAM words that their text has twice or more."""
    out = np.zeros(len(h), dtype=bool)
    g = _grams(h, GRAM)
    own = np.flatnonzero(doc[: len(g)] == doc[GRAM - 1 :][: len(g)])
    key = mix(g[own] + mix(doc[own].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for k in range(GRAM):
        out[own[twice] + k] = True
    return out


class Symbols:
    """The symbols of two parts: a text place of each, where its parts meet and where it ends; and all places of each."""

    def __init__(self):
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.places: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, kind: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        """Occurrences of new symbols, kind counts from 0; every kind occurs."""
        _, first = np.unique(kind, return_index=True)
        self.made.append((start[first], middle[first], end[first]))
        self.places.append((kind + self.count, start))
        self.count += len(first)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lo, mid, hi = (np.concatenate(x) for x in zip(*self.made, strict=True))
        kind, start = (np.concatenate(x) for x in zip(*self.places, strict=True))
        return lo, mid, hi, kind, start


def grammar(ids: np.ndarray, bound: np.ndarray) -> Symbols:
    """Re-Pair of ids by rounds, then halving. bound[i]: nothing goes over the edge before i. Texts have ids of their own."""
    out = Symbols()
    start, end, sym = np.arange(len(ids)), np.arange(1, len(ids) + 1), ids.astype(np.int64)
    joined = ~bound[1:]  # may symbols i and i + 1 form a pair? A pair that occurs once never will occur twice.
    top = int(sym.max(initial=-1)) + 1
    live = joined.copy()
    while live.any():
        at = np.flatnonzero(live)
        key = sym[at] * top + sym[at + 1]
        kinds, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mix(kinds.astype(np.uint64)), count))] = np.arange(len(kinds))
        often = count[inverse] > 1
        live[at[~often]] = False
        at, inverse = at[often], inverse[often]
        if not len(at):
            break
        # Neighbours of one pair (a symbol again and again) stand or fall together; then every other one is replaced.
        mine = rank[inverse]
        near = np.concatenate([[False], at[1:] == at[:-1] + 1])
        fresh = ~near | np.concatenate([[True], mine[1:] != mine[:-1]])
        group = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        left = np.where(near[head], mine[head - 1], -1)
        right = np.concatenate([np.where(near[head[1:]], mine[head[1:]], -1), [-1]])
        wins = (mine[head] > left) & (mine[head] > right)
        pick = wins[group] & ((np.arange(len(at)) - head[group]) % 2 == 0)
        i = at[pick]
        _, kind = np.unique(inverse[pick], return_inverse=True)
        out.add(kind, start[i], end[i], end[i + 1])
        sym[i] = top + kind
        top += int(kind.max()) + 1
        end[i] = end[i + 1]
        stay = np.ones(len(sym), dtype=bool)
        stay[i + 1] = False
        sym, start, end = sym[stay], start[stay], end[stay]
        stay = np.ones(len(joined), dtype=bool)
        stay[i] = False  # edge i is between symbols i and i + 1; that inside a new symbol goes
        live, joined = live[stay], joined[stay]
    part = np.concatenate([[0], np.cumsum(~joined)]) if len(sym) else np.zeros(0, np.int64)
    while len(part) and (part[1:] == part[:-1]).any():
        first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        nth = np.arange(len(part)) - np.repeat(first, np.diff(np.concatenate([first, [len(part)]])))
        i = np.flatnonzero((nth[:-1] % 2 == 0) & (part[1:] == part[:-1]))
        out.add(np.arange(len(i)), start[i], end[i], end[i + 1])
        end[i] = end[i + 1]
        stay = np.ones(len(part), dtype=bool)
        stay[i + 1] = False
        start, end, part = start[stay], end[stay], part[stay]
    return out


class Extensions:
    """Common extensions of places in ids, by names of blocks of 1, 2, 4 ... ids."""

    def __init__(self, ids: np.ndarray, most: int):
        self.names = [mix(ids.astype(np.uint64) + np.uint64(1))]
        while 2 << (len(self.names) - 1) <= most:
            last, k = self.names[-1], 1 << (len(self.names) - 1)
            self.names.append(mix(last[:-k] * _C + last[k:]))

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many ids from a on equal those from b on, most at most."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            fit = got + size <= most
            x, y = np.where(fit, a + got, 0), np.where(fit, b + got, 0)
            got += np.where(fit & (names[x] == names[y]), size, 0)
        return got

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many ids up to a and before it equal those up to b, most at most."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            fit = got + size <= most
            x, y = np.where(fit, a - got - size + 1, 0), np.where(fit, b - got - size + 1, 0)
            got += np.where(fit & (names[x] == names[y]), size, 0)
        return got


def crossing(ids: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, start, end, period) of the periodic stretches that cross mid in each [lo, hi), as long as they are within it."""
    long = np.flatnonzero(hi - lo >= LEAST)
    found = [np.zeros((4, 0), np.int64)]
    if len(long):
        reach = Extensions(ids, int((hi - lo)[long].max()))
        three = _grams(reach.names[0], 3)
    # A pair of words one period apart meets at mid: with a period before mid (side 0) or one after it (side 1).
    for side in (0, 1):
        most = np.minimum((mid - lo) if side == 0 else (hi - mid), (hi - lo) // 2)[long]
        at = np.concatenate([[0], np.cumsum(most)])
        for a in range(0, int(at[-1]), PAIRS):
            flat = np.arange(a, min(a + PAIRS, int(at[-1])))
            row = np.searchsorted(at, flat, side="right") - 1
            q = flat - at[row] + 1
            s = long[row]
            x = mid[s] - q if side == 0 else mid[s]
            y = x + q
            # Of LEAST - q equal words or q, three stand on one side of the pair.
            ahead = (y + 3 <= hi[s]) & (three[np.minimum(x, len(three) - 1)] == three[np.minimum(y, len(three) - 1)])
            behind = (x - 3 >= lo[s]) & (three[np.maximum(x - 3, 0)] == three[np.maximum(y - 3, 0)])
            near = ahead | behind
            s, q, x, y = s[near], q[near], x[near], y[near]
            right = reach.forward(x, y, hi[s] - y)
            left = reach.backward(x - 1, y - 1, x - lo[s])
            good = left + right >= np.maximum(q, LEAST - q)
            found.append(np.stack([s[good], (x - left)[good], (y + right)[good], q[good]]))
    s, start, end, q = np.concatenate(found, axis=1)
    # Of one symbol's equal stretches that with the smallest period.
    order = np.lexsort((q, end, start, s))
    s, start, end, q = s[order], start[order], end[order], q[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return s[new], start[new], end[new], q[new]


def runs_of(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts' words, given as hashes h and their texts' numbers, ordered by start and period."""
    none = np.zeros(0, np.int64)
    where = np.flatnonzero(repeated(h, doc))
    if not len(where):
        return none, none, none
    bound = np.ones(len(where), dtype=bool)
    bound[1:] = (where[1:] != where[:-1] + 1) | (doc[where[1:]] != doc[where[:-1]])
    _, ids = np.unique(mix(h[where] + mix(doc[where].astype(np.uint64) + np.uint64(7))), return_inverse=True)
    symbols = grammar(ids, bound)
    if not symbols.count:
        return none, none, none
    lo, mid, hi, kind, place = symbols.arrays()
    s, start, end, q = crossing(ids, lo, mid, hi)
    # To all places of each symbol.
    order = np.argsort(kind, kind="stable")
    first = np.searchsorted(kind[order], np.arange(symbols.count + 1))
    times = np.diff(first)[s]
    row = np.repeat(np.arange(len(s)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    by = place[order[first[s[row]] + nth]] - lo[s[row]]
    start, end, q = start[row] + by, end[row] + by, q[row]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    # Of one period, those that reach beyond all that began before or with them.
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    span = len(where) + 1
    far = np.maximum.accumulate(end + q * span)
    whole = np.ones(len(q), dtype=bool)
    whole[1:] = end[1:] + q[1:] * span > far[:-1]
    start, end, q = start[whole], end[whole], q[whole]
    start, end = where[start], where[end - 1] + 1
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def detect_slice(data: np.ndarray, off: np.ndarray) -> dict[str, pa.Array]:
    rows = len(off) - 1
    starts, ends, first = tokens(data, off, WHITE)
    doc = np.repeat(np.arange(rows), np.diff(first))
    start, end, period = runs_of(word_hashes(data, starts, ends), doc)
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    # A kept word's bytes stay, and where another one follows in its text, the white space behind it as a blank.
    more = np.zeros(len(kept), dtype=bool)
    more[:-1] = doc[kept[1:]] == doc[kept[:-1]]
    stay = np.zeros(len(data) + 1, np.int8)
    stay[starts[kept]] += 1
    stay[ends[kept] + more] -= 1
    stay = np.cumsum(stay[:-1], dtype=np.int8).astype(bool)
    text = data.copy()
    text[ends[kept][more]] = 32
    text = text[stay]
    size = np.where(kept >= 0, ends[kept] - starts[kept] + more, 0)
    bytes_ = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], weights=size, minlength=rows).astype(np.int64))])
    of = doc[start] if len(start) else np.zeros(0, np.int64)
    cut = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
    kind = pa.int32() if bytes_[-1] < 1 << 31 else pa.int64()
    string = pa.string() if bytes_[-1] < 1 << 31 else pa.large_string()
    collapsed = pa.Array.from_buffers(string, rows, [None, pa.array(bytes_, kind).buffers()[1], pa.py_buffer(text)]).cast(pa.string())
    return {"n_words": pa.array(np.diff(first)), "runs": pa.ListArray.from_arrays(pa.array(cut), items), "collapsed": collapsed}


def detect(docs: DataFrame, text: str = "text", out: str = "periodic", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) and a struct column out: n_words, runs (start, length, period), collapsed.

    Words are runs of what isn't ASCII white space, numbered from 0. A run is a stretch of words of which those one period
    apart are equal, with its smallest period, of LEAST words and two periods at least, that no neighbouring word extends; runs are
    ordered by start, then period. collapsed is the words, with a blank between, without those that a run holds after its first
    period. Null and empty texts have no word, no run and an empty collapsed text. Words are compared by 64-bit hashes. Texts
    of any length are worked on whole; repeated rows are answered alike; an empty table stays empty. Row by row: no shuffle.
    """
    return with_struct(docs, text, out, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", lambda: lambda texts: detect_slice(*raw(texts)), keep)


def longest(runs: Column) -> Column:
    """(length, start, period) of the longest run, of equals the first, then that of the smallest period; null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["start"]).alias("start"), (-best["period"]).alias("period")))


def repeat_tails(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with periodic tails put into one in ten texts, drawn by the crc32 of the key: what a test of run detection needs.

    With h that sum, g = floor(h / 10) and n words, of which there are some, a text with h % 10 = 0 keeps its words up to a = g % n; from there
    on stands word a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)). Its words are then joined by blanks. Others, and rows without a key, stay.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    made = docs.select("*", F.when(h % 10 == 0, words).alias(mark := free_name(docs, "__words")))
    n, g = F.size(mark), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.transform(F.sequence(a, n.cast("long") - 1), lambda i: F.element_at(F.col(mark), (a + (i - a) % p + 1).cast("int")))
    new = F.array_join(F.concat(F.slice(mark, F.lit(1), a.cast("int")), tail), " ")
    return made.withColumn(text, F.when(n > 0, new).otherwise(F.col(f"`{text}`"))).drop(mark)
