"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a slice of documents. Its texts become words; only runs of words that all occur in the benchmark can hold a
match, so the shard's suffix array is built over these runs, end to end with separators between them. Every suffix of every
benchmark item is then looked up by binary search, one word of depth after the other, all suffixes together: the last
depth at which the range isn't empty is the longest verbatim match, and the range at window depth holds its places.

Documents stay where they are: the benchmark travels, in blocks of BLOCK_WORDS words, so what a task or the driver holds is
bounded whatever the benchmark's size. With more blocks than one each is a pass over the documents of its own, written to the
checkpoint folder before the next block is fetched, and the passes' spans are united row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, raw, with_struct

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: A-Z in lower case, all that parts words as a space; bytes of longer characters belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Block:
    """Part of a benchmark: its vocabulary and its items' words as ids from 1."""

    vocabulary: dict[bytes, int]
    item_ids: list[str]
    words: np.ndarray  # ids, items end to end, 0 after each
    starts: np.ndarray  # suffixes: where they start
    item: np.ndarray  # and whose they are
    left: np.ndarray  # words from there to the item's end
    depth: np.ndarray  # window depth
    is_window: np.ndarray  # does a whole window start there

    @staticmethod
    def of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Block:
        vocabulary: dict[bytes, int] = {}
        words, starts, item, left, depth, whole = [], [], [], [], [], []
        for k, (_, text) in enumerate(items):
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words((text or "").encode())]
            n, at = len(own), len(words)
            starts += range(at, at + n)
            item += [k] * n
            left += range(n, 0, -1)
            depth += [min(window, n)] * n
            whole += [i + min(window, n) <= n for i in range(n)]
            words += [*own, 0]
        as_array = lambda x: np.array(x, dtype=np.int64)
        return Block(vocabulary, ["" if i is None else str(i) for i, _ in items], as_array(words), as_array(starts), as_array(item), as_array(left), as_array(depth), np.array(whole, dtype=bool))

    @property
    def shortest(self) -> int:
        return int(self.depth.min(initial=1 << 30))


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of words in sorted order, by prefix doubling; words are small non-negative ids."""
    n = len(words)
    rank = words.astype(np.int64)
    step = 1
    while n:
        shifted = np.zeros(n, np.int64)
        if step < n:
            shifted[: n - step] = rank[step:] + 1
        key = rank * (max(int(rank.max()), n) + 2) + shifted
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2
    return np.zeros(0, np.int64)


def narrow(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [low, high) of suffixes whose word at depth is want; all binary searches go side by side."""
    last = len(text) - 1

    def bound(after: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) // 2
            got = text[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, last)]
            right = (got <= want if after else got < want) & open_
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)

    return bound(False), bound(True)


def spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [low, high), end to end."""
    size = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(low) else low


def search(block: Block, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high) at window depth for each suffix of the block, the order, and for each place in text its longest match.

    A place's longest match is that of any suffix of the block whose window occurs there, as far as both go on alike.
    """
    order = suffix_array(text)
    q = len(block.starts)
    low, high = np.zeros(q, np.int64), np.full(q, len(order), np.int64)
    longest = np.zeros(len(text), np.int64)
    wlow, whigh = np.zeros(q, np.int64), np.zeros(q, np.int64)
    # Only suffixes whose first two words both occur can match by more than a word.
    known = np.zeros(int(max(text.max(initial=0), block.words.max(initial=0))) + 1, dtype=bool)
    known[text] = True
    known[0] = True
    second = np.minimum(block.starts + 1, max(len(block.words) - 1, 0))
    alive = np.flatnonzero(known[block.words[block.starts]] & known[block.words[second]]) if len(order) and q else np.zeros(0, np.int64)
    d = 0
    while len(alive):
        a, b = narrow(text, order, low[alive], high[alive], d, block.words[block.starts[alive] + d])
        keep = a < b
        alive = alive[keep]
        low[alive], high[alive] = a[keep], b[keep]
        d += 1
        deep = alive[(block.depth[alive] <= d) & block.is_window[alive]]
        longest[order[spread(low[deep], high[deep])]] = d
        at = alive[(block.depth[alive] == d) & block.is_window[alive]]
        wlow[at], whigh[at] = low[at], high[at]
        alive = alive[block.left[alive] > d]
    return wlow, whigh, order, longest


FIELDS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>, longest int, longest_at int"


def _matcher(block: Block):
    """A function from texts to the fields, for one block."""
    least = block.shortest
    ids = block.vocabulary

    def work(texts: pa.Array) -> dict:
        data, off = raw(texts)
        whole = data.tobytes()
        n = len(texts)
        sizes = np.zeros(n, np.int64)
        codes = []
        for i in range(n):
            words = whole[off[i] : off[i + 1]].translate(_TABLE).split()
            sizes[i] = len(words)
            codes += [ids.get(w, 0) for w in words]
            codes.append(0)
        codes = np.array(codes, dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        # Runs of known words, long enough to hold a window; the rest of the shard can't match.
        known = np.concatenate([[False], codes > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        a, b = edge[::2], edge[1::2]
        long_ = b - a >= least
        a, b = a[long_], b[long_]
        size = b - a + 1  # a run and its separator
        place = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(a) else a, size) + np.arange(int(size.sum()))
        text = codes[np.minimum(place, max(len(codes) - 1, 0))] if len(place) else np.zeros(0, np.int64)
        wlow, whigh, order, reach = search(block, text)

        cover = np.zeros(len(codes) + 1, np.int64)
        pairs = []
        hit = np.flatnonzero(whigh > wlow)
        ranges: dict[tuple[int, int], tuple[int, set[int]]] = {}
        for s in hit:
            ranges.setdefault((int(wlow[s]), int(block.depth[s])), (int(whigh[s]), set()))[1].add(int(block.item[s]))
        for (lo, depth), (hi, items) in ranges.items():
            at = place[order[lo:hi]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + depth, -1)
            docs = np.unique(np.searchsorted(first, at, side="right") - 1)
            pairs += [(int(d), k) for d in docs for k in items]
        inside = np.cumsum(cover)[:-1] > 0
        n_hit = np.add.reduceat(np.append(inside, False).astype(np.int64), first[:-1]) if n else sizes
        found: list[set[int]] = [set() for _ in range(n)]
        for d, k in pairs:
            found[d].add(k)
        spans: list[list[dict]] = [[] for _ in range(n)]
        turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        for s, e in zip(turn[::2], turn[1::2], strict=True):
            d = int(np.searchsorted(first, s, side="right")) - 1
            spans[d].append({"start": int(s - first[d]), "end": int(e - first[d])})
        longest, where = np.zeros(n, np.int32), [None] * n
        at = np.flatnonzero(reach)
        for k in at[np.lexsort((place[at], -reach[at]))]:
            d = int(np.searchsorted(first, place[k], side="right")) - 1
            if not longest[d]:
                longest[d], where[d] = reach[k], int(place[k] - first[d])
        return {"n_words": sizes, "n_hit": n_hit, "item_ids": [sorted({block.item_ids[k] for k in f}) for f in found], "spans": spans, "longest": longest, "longest_at": where}

    return work


def n_blocks(bench: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> int:
    return max(1, -(-int(bench.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0) // (block_words * 6)))


def fetch_block(bench: DataFrame, p: int, parts: int, item: str = "item_id", text: str = "text", window: int = WINDOW) -> Block:
    """Block p of parts: the items whose hash falls there. Only this block's rows come to the driver."""
    rows = bench.select(F.col(item).alias("item"), F.col(text).alias("text"))
    mine = rows.filter(F.pmod(F.xxhash64(F.col("item").cast("string"), F.col("text")), F.lit(parts)) == p) if parts > 1 else rows
    return Block.of([tuple(r) for r in mine.collect()], window)


def find(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "contamination", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (or its columns keep) and a struct column out: n_words, n_hit, item_ids, spans (of words), longest match.

    A document word is hit inside any occurrence of a window, that is `window` consecutive words of an item, or a shorter
    item whole. Null and wordless texts have no words; null and wordless items have no window. Items of one id are one
    item; a null id is the id of no characters. No document or no item: no row or no hit. longest is the longest verbatim match with any benchmark suffix, in words, and
    longest_at where its first one starts (null where there is none). Repeated rows are answered alike. With one block there is no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    keep = docs.columns if keep is None else keep
    name = free_name(docs, "__found")
    rows, parts = docs, n_blocks(bench, item_text, block_words)
    for p in range(parts):
        held = sc.broadcast(fetch_block(bench, p, parts, item, item_text, window))
        needed = [*keep, text] if p < parts - 1 else keep
        rows = with_struct(rows, text, name if p else out, FIELDS, lambda h=held: _matcher(h.value), [c for c in dict.fromkeys(needed) if c != out] + [out] * (p > 0))
        if p:
            rows = rows.withColumn(out, _unite(F.col(out), F.col(name))).drop(name)
        if p < parts - 1:  # this block must go before the next one comes
            rows = durable(rows)
            held.destroy()
    return rows.select(*[F.col(f"`{c}`") for c in keep if c != out], out)


def _unite(a, b):
    """The fields of two blocks together: spans are merged, and n_hit is their total length."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.when(F.size(acc) > 0, last["end"]).otherwise(-1) >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate(F.sort_array(F.concat(a["spans"], b["spans"])), start, step)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    more = b["longest"] > a["longest"]
    pick = lambda f: F.when(more, b[f]).otherwise(a[f]).alias(f)
    return F.struct(a["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.array_sort(F.array_union(a["item_ids"], b["item_ids"])).alias("item_ids"), spans.alias("spans"), pick("longest"), pick("longest_at"))


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, columns as they came."""
    out = free_name(docs, "__contamination")
    return find(docs, bench, text, item, item_text, window, out).filter(F.col(f"{out}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
