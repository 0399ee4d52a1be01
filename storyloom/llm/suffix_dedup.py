"""Repeated substrings by a distributed merge sort of sampled suffixes.

Every text of SIZE bytes holds an anchor: the K-gram with the smallest hash among its K-grams. Equal texts have the same
anchor at the same offset, so of all suffixes only those at anchors are sorted, one in thirty or so.

1. Distinguishing prefixes: tasks exchange hashes of the anchors' K-grams; anchors whose K-gram occurs once drop out. A
   task asks for a hash once for every HOLD anchors, however often it has it, and a document is told the hashes that repeat
   by a row for each, so questions and replies grow with the anchors.
2. Runs: a task sorts its remaining anchors' suffixes, drops those whose whole context a smaller one of its own run has
   (they are repeats for certain), cuts the run at common splitters, and sends each part front-coded: per suffix
   the length of the prefix shared with the one before, the rest, and the bytes to its left. A K-gram of very many documents
   (a line of boilerplate) is no part of its own: there CLASS values of l share a key of all bytes that their texts
   must have in common, so its suffixes part by what stands around them.
3. Merge: a task combines the runs of its key range with a loser tree. Each run's head carries the length of the prefix
   that it shares with the last suffix put out; a head that shares more is smaller, and only heads that share equally much
   are compared, from there on. So no known prefix is compared again, and the merged order comes with its common
   prefix lengths.
4. A text of SIZE bytes that takes l bytes left of its anchor is known by two numbers: the group of its suffix at depth
   SIZE - l in the merged order, and the group of its left side at depth l. Of equal ones the first in (document, start)
   stays; each later one is a removed text. Removed texts become spans, and spans go back to their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, SLICE_BYTES, _BACK, bound_batches, durable, mix, powers, raw, slices, span_hashes

SIZE = 100
K = 40
LEFT = SIZE - K
#: Anchors (one in about 30 bytes) that a task takes questions for, and for each part of the merge, of which only those that
#: repeat get there; anchors that a task holds before it asks, and before it sends a run.
ASK_ROWS, PART_ROWS, HOLD, RUN_ROWS = 1_000_000, 300_000, 1_000_000, 200_000
#: Documents from which parts are planned, by a hash of the key: this many at least, one in so many at least; and splitters.
#: The plan changes where suffixes meet, never the result.
SAMPLE_DOCS, SAMPLE_SHARE, SPLITTERS = 5_000, 1000, 10_000
#: The text column on the way; a name of its own, as Spark sees two scans as one shuffle only if both rename it.
BODY = "__body"
#: A K-gram in more documents than this is split, by classes of so many values of l.
HOT_DOCS, CLASS = 300_000, 8


def anchors(data: np.ndarray, off: np.ndarray, size: int = SIZE, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, lo, hi) of every anchor: it is that of the texts which start lo to hi bytes before it.

    data is rows end to end. Texts that would cross two rows have no anchor.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none.astype(np.uint64), none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = mix((total[k:] - total[:-k]) * powers(_BACK, n - k + 1))  # of the K-gram at each place
    del total
    w = size - k + 1  # K-grams in a text
    m = len(h)
    bits = np.uint64(31)  # a column's texts are below 2 GiB; the same for every slice, so that ties fall alike everywhere
    key = ((h >> bits) << bits) | np.arange(m, dtype=np.uint64)  # of equal hashes the first wins
    # Smallest key of each window of w: the minimum to its block's end, and from the next block's start.
    blocks = -(-m // w)
    full = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:m] = key
    ahead = np.minimum.accumulate(full.reshape(blocks, w), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
    starts = np.ones(n, dtype=bool)  # where a text may start
    for e in off[1:]:
        starts[max(0, e - size + 1) : e] = False
    starts = np.flatnonzero(starts[: len(least)])
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
    p = place[cut]
    return p, h[p], p - last, p - first


def _rows_of(off: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, place, side="right") - 1


def pieces(batch: pa.RecordBatch):
    """(ids, base, rows, data, offsets) of a batch's texts, some megabytes at a time; base[i]: where text i starts in its row.

    A long text comes in pieces that overlap by SIZE - 1 bytes, so each text of SIZE bytes starts in exactly one of them.
    """
    at = 0
    for part in slices(batch, BODY, SLICE_BYTES):
        ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, off = raw(part.column(1))
        rows = np.arange(at, at + len(ids))
        at += len(ids)
        if len(ids) > 1 or len(data) <= 2 * SLICE_BYTES:
            yield ids, np.zeros(len(ids), np.int64), rows, data, off
            continue
        for a in range(0, len(data), SLICE_BYTES):
            own = data[a : a + SLICE_BYTES + SIZE - 1]
            yield ids, np.array([a]), rows, own, np.array([0, len(own)])


def _first_of(a: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal values."""
    return np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)


def ask(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, ids, hashes, twice): anchor hashes by range of the hash, each with a document that has it.

    A hash that a task has twice among HOLD anchors is asked for once, and marked as known to repeat. Its other documents
    are told so with rows whose twice is empty, in any range.
    """

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        lone = _first_of(h)
        twice = np.append(~lone[1:], False) if len(h) else lone
        other = ~lone & _first_of(ids)
        out = []
        to = (h[lone] % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, asked = to[order], np.flatnonzero(lone)[order]
        cut = np.flatnonzero(np.append(_first_of(to), True))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = asked[a:b]
            out.append((int(to[a]), ids[mine].tobytes(), h[mine].tobytes(), twice[mine].tobytes()))
        told = np.flatnonzero(other)
        for a in range(0, len(told), ASK_ROWS // 10):
            mine = told[a : a + ASK_ROWS // 10]
            out.append((int(h[mine[0]] % np.uint64(ranges)), ids[mine].tobytes(), h[mine].tobytes(), b""))
        kinds = [pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "ids", "hashes", "twice"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for ids, _, _, data, off in pieces(batch):
                place, h, _, _ = anchors(data, off)
                if not len(place):
                    continue
                held.append((h, ids[_rows_of(off, place)]))
                n += len(h)
                if n >= HOLD:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    return docs.mapInArrow(run, "part int, ids binary, hashes binary, twice binary")


def answer(asked: DataFrame) -> DataFrame:
    """(id, hash): each document with each of its anchor hashes that occur more than once. A task holds the ranges dealt to it."""

    def rows(i: np.ndarray, h: np.ndarray):
        order = np.argsort(i, kind="stable")
        i, h = i[order], h[order].view(np.int64)
        for a in range(0, len(i), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[a : a + 50_000]), pa.array(h[a : a + 50_000])], names=["id", "hash"])

    def run(batches):
        ids, hs, twice = [], [], []
        for batch in batches:
            for i, h, t in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                i, h, t = (np.frombuffer(x.as_py(), d) for x, d in ((i, np.int64), (h, np.uint64), (t, bool)))
                if len(t):
                    ids.append(i)
                    hs.append(h)
                    twice.append(t)
                else:
                    yield from rows(i, h)
        if hs:
            h, i, t = np.concatenate(hs), np.concatenate(ids), np.concatenate(twice)
            order = np.argsort(h, kind="stable")
            h, i, t = h[order], i[order], t[order]
            same = h[1:] == h[:-1]
            again = t.copy()
            again[1:] |= same
            again[:-1] |= same
            yield from rows(i[again], h[again])

    return asked.mapInArrow(run, "id long, hash long")


def common(a: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted byte matrix shares with the row before; 0 for the first."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = a[1:] != a[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.concatenate([[0], lcp])


def _order(a: np.ndarray) -> np.ndarray:
    """Sorted order of the rows of a byte matrix."""
    wide = np.ascontiguousarray(a)
    pad = -wide.shape[1] % 8
    if pad:
        wide = np.concatenate([wide, np.zeros((len(wide), pad), np.uint8)], axis=1)
    cols = wide.reshape(len(wide), -1, 8).view(">u8")[:, :, 0] if len(wide) else np.zeros((0, 1), np.uint64)
    return np.lexsort(tuple(cols[:, c] for c in range(cols.shape[1] - 1, -1, -1)))


def front_code(sorted_rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(shared prefix lengths, the rests end to end) of a sorted byte matrix."""
    lcp = common(sorted_rows)
    keep = np.arange(sorted_rows.shape[1])[None, :] >= lcp[:, None]
    return lcp.astype(np.uint8), sorted_rows[keep].tobytes()


def front_decode(lcp: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    out = np.empty((len(lcp), width), np.uint8)
    data = np.frombuffer(rest, np.uint8)
    at = 0
    for i, l in enumerate(lcp.tolist()):
        if i:
            out[i, :l] = out[i - 1, :l]
        out[i, l:] = data[at : at + width - l]
        at += width - l
    return out


class LoserTree:
    """Merges sorted runs of equally long byte strings, given with their shared prefix lengths.

    An inner node keeps the run that lost there and the prefix length at which it lost. Iterating gives (run, place, shared
    prefix length with the string before).
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]], width: int):
        self.runs, self.width = runs, width
        self.at = [0] * len(runs)

    def __iter__(self):
        runs, width, at = self.runs, self.width, self.at
        k = 1
        while k < len(runs):
            k *= 2
        head = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
        share = [0] * k

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser); share[loser] becomes the prefix that it has in common with the winner."""
            x, y = head[a], head[b]
            if x is None or y is None:
                return (b, a) if x is None else (a, b)
            p, q = share[a], share[b]
            if p != q:  # both are known against the same string: who shares more of it is smaller
                return (a, b) if p > q else (b, a)
            u, v = x[p:], y[p:]
            if u == v:
                lost = max(a, b)
                share[lost] = width
                return (min(a, b), lost)
            z = int.from_bytes(u) ^ int.from_bytes(v)
            same = p + len(u) - (z.bit_length() + 7) // 8
            won, lost = (a, b) if u < v else (b, a)
            share[lost] = same
            return won, lost

        node = [0] * k
        level = list(range(k))
        base = k
        while len(level) > 1:
            up = []
            base //= 2
            for i in range(0, len(level), 2):
                won, lost = play(level[i], level[i + 1])
                node[base + i // 2] = lost
                up.append(won)
            level = up
        won = level[0]
        while head[won] is not None:
            yield won, at[won], share[won]
            at[won] += 1
            strings, lcps = runs[won]
            if at[won] < len(strings):
                head[won], share[won] = strings[at[won]], lcps[at[won]]
            else:
                head[won] = None
            i = (won + k) // 2
            while i:
                won, node[i] = play(won, node[i])
                i //= 2


RUNS = "part int, kind int, lcp binary, rest binary, left binary, id binary, place binary, lo binary, hi binary"


@dataclass(frozen=True)
class Plan:
    """Which part a suffix goes to: by splitters, then by its K-gram's hash; suffixes of hot K-grams by deeper bytes."""

    parts: int
    marks: np.ndarray  # sorted K-grams
    hot: np.ndarray  # K-grams

    @staticmethod
    def of(parts: int, grams: list[bytes], hot: list[bytes]) -> Plan:
        n = min(parts, SPLITTERS)
        seen = sorted(set(grams))
        marks = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []
        return Plan(parts, np.array(marks, dtype=f"S{K}"), np.array(sorted(hot), dtype=f"S{K}"))


def _grams(right: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(right[:, :K]).view(f"S{K}").ravel()  # a trailing zero byte sorts like no byte


@dataclass
class Suffixes:
    """Anchors with the bytes that their texts reach: from the anchor on, and to its left, the nearest first; others are zero."""

    right: np.ndarray
    left: np.ndarray
    own: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    part: np.ndarray

    def take(self, by: np.ndarray) -> Suffixes:
        return Suffixes(*(x[by] for x in vars(self).values()))

    @staticmethod
    def join(many: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate(x) for x in zip(*(vars(m).values() for m in many), strict=True)))

    def narrow(self) -> None:
        self.right[np.arange(SIZE) >= SIZE - self.lo[:, None]] = 0
        self.left[np.arange(1, LEFT + 1) > self.hi[:, None]] = 0


def _deal(s: Suffixes, h: np.ndarray, plan: Plan) -> Suffixes:
    """s with their parts. One of a hot K-gram comes once for each class of l that it has, with what that class needs."""
    grams = _grams(s.right)
    to = np.searchsorted(plan.marks, grams, side="right")
    sub = -(-plan.parts // (len(plan.marks) + 1))
    s.part = (to * sub + (h % np.uint64(sub)).astype(np.int64)) % plan.parts
    hot = np.isin(grams, plan.hot)
    if not hot.any():
        return s
    out = [s.take(~hot)]
    for l0 in range(0, LEFT + 1, CLASS):
        l1 = min(l0 + CLASS - 1, LEFT)
        c = s.take(hot & (s.lo <= l1) & (s.hi >= l0))
        c.lo, c.hi = np.maximum(c.lo, l0), np.minimum(c.hi, l1)
        c.narrow()
        key = np.concatenate([c.right[:, : SIZE - l1], c.left[:, :l0]], axis=1)
        ends = np.arange(1, len(key) + 1) * key.shape[1]
        c.part = (span_hashes(key.ravel(), ends - key.shape[1], ends) % np.uint64(plan.parts)).astype(np.int64)
        out.append(c)
    return Suffixes.join(out)


def _runs(plan: Plan):
    """A function from batches (id, text, hashes) to runs (kind 0) and certain repeats (kind 1: id, place of the text)."""

    def found(ids, base, data, off, wanted) -> tuple[Suffixes, np.ndarray] | None:
        place, h, lo, hi = anchors(data, off)
        row = _rows_of(off, place)
        # A hash that repeats anywhere repeats for every document that has it.
        keep = np.isin(h, wanted)
        place, row, lo, hi, h = place[keep], row[keep], lo[keep], hi[keep], h[keep]
        if not len(place):
            return None
        cols = np.arange(SIZE)
        right = data[np.minimum(place[:, None] + cols, len(data) - 1)]
        left = data[np.maximum(place[:, None] - np.arange(1, LEFT + 1), 0)]  # the byte before the anchor first
        s = Suffixes(right, left, ids[row], place - off[:-1][row] + base[row], lo, hi, np.zeros(len(lo), np.int64))
        s.narrow()  # so bytes of other rows go too; zeros compress away, and contexts fall together
        return s, h

    def sent(held: list[tuple[Suffixes, np.ndarray]], pack) -> pa.RecordBatch:
        s = _deal(Suffixes.join([x for x, _ in held]), np.concatenate([h for _, h in held]), plan)
        s = s.take(_order(np.concatenate([s.right, s.left], axis=1)))
        # Equal contexts: the first in (document, place) stays, the others are repeats, whatever else there is.
        new = np.concatenate([[True], ((s.right[1:] != s.right[:-1]).any(axis=1)) | ((s.left[1:] != s.left[:-1]).any(axis=1)) | (s.lo[1:] != s.lo[:-1]) | (s.hi[1:] != s.hi[:-1])])
        group = np.cumsum(new) - 1
        by = np.lexsort((s.at, s.own, group))
        s, group = s.take(by), group[by]
        head = _first_of(group)
        first = np.flatnonzero(head)[group]
        sure = ~head & ((s.own != s.own[first]) | (s.at != s.at[first]))
        out = []
        if sure.any():
            lo, hi, own, at = s.lo[sure], s.hi[sure], s.own[sure], s.at[sure]
            size = hi - lo + 1
            starts = np.repeat(at - hi, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            spans = merge(np.repeat(own, size), starts)
            out.append((int(own[0] % plan.parts), 1, b"", b"", b"", *(x.astype(np.int64).tobytes() for x in spans), b""))
        s = s.take(~sure)
        s = s.take(np.argsort(s.part, kind="stable"))
        cut = np.flatnonzero(np.append(_first_of(s.part), True))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            lcp, rest = front_code(s.right[a:b])
            out.append((int(s.part[a]), 0, lcp.tobytes(), pack(rest), pack(s.left[a:b].tobytes()), s.own[a:b].tobytes(), s.at[a:b].astype(np.int64).tobytes(), s.lo[a:b].astype(np.uint8).tobytes(), s.hi[a:b].astype(np.uint8).tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RUNS.split(", ")])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        held, n = [], 0
        for batch in batches:
            lists = batch.column(2)
            for ids, base, rows, data, off in pieces(batch):
                wanted = lists.slice(rows[0], len(rows)).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                got = found(ids, base, data, off, wanted)
                if got is not None:
                    held.append(got)
                    n += len(got[1])
                if n >= RUN_ROWS:
                    yield sent(held, pack)
                    held, n = [], 0
        if n:
            yield sent(held, pack)

    return run


def merge(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, end) of the spans that texts of SIZE bytes at (id, start) cover."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    if not len(ids):
        return ids, starts, starts
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + SIZE)])
    cut = np.flatnonzero(new)
    return ids[cut], starts[cut], starts[np.append(cut[1:], len(ids)) - 1] + SIZE


def _groups(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def _merged(batches):
    """Spans (id, start, end) of later texts, from the runs of a task's ranges."""
    unpack = zstandard.ZstdDecompressor().decompress
    spans = []
    parts: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"]:
                spans.append(tuple(np.frombuffer(r[c], np.int64) for c in ("id", "place", "lo")))
            else:
                parts.setdefault(r["part"], []).append(r)
    for key in sorted(parts):
        rs = parts.pop(key)
        lcps = [np.frombuffer(r["lcp"], np.uint8) for r in rs]
        rights = [front_decode(l, unpack(r["rest"]), SIZE) for l, r in zip(lcps, rs, strict=True)]
        tree = LoserTree([([x.tobytes() for x in m], l.tolist()) for m, l in zip(rights, lcps, strict=True)], SIZE)
        run, place, lcp = (np.array(x, dtype=np.int64) for x in zip(*tree, strict=True))
        base = np.concatenate([[0], np.cumsum([len(l) for l in lcps])])
        order = base[run] + place
        take = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in rs])
        left = np.concatenate([np.frombuffer(unpack(r["left"]), np.uint8).reshape(-1, LEFT) for r in rs])
        own, at = take("id", np.int64), take("place", np.int64)
        lo, hi = take("lo", np.uint8).astype(np.int64), take("hi", np.uint8).astype(np.int64)
        alone = (lcp < K) & (np.append(lcp[1:], 0) < K)  # no other suffix has its K-gram
        many = np.zeros(len(own), dtype=bool)
        many[order[~alone]] = True
        if many.any():
            lorder = _order(left)
            llcp = common(left[lorder])
            first = np.lexsort((at, own))  # documents in order, and places within
            found_i, found_s = [], []
            for l in range(int(lo[many].min()), int(hi[many].max()) + 1):
                sel = first[many[first] & (lo[first] <= l) & (l <= hi[first])]
                if len(sel) < 2:
                    continue
                text = _groups(order, lcp, SIZE - l)[sel] * (len(own) + 1) + (_groups(lorder, llcp, l)[sel] if l else 0)
                _, head, back = np.unique(text, return_index=True, return_inverse=True)
                head = sel[head[back]]
                later = (own[sel] != own[head]) | (at[sel] != at[head])
                found_i.append(own[sel[later]])
                found_s.append(at[sel[later]] - l)
            if found_i:
                spans.append(merge(np.concatenate(found_i), np.concatenate(found_s)))
    if spans:
        i, s, e = (np.concatenate([x[c] for x in spans]) for c in range(3))
        for a in range(0, len(i), 50_000):
            yield pa.RecordBatch.from_pydict({"id": i[a : a + 50_000], "start": s[a : a + 50_000], "end": e[a : a + 50_000]})


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, BODY) of the rows with a key: one shuffle of it by id serves both the runs and the cut."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias(BODY)).filter("id is not null")


def _planned(rows: DataFrame) -> tuple[int, Plan]:
    """(ranges of the questions, the plan of parts), from the anchors of a sample of documents."""
    spark = rows.sparkSession
    share = min(1.0, max(SAMPLE_DOCS / max(1, rows.count()), 1 / SAMPLE_SHARE))

    def run(batches):
        for batch in batches:
            grams: list[np.ndarray] = []
            for _, _, _, data, off in pieces(batch):
                place, _, _, _ = anchors(data, off)
                own = data[place[:, None] + np.arange(K)]
                grams.append(_grams(own))
            if grams:
                got, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([g.ljust(K, b"\0") for g in got.tolist()], pa.binary()), pa.array(n.astype(np.int64))], names=["gram", "n"])

    spot = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_003)) < int(share * 1_000_003) + 1
    freq = durable(rows.filter(spot).mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = int((freq.agg(F.sum("n").alias("n")).first()["n"] or 0) / share)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, parts = (max(least, total // x + 1) for x in (ASK_ROWS, PART_ROWS))
    seen = [bytes(r[0]) for r in freq.orderBy(F.xxhash64("gram"), "gram").limit(2 * SPLITTERS).select("gram").collect()]
    hot = [bytes(r[0]) for r in freq.filter(F.col("n") > F.lit(share * HOT_DOCS)).select("gram").collect()]  # total / HOT_DOCS at most
    return ranges, Plan.of(parts, seen, hot)


def _repeats(rows: DataFrame) -> DataFrame:
    ranges, plan = _planned(rows)
    told = answer(ask(rows, ranges).repartitionById(ranges, "part")).groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    runs = rows.join(told, "id").select("id", BODY, "hashes").mapInArrow(_runs(plan), RUNS).repartitionById(plan.parts, "part")
    spans = runs.mapInArrow(_merged, "id long, start long, end long")
    return spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, spans) of the documents in which bytes are removed: byte spans of texts of SIZE bytes that also start earlier.

    Earlier is a smaller key, or the same key and an earlier start. A null text is empty. A row with a null key takes no
    part. Rows that share a key share their spans, so keys must not stand for several texts: dedup sees to that. What a task holds is bounded by HOLD,
    RUN_ROWS and a part's suffixes; a part outgrows that only where a string of more than SIZE - CLASS bytes, but
    less than SIZE, is shared by a large part of all documents with other bytes around it in each.
    """
    bound_batches(docs.sparkSession)
    return _repeats(_rows(docs, text, key))


def cut(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc key, n_bytes, spans, kept): the merged removed spans of each row of docs, and the bytes that stay."""

    def run(batches):
        for batch in batches:
            out = []
            for i, body, got in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                b = (body.as_py() or "").encode()
                merged: list[list[int]] = []
                for s in got or []:
                    e = min(s["end"], len(b))
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    elif s["start"] < e:
                        merged.append([s["start"], e])
                keep, at = [], 0
                for s, e in merged:
                    keep.append(b[at:s])
                    at = e
                keep.append(b[at:])
                out.append((i, len(b), [{"start": s, "end": e} for s, e in merged], b"".join(keep)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "n_bytes", "spans", "kept"])

    bound_batches(docs.sparkSession)
    rows = _rows(docs, text, key).join(spans, "id", "left").select("id", BODY, "spans")
    none = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias(BODY)).filter("id is null")
    rows = rows.unionByName(none, allowMissingColumns=True)
    done = rows.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return done.select(F.col("id").alias(key), "n_bytes", "spans", "kept")


def _numbers(docs: DataFrame, text: str, key: str) -> DataFrame | None:
    """(id, digest, number) of each text under each key, numbers in order of both; None where no key has two texts."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), _digest(F.col(f"`{text}`")).alias("digest")).filter("id is not null")
    if own.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").isEmpty():
        return None
    return durable(own.distinct().repartitionByRange("id", "digest").sortWithinPartitions("id", "digest").withColumn("number", F.monotonically_increasing_id()))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """cut() of repeats(): every row of docs with its key, what is removed from it and what stays; other columns aren't carried.

    A row with a null key stays whole. An empty table stays empty. Rows that share a key but not their text are documents of their own, of which
    that with the smaller digest comes first; rows equal in both are one document and answered alike.
    """
    numbers = _numbers(docs, text, key)
    if numbers is None:
        return cut(docs, repeats(docs, text, key), text, key)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias(BODY), _digest(F.col(f"`{text}`")).alias("digest"))
    rows = rows.join(numbers, ["id", "digest"], "left").select("number", BODY)
    done = cut(rows, repeats(rows, BODY, "number"), BODY, "number")
    return done.join(numbers.select("number", F.col("id").alias(key)), "number", "left").select(key, "n_bytes", "spans", "kept")
