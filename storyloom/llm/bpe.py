"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts each text into chunks at places that depend on the bytes around them alone, so passages that several
documents share give the same chunks whatever stands before them. A task encodes each distinct chunk once, with the
tokenizer itself, and reuses the ids while its cache lasts.

A chunk's first and last tokens are wrong where the cut fell inside a word or a special token. So every join is repaired:
a window from a word of the chunk before the cut to a word of the chunk after it is encoded anew. The join stands if the
window's first word has the place and the ids that it has in the one chunk, and its last word those that it has in the
other: from an agreed word on, the tokenizer's left-to-right splitting goes on alike. Where they don't agree, or a chunk is too
short to hold both words, the chunks around the join are encoded as one, twice as many with each round, until all joins
agree or the text is one chunk. Nothing is presumed of the tokenizer but that: words come from its own splitter (a tokenizer
that doesn't split gets whole texts), and the words lie further from the cut than its longest added token reaches.

Most chunks are new, but most of what stands between their spaces is not. Where the tokenizer's own description shows that
no word of it reaches over a space (`parted`), each distinct piece between spaces is encoded once by the tokenizer while a
task's cache of pieces lasts, and a new chunk is put together from its pieces. Other tokenizers encode each new chunk whole.
Windows at joins are always encoded whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BACK, BASE, powers, raw, with_struct

#: Bytes that the rolling hash sees; the mean size of a chunk, and its least but at a text's end.
ROLL = 16
MEAN_CHUNK, LEAST_CHUNK = 2048, 256
#: Characters on either side of a cut that a window covers at least, beyond the longest added token.
MARGIN = 12
#: Bytes of one generation of a task's caches, of chunks and of pieces between spaces; each has two, and ENTRY is what an entry takes beside its text and ids.
CHUNK_BYTES, PIECE_BYTES, ENTRY = 16 << 20, 32 << 20, 200
#: Characters in one call of the tokenizer.
CALL_CHARS = 400_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file; what the file says of truncation and padding is left out."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cuts(data: np.ndarray) -> np.ndarray:
    """Chunk boundaries in data: where the hash of the ROLL bytes before falls on zero; never inside a character."""
    n = len(data)
    if n <= ROLL:
        return np.zeros(0, np.int64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = (total[ROLL:-1] - total[: -ROLL - 1]) * powers(_BACK, n - ROLL)
    h ^= h >> np.uint64(29)
    at = np.flatnonzero((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) < np.uint64((1 << 24) // MEAN_CHUNK)) + ROLL
    return at[(data[at] & 0xC0) != 0x80]


def chunks(text: bytes, at: np.ndarray) -> list[str]:
    """text cut at those of its boundaries that leave no chunk shorter than LEAST_CHUNK."""
    edges = [0]
    for x in at.tolist():
        if x - edges[-1] >= LEAST_CHUNK and len(text) - x >= LEAST_CHUNK:
            edges.append(x)
    edges.append(len(text))
    return [text[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


@dataclass(frozen=True, slots=True)
class Word:
    """A word of an encoded text: its characters and tokens."""

    start: int
    end: int
    first: int
    last: int


@dataclass(frozen=True, slots=True)
class Chunk:
    """A text as the tokenizer encodes it alone: packed ids, and the words that windows end and begin with, if it has them."""

    text: str
    ids: bytes
    early: Word | None
    late: Word | None

    def of(self, w: Word) -> bytes:
        return self.ids[4 * w.first : 4 * w.last]


def _word(enc, k: int) -> Word | None:
    """Word k, or None where there is none."""
    tokens, chars = enc.word_to_tokens(k), enc.word_to_chars(k)
    return Word(chars[0], chars[1], tokens[0], tokens[1]) if tokens and chars else None


def _word_at(enc, place: int, step: int, n: int) -> int | None:
    """The word of the first character from place on, by steps, that belongs to one; white space may belong to none."""
    while 0 <= place < n:
        if (k := enc.char_to_word(place)) is not None:
            return k
        place += step
    return None


def parted(tok) -> bool:
    """Does the tokenizer encode what stands between two spaces always alike, whatever stands around it?

    So if it has a model of byte pairs without dropout, its splitter keeps the matches of a pattern that never looks around
    and of which no part matches a space, its normaliser composes, lowers or collapses white space only, and
    its added tokens are plain strings without a space. False where its description doesn't show that.
    """
    spec = json.loads(tok.to_str())
    flat = lambda x, key: [] if x is None else [z for y in x[key] for z in flat(y, key)] if x["type"] == "Sequence" else [x]
    white = {"Regex": r"\s+"}
    normal = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and (x["pattern"], x["content"]) == (white, " ") for x in flat(spec["normalizer"], "normalizers"))
    split, *rest = flat(spec["pre_tokenizer"], "pretokenizers") or [{"type": None}]
    level = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
    pattern = split["pattern"].get("Regex") if split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] else None
    if pattern is None or re.search(r"\(\?(?!:)|\\[bBAzZGKkXR1-9]|[.$&]|(?<!\[)\^", pattern):
        return False
    parts = re.findall(r"\[(?:\\.|[^\]\\])*\]|\\[pP]\{[^}]*\}|\\.|[^|()?*+{}\\\[\]]", pattern)
    plain = not any(regex.fullmatch(x, " ") for x in parts)
    model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and spec["post_processor"] is None
    added = all(" " not in x["content"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
    return normal and level and plain and model and added


class Pieces:
    """The ids of pieces between spaces, each encoded once while the cache lasts."""

    def __init__(self, tok):
        self.tok = tok
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The cache, with all pieces in it."""
        if self.held > PIECE_BYTES:
            self.young, self.old, self.held = {"": b""}, self.young, 0
        young, old = self.young, self.old
        again = {x: old[x] for x in pieces & old.keys()}
        young |= again
        new = list(pieces - young.keys())
        # A character is taken for a byte and an id of four bytes.
        self.held += sum(ENTRY + 5 * len(x) for x in itertools.chain(again, new))
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            got = [e.ids for e in self.tok.encode_batch_fast(some, add_special_tokens=False)]
            ids = np.fromiter(itertools.chain.from_iterable(got), "<u4").tobytes()
            ends = (4 * np.cumsum([len(x) for x in got])).tolist()
            young.update(zip(some, [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return young

    def chunks(self, texts: list[str], margin: int) -> dict[str, Chunk]:
        """Those of texts, with a piece on either side for windows where they are long enough to need it."""
        split = [t.split(" ") for t in texts]
        known = self.learn(set(itertools.chain.from_iterable(split)))
        out = {}
        for text, own in zip(texts, split, strict=True):
            ids = b"".join(map(known.__getitem__, own))
            early, at, first = None, 0, 0
            for x in own[:-1]:
                n = len(known[x]) // 4
                if n and at >= margin:
                    early = Word(at, at + len(x), first, first + n)
                    break
                at, first = at + len(x) + 1, first + n
            late, at, first = None, len(text) + 1, len(ids) // 4
            for k in range(len(own) - 1, 0, -1):
                n = len(known[own[k]]) // 4
                at, first = at - len(own[k]) - 1, first - n
                if n and k + 1 < len(own) and len(text) - at > margin:
                    late = Word(at, at + len(own[k]), first, first + n)
                    break
            out[text] = Chunk(text, ids, early, late)
        return out


class Encoder:
    """Encodes texts to (ids as little-endian 32-bit, decoded text); one for a task, with which its caches go."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.margin = MARGIN + max((len(t.content) for t in added), default=0)
        self.pieces = Pieces(self.tok) if parted(self.tok) else None
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = self.made = self.reused = self.repaired = self.widened = 0

    def encodings(self, texts: list[str]):
        """(text, encoding) of each text, some characters at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CALL_CHARS):
                size += len(texts[to])
                to += 1
            yield from zip(texts[at:to], self.tok.encode_batch(texts[at:to], add_special_tokens=False), strict=True)
            at = to

    def chunk(self, text: str, enc) -> Chunk:
        n = len(text)
        early = late = None
        if (k := _word_at(enc, self.margin, 1, n)) is not None:
            w = _word(enc, k + 1)
            if w and w.start >= self.margin and w.end < n and _word(enc, k + 2):
                early = w
        if (k := _word_at(enc, n - 1 - self.margin, -1, n)) is not None and (w := _word(enc, k)) and w.end < n:
            late = w
        return Chunk(text, np.array(enc.ids, dtype="<u4").tobytes(), early, late)

    def learn(self, texts: set[str]) -> dict[str, Chunk]:
        """The chunks of texts: from the cache, or encoded and kept there until two generations are full."""
        out, new = {}, []
        for t in texts:
            c = self.young.get(t) or self.old.get(t)
            if c is None:
                new.append(t)
            else:
                out[t] = self.young[t] = c
        self.made += len(new)
        self.held += sum(ENTRY + 5 * len(t) for t in new)
        made = self.pieces.chunks(new, self.margin) if self.pieces else {t: self.chunk(t, enc) for t, enc in self.encodings(new)}
        self.young |= made
        out |= made
        if self.held > CHUNK_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        return out

    def repair(self, joins: set[tuple[str, str]], known: dict[str, Chunk]) -> dict[tuple[str, str], bytes]:
        """The ids between the agreed words, these included, of each join (text before, text after) whose window agrees."""
        windows: dict[str, list[tuple[Chunk, Chunk]]] = {}
        for a, b in joins:
            x, y = known[a], known[b]
            if x.late and y.early:
                windows.setdefault(a[x.late.start :] + b[: y.early.end], []).append((x, y))
        done = {}
        self.repaired += len(windows)
        for text, enc in self.encodings(list(windows)):
            ids = np.array(enc.ids, dtype="<u4").tobytes()
            for x, y in windows[text]:
                cut, k, n = len(x.text) - x.late.start, x.late.last - x.late.first, y.early.last - y.early.first
                if 4 * (k + n) > len(ids) or ids[: 4 * k] != x.of(x.late) or ids[len(ids) - 4 * n :] != y.of(y.early):
                    continue
                # Agreed in their ids; the places where the one ends and the other begins must be the same, too.
                head, tail = enc.token_to_chars(k - 1), enc.token_to_chars(len(ids) // 4 - n)
                if head and tail and head[1] == x.late.end - x.late.start and tail[0] == cut + y.early.start:
                    done[x.text, y.text] = ids
        return done

    def ids(self, docs: list[list[str]]) -> list[bytes]:
        """The packed ids of each document, given as its chunks."""
        known = self.learn({c for d in docs for c in d})
        self.reused += sum(map(len, docs)) - len(known)
        docs = [list(d) for d in docs]
        agreed: dict[tuple[str, str], bytes] = {}
        failed: set[tuple[str, str]] = set()
        reach = 1

        def stands(d: list[str], i: int) -> bool:
            """Is the join of chunks i and i + 1 repaired, and does chunk i + 1 keep it apart from the next one?"""
            if (d[i], d[i + 1]) not in agreed:
                return False
            c = known[d[i + 1]]
            return i + 2 == len(d) or (c.late is not None and c.early.end <= c.late.start)

        open_ = [d for d in docs if len(d) > 1]
        while open_:
            agreed |= self.repair({j for d in open_ for j in zip(d[:-1], d[1:], strict=True) if j not in agreed and j not in failed}, known)
            failed |= {j for d in open_ for j in zip(d[:-1], d[1:], strict=True) if j not in agreed}
            left = []
            for d in open_:
                bad = [i for i in range(len(d) - 1) if not stands(d, i)]
                if not bad:
                    continue
                one = np.zeros(len(d) - 1, dtype=bool)  # joins that go
                for i in bad:
                    one[max(0, i - reach + 1) : i + reach] = True
                new = [d[0]]
                parts: list[list[str]] = [[d[0]]]
                for i, gone in enumerate(one.tolist()):
                    if gone:
                        parts[-1].append(d[i + 1])
                    else:
                        parts.append([d[i + 1]])
                new = ["".join(p) for p in parts]
                self.widened += len(d) - len(new)
                d[:] = new
                left.append(d)
            known |= {t: self.chunk(t, enc) for t, enc in self.encodings([t for t in {t for d in left for t in d} if t not in known])}
            open_ = [d for d in left if len(d) > 1]
            reach *= 2
        out = []
        for d in docs:
            parts, at = [], 0
            for i, t in enumerate(d):
                c = known[t]
                end = len(c.ids) if i + 1 == len(d) else 4 * c.late.first
                parts.append(c.ids[at:end])
                if i + 1 < len(d):
                    parts.append(agreed[t, d[i + 1]])
                    at = 4 * known[d[i + 1]].early.last
            out.append(b"".join(parts))
        return out

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], list[str]]:
        whole = data.tobytes()
        at = cuts(data)
        docs = []
        for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            # A cut looks at bytes of its own text alone.
            own = at[np.searchsorted(at, s + ROLL) : np.searchsorted(at, e)] - s
            docs.append(chunks(whole[s:e], own))
        ids = self.ids(docs)
        decoded = self.tok.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)
        return ids, decoded


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) and a struct column out: n_tokens, ids (little-endian unsigned 32-bit), decoded.

    Equals the tokenizer's own encode(text, add_special_tokens=False) and decode(ids, skip_special_tokens=False) of whole
    texts. Null is the empty text, which has no token. Repeated rows are answered alike; an empty table stays empty. A
    text that the tokenizer's splitter doesn't part is encoded whole. Row by row: no shuffle; what documents share is
    kept in caches of bounded bytes, which end with their task.
    """

    def make():
        own = Encoder(path)

        def work(texts: pa.Array) -> dict:
            ids, decoded = own.texts(*raw(texts))
            return {"n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": decoded}

        return work

    return with_struct(docs, text, out, "n_tokens long, ids binary, decoded string", make, keep)


def unpack(ids: Column) -> Column:
    """array<long> from packed ids."""
    n = F.octet_length(ids).cast("int")
    one = lambda i: F.conv(F.hex(F.concat(*[F.substring(ids, 1, 0), *[F.substr(ids, i + F.lit(k), F.lit(1)) for k in (4, 3, 2, 1)]])), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 4, F.lit(4)), one)).otherwise(F.array().cast("array<long>"))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows and a string column out: the tokenizer's decode of an array<long> column, by slices. Null stays null."""

    @F.pandas_udf("string")
    def run(col):
        import pandas as pd

        done = iter(tokenizer(path).decode_batch([list(map(int, x)) for x in col if x is not None], skip_special_tokens=False))
        return pd.Series([None if x is None else next(done) for x in col], dtype=object)

    return rows.withColumn(out, run(F.col(ids)))
