"""Token ids as binary files: canonical length-limited Huffman codes from global counts, decoded by tables in independent blocks.

Texts are tokenized once and their packed ids written as a table; each task sums the counts of its ids, and their totals (a row
an id of the vocabulary) give code lengths of max_bits at most by package-merge. Codes are canonical: by length, then by id, so a
file carries lengths alone. Rows are then shuffled into ranges of keys and sorted in them, and each task writes its ids as
files. A file holds a header, the lengths, an index of its rows (key, number of ids), and blocks of BLOCK ids. A block is a
bit string of its own with a checksum and the bit offset of each LANE-th id, so reading can begin at any of them: the
decoder looks up all lanes' next codes in one table at once, and one row is read from its own lanes alone.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer
from .common import checkpoint_dir, raw, slices, span_hashes, with_struct
from .files import read_files, remove, write_files

MAGIC, VERSION = b"SLTI", 1
SUFFIX = ".ids"
#: The longest code; a table of two to that power is the decoder's.
MAX_BITS = 18
#: Ids of a block, of a lane, and of a file (one longer row is a file of its own).
BLOCK, LANE, FILE_IDS = 1 << 16, 64, 4_000_000
#: Pieces (30 bytes or so each) from which a task's table of them begins anew, and characters that the tokenizer gets at once.
PIECES, CALL_CHARS = 2_000_000, 400_000


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The lengths of an optimal prefix code of max_bits at most, by package-merge; 0 for ids that never occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids have no codes of {max_bits} bits")
    if n <= 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    merged, leaves = weights, []
    for level in range(max_bits):
        if level:
            pairs = len(merged) // 2
            both = np.concatenate([weights, merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]])
            place = np.argsort(both, kind="stable")
            merged = both[place]
            leaves.append(place < n)
        else:
            leaves.append(np.ones(n, dtype=bool))
    most, size = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(leaves):
        own = int(np.count_nonzero(leaf[:most]))
        size[:own] += 1
        most = 2 * (min(most, len(leaf)) - own)
    out[order] = size
    return out


class Code:
    """A canonical code given by the lengths of its ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.sorted = used[np.argsort(lengths[used], kind="stable")].astype(np.uint32)
        size = lengths[self.sorted].astype(np.int64)
        self.bits = int(size.max(initial=1))
        width = np.int64(1) << (self.bits - size)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.sorted] = ((np.cumsum(width) - width) >> (self.bits - size)).astype(np.uint64)
        self.width = width

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, length) for each value of the next `bits` bits; length 0 where no code begins so."""
        ids, size = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint8)
        n = int(self.width.sum())
        ids[:n] = np.repeat(self.sorted, self.width)
        size[:n] = np.repeat(self.lengths[self.sorted], self.width)
        return ids, size

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, lanes): the codes of ids one after the other, and how many bits each LANE ids take."""
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(size)
        starts = ends - size
        word = starts >> 5
        value = self.codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = int(ends[-1])
        words = np.zeros((total >> 5) + 3, np.uint64)
        words[word[head]] += np.add.reduceat(value >> np.uint64(32), head)
        words[word[head] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), head)
        first = starts[::LANE]
        return words.astype(">u4").tobytes()[: (total + 7) >> 3], np.diff(first, append=total).astype("<u2")


def pack_file(code: Code, keys: list[int | None], ids: list[np.ndarray], before: int) -> bytes:
    """A file of rows (key, ids); before: the ids of its part's earlier files."""
    count = np.array([len(x) for x in ids], "<u4")
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [(n := min(BLOCK, len(every) - a), *code.pack(every[a : a + n])) for a in range(0, len(every), BLOCK)]
    known = np.array([k is not None for k in keys], np.uint8)
    index = b"".join([known.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), count.tobytes()])
    packed = [zlib.compress(code.lengths.tobytes(), 6), zlib.compress(index, 1)]
    head = {"rows": len(keys), "ids": len(every), "before": before, "symbols": len(code.lengths), "lengths": len(packed[0]), "index": len(packed[1]), "blocks": [[n, len(b), zlib.crc32(lanes.tobytes() + b)] for n, b, lanes in blocks]}
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<HI", VERSION, len(text)), text, *packed, *[lanes.tobytes() + b for _, b, lanes in blocks]])


class File:
    """A file's content, opened for reading. ValueError where it isn't whole."""

    def __init__(self, content: bytes, codes: dict[bytes, tuple[np.ndarray, np.ndarray]] | None = None):
        if content[:4] != MAGIC or len(content) < 10:
            raise ValueError("not a file of token ids")
        version, n = struct.unpack_from("<HI", content, 4)
        if version != VERSION:
            raise ValueError(f"version {version} isn't known")
        self.head = json.loads(content[10 : 10 + n])
        at = 10 + n
        packed = content[at : at + self.head["lengths"]]
        at += self.head["lengths"]
        index = zlib.decompress(content[at : at + self.head["index"]])
        at += self.head["index"]
        rows = self.head["rows"]
        self.known = np.frombuffer(index, np.uint8, rows).astype(bool)
        self.keys = np.frombuffer(index, "<i8", rows, rows)
        self.count = np.frombuffer(index, "<u4", rows, 9 * rows).astype(np.int64)
        codes = {} if codes is None else codes
        if packed not in codes:
            codes.clear()
            codes[packed] = Code(np.frombuffer(zlib.decompress(packed), np.uint8)).table()
        self.table = codes[packed]
        self.bits = len(self.table[0]).bit_length() - 1
        sizes = [(n, 2 * -(-n // LANE) + b) for n, b, _ in self.head["blocks"]]
        self.at = at + np.concatenate([[0], np.cumsum([s for _, s in sizes])]).astype(np.int64)
        self.content = content
        if self.at[-1] != len(content) or sum(n for n, _ in sizes) != self.head["ids"] or self.count.sum() != self.head["ids"]:
            raise ValueError("lengths don't hold")

    def lanes(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first bit of each lane, ids of each lane) of a block whose checksum holds."""
        n, _, crc = self.head["blocks"][block]
        held = self.content[self.at[block] : self.at[block + 1]]
        if zlib.crc32(held) != crc:
            raise ValueError(f"block {block} is damaged")
        k = -(-n // LANE)
        bits = np.frombuffer(held, "<u2", k).astype(np.int64)
        count = np.full(k, LANE, np.int64)
        count[-1] = n - LANE * (k - 1)
        return np.frombuffer(held, np.uint8, len(held) - 2 * k, 2 * k), np.cumsum(bits) - bits, count

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, decoded from the lanes that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        data, at, count, base = [], [], [], 0
        for block in range(start // BLOCK, (end - 1) // BLOCK + 1):
            b, first, n = self.lanes(block)
            lo, hi = max(0, start - block * BLOCK) // LANE, (min(end - block * BLOCK, BLOCK) - 1) // LANE + 1
            data.append(b)
            at.append(first[lo:hi] + 8 * base)
            count.append(n[lo:hi])
            base += len(b)
        whole = np.concatenate([*data, np.zeros(8, np.uint8)]).astype(np.uint32)
        four = whole[:-3] << np.uint32(24) | whole[1:-2] << np.uint32(16) | whole[2:-1] << np.uint32(8) | whole[3:]
        place, count = np.concatenate(at), np.concatenate(count)
        ids, size = self.table
        out = np.zeros((len(place), LANE), np.uint32)
        for k in range(LANE):
            live = slice(None) if (count > k).all() else np.flatnonzero(count > k)
            p = place[live]
            value = four[p >> 3] << (p & 7).astype(np.uint32) >> np.uint32(32 - self.bits)
            if not size[value].all():
                raise ValueError("bits that are no code")
            out[live, k] = ids[value]
            place[live] = p + size[value]
        made = out.ravel()[(np.arange(LANE) < count[:, None]).ravel()]
        skip = start - (start // BLOCK * BLOCK + (start % BLOCK) // LANE * LANE)
        return made[skip : skip + end - start]


def parted(tok) -> bool:
    """Does the tokenizer's splitter begin anew at white space that follows something else? So with its byte-level pattern, unless
    a normaliser, a prefix space or an added token with white space changes that. False where its description doesn't show it."""
    spec = json.loads(tok.to_str())
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    level = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    added = all(not re.search(r"\s", x["content"]) and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in spec["added_tokens"])
    return level and added and spec["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout") and (spec["post_processor"] or {"type": "ByteLevel"})["type"] == "ByteLevel"


#: Classes of bytes: white space, letters, digits, other ASCII, and bytes of characters whose class isn't looked up.
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
_CLASS = np.full(256, _UNKNOWN, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[0xC3:0xCA] = _LETTER  # the first bytes of U+00C0 to U+024F, of which all but two are letters


def odd_space(data: np.ndarray) -> np.ndarray:
    """Places of white space that isn't a blank, a tab or a line break, by any definition of it."""
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    x, y, z = pad[:-2], pad[1:-1], pad[2:]
    low = (x == 0x0B) | (x == 0x0C) | (x >= 0x1C) & (x <= 0x1F)
    two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    general = (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z >= 0xA8) & (z <= 0xAF)) | (y == 0x81) & (z == 0x9F))
    return np.flatnonzero(low | two | general | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xE1) & ((y == 0x9A) & (z == 0x80) | (y == 0xA0) & (z == 0x8E)))


def pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern surely begins a match, and each row: the pieces between can be encoded alone.

    The pattern takes letters, digits, or other characters, each with one blank before them, an apostrophe with what it
    shortens, and white space: all of it at a text's end, else all but its last one, which goes with what follows if it is a blank.
    """
    n = len(data)
    kind = _CLASS[data]
    if n > 1:
        after = (kind[:-1] == _LETTER) & (data[:-1] >= 0xC3)  # the second byte of a two-byte letter
        kind[1:][after] = _LETTER
        sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[sign] = kind[sign + 1] = _UNKNOWN
    edge = np.zeros(n + 1, dtype=bool)
    a, b = kind[:-1], kind[1:]
    white, next_white = a == _SPACE, b == _SPACE
    inner = edge[1:n]
    inner |= ~white & (next_white | (a != b) & (a != _UNKNOWN) & (b != _UNKNOWN) & (data[:-1] != ord("'")))
    inner |= white & ~next_white & (data[:-1] != 32)
    last = np.zeros(n, dtype=bool)  # the last white space before something else in its row
    last[:-1] = white & ~next_white
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = False
    inner |= white & next_white & last[1:]
    edge[off] = True
    return np.flatnonzero(edge)


class Encoder:
    """Ids of texts; made once a task. With a tokenizer that `parted` accepts, each distinct piece is encoded once while the table of pieces lasts."""

    def __init__(self, path: str, end_id: int):
        self.tok = tokenizer(path)
        self.kind, self.end = width_of(path, end_id), end_id
        self.parted = parted(self.tok)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of texts, encoded as they are, some characters at a time."""
        ids, count, at = [], [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CALL_CHARS):
                size, to = size + len(texts[to]), to + 1
            got = [e.ids for e in self.tok.encode_batch_fast(texts[at:to], add_special_tokens=False)]
            count += map(len, got)
            ids.append(np.fromiter(itertools.chain.from_iterable(got), self.kind))
            at = to
        return np.concatenate(ids) if ids else self.pool[:0], np.array(count, np.int64)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each piece in the table, with all of them in it."""
        keys, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > PIECES:
            self.forget()
        place = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != keys
        if new.any():
            text = data.tobytes()
            ids, count = self.whole([text[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, ids])
            self.known, self.at, self.count = (np.insert(x, place[new], y) for x, y in ((self.known, keys[new]), (self.at, at), (self.count, count)))
            place = np.searchsorted(self.known, keys)
        return place[inverse]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the rows, the end id behind each."""
        data, off = raw(texts)
        rows = len(off) - 1
        odd = np.full(rows, not self.parted)
        if self.parted and len(data):
            odd[np.searchsorted(off, odd_space(data), side="right") - 1] = True
            text = data.tobytes()
            for word in self.added:
                at = text.find(word)
                while at >= 0:
                    odd[np.searchsorted(off, at, side="right") - 1] = True
                    at = text.find(word, at + 1)
        cut = pieces(data, off) if self.parted and len(data) else off[:0]
        starts, ends = cut[:-1], cut[1:]
        row = np.searchsorted(off, starts, side="right") - 1
        mine = ~odd[row] if len(row) else np.zeros(0, dtype=bool)
        starts, ends, row = starts[mine], ends[mine], row[mine]
        place = self.learn(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        count = self.count[place]
        rest = np.flatnonzero(odd)
        own, own_count = self.whole([texts[int(i)].as_py() or "" for i in rest])
        size = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        size[rest] = own_count
        to = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(int(to[-1]), self.end, self.kind)
        # Pieces stand one after the other in their rows, with a place for the end id between rows.
        fill = np.ones(len(out), dtype=bool)
        fill[to[1:] - 1] = False
        for i in rest:
            fill[to[i] : to[i + 1] - 1] = False
        total = np.cumsum(count)
        source = np.repeat(self.at[place] - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)
        out[fill] = self.pool[source]
        at = np.cumsum(own_count) - own_count
        for i, a, n in zip(rest.tolist(), at.tolist(), own_count.tolist(), strict=True):
            out[to[i] : to[i] + n] = own[a : a + n]
        return out, to


def width_of(path: str, end_id: int) -> str:
    """Two bytes an id where all fit, else four."""
    return "<u2" if max(tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def encode(docs: DataFrame, path: str, end_id: int, text: str = "text", out: str = "packed", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) and a struct column out: n, ids (packed by width_of), the end id with them. A null text is empty."""

    def make():
        own = Encoder(path, end_id)

        def work(texts: pa.Array) -> dict:
            ids, to = own.ids(texts)
            packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(to * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            return {"n": np.diff(to), "ids": packed}

        return work

    return with_struct(docs, text, out, "n long, ids binary", make, keep)


def count_ids(rows: DataFrame, ids: str, kind: str, size: int) -> np.ndarray:
    """How often each id below size occurs in all rows. A task sends one row an id; the driver gets one row an id."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch.set_column(0, ids, batch.column(0)), ids):
                data, _ = raw(part.column(0))
                total += np.bincount(np.frombuffer(data, kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used])})

    got = rows.select(ids).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


def save(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> None:
    """Write the ids of docs' texts, each with the end id behind it, as files under folder in ascending order of key.

    A null key comes first; rows that share a key stand by the digest of their ids, so those of other texts have a fixed order and
    repeated rows are written as often as they occur. A null text is empty and gives the end id alone. Of an empty table a
    manifest is written and no file. Texts of any length are tokenized whole; a row is never parted over files.
    """
    spark = docs.sparkSession
    kind = width_of(path, end_id)
    size = max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    once = f"{folder}-once"
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("body"))
    made = encode(source, path, end_id, "body", "p", ["key"])
    made.select("key", F.xxhash64("p.ids").alias("digest"), "p.n", "p.ids").write.option("compression", "zstd").parquet(once)
    rows = spark.read.parquet(once)
    code = Code(code_lengths(count_ids(rows, "ids", kind, size), max_bits))
    # The number of the row in the table parts equal rows over ranges, too.
    ordered = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange("key", "digest", "nth").sortWithinPartitions("key", "digest", "nth")

    def contents(batches):
        keys, ids, held, before = [], [], 0, 0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(x.as_buffer(), kind)
                if held and held + len(one) > FILE_IDS:
                    yield pack_file(code, keys, ids, before), held
                    keys, ids, held, before = [], [], 0, before + held
                keys.append(k)
                ids.append(one)
                held += len(one)
        if keys:
            yield pack_file(code, keys, ids, before), held

    write_files(ordered.select("key", "ids"), folder, SUFFIX, contents)
    remove(once)


def load(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of the files under folder: ids as little-endian unsigned 32-bit; start: the ids of all rows before it."""

    def run(batches):
        codes: dict = {}
        for batch in batches:
            for content, before in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                f = File(content.as_py(), codes)
                ends = np.cumsum(f.count)
                at = 0
                while at < len(ends):  # some megabytes of ids at a time, one row at least
                    lo = int(ends[at] - f.count[at])
                    to = max(at + 1, int(np.searchsorted(ends, lo + (1 << 20), side="right")))
                    data = f.read(lo, int(ends[to - 1])).astype("<u4")
                    cut = 4 * (np.concatenate([[lo], ends[at:to]]) - lo)
                    ids = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                    start = ends[at:to] - f.count[at:to] + before + f.head["before"]
                    yield pa.RecordBatch.from_arrays([pa.array(f.keys[at:to], mask=~f.known[at:to]), pa.array(start), pa.array(f.count[at:to]), ids], names=[key, "start", "n_tokens", "ids"])
                    at = to

    return read_files(spark, folder, SUFFIX).select("content", "before").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """What load gives for the files of save, in a new folder of the shared checkpoint folder."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/ids-{uuid.uuid4()}"
    save(docs, folder, path, end_id, text, key, max_bits)
    return load(docs.sparkSession, folder, key)
