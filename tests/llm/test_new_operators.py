"""Fill-in-the-middle, files of token ids and periodic runs, against plain Python on made-up edge rows and the smallest tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from storyloom.llm import files, fim, queries, runs, token_files
from storyloom.llm.common import raw
from tests.llm import brute
from tests.oracle import SF

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "doc_id long, text string, n long, ids string, __draw0 int, __words string, content string"


def rows_of(texts):
    return [(i, t, 7, "x", 1, "y", "z") for i, t in enumerate(texts)]


def edge_frame(spark, texts):
    """Rows with columns whose names the operators use themselves; the last row twice, and rows without a key."""
    rows = rows_of(texts)
    return spark.createDataFrame([*rows, rows[-1], (None, "no key here", 7, "x", 1, "y", "z"), (None, None, None, None, None, None, None)], CLASH).repartition(3)


TEXTS = [None, "", " \n", "one", "ab1c é日 <P", "x <P> y", "<S><M>", "A-b" * 50, "word " * 40_000, "é" * 500, "<|endoftext|> a<|endoftext|>\tb\x1cc \x85 it's I'LL", "a b c " * 30, "tail tail"]


# --- fill in the middle


def fim_of(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_edges(spark):
    docs = edge_frame(spark, TEXTS)
    got = fim.restore(fim.transform(docs), F.col("fim.output"), F.col("fim.form"))
    assert got.columns == [*docs.columns, "fim", "restored"]
    back = got.collect()
    assert len(back) == len(TEXTS) + 3
    for r in back:
        assert tuple(r["fim"]) == fim_of(r["doc_id"], r["text"]) and r["restored"] == (r["text"] or "") and r["n"] in (7, None)
    assert fim.restore(fim.transform(docs.limit(0)), F.col("fim.output"), F.col("fim.form")).count() == 0


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_fim_by_blocks(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "c", " ", "é", "日", "<", "<P", "S>", "1", "\n"]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    draws = [np.array([int(hashlib.sha256(f"1:{d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for d in range(len(texts))]) for i in range(4)]
    got = fim.transform_slice(*raw(pa.array(texts)), draws, 10, 20)
    outs = fim._strings(got["data"], got["off"])
    assert outs.to_pylist() == [fim_of(i, t)[4] for i, t in enumerate(texts)]
    assert {fim.FORMS[f] for f in got["form"]} == set(fim.FORMS)
    assert fim._strings(*fim.restore_slice(*raw(outs), got["form"])).to_pylist() == texts


def test_fim_restores_only_its_forms(spark):
    rows = [("<P>a<S>b<M>c", "psm", "acb"), ("<S>a<P>b<M>c", "spm", "bca"), ("<S>a<P>b<M>c", "psm", None), ("<P>a<S>b", "psm", None), ("x<P>a<S>b<M>", "psm", None), ("<P>", "plain", "<P>"), (None, "plain", None), ("a", None, None), ("<P><S><M>", "psm", "")]
    df = spark.createDataFrame(rows, "o string, f string, want string")
    assert [r["restored"] for r in fim.restore(df, F.col("o"), F.col("f")).collect()] == [r[2] for r in rows]


# --- files of token ids


def ids_of(text):
    return [*token_files.tokenizer(BYTE_BPE).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("most", [token_files.FILE_IDS, 50])
def test_token_files_edges(spark, monkeypatch, most):
    """Rows in order of key and digest, their starts without a gap, nulls first; one file, or one for nearly each row."""
    monkeypatch.setattr(token_files, "FILE_IDS", most)
    docs = edge_frame(spark, TEXTS).unionByName(spark.createDataFrame([(5, "of an equal key", 1, "x", 1, "y", "z")], CLASH))
    got = token_files.round_trip(docs, BYTE_BPE, 2).orderBy("start").collect()
    want = Counter((r["doc_id"], tuple(ids_of(r["text"]))) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in got) == want
    keys = [r["doc_id"] for r in got]
    assert keys == [None, None, *sorted(keys[2:])] and keys.count(5) == 2
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert token_files.round_trip(docs.limit(0), BYTE_BPE, 2).count() == 0


def test_token_files_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, at = {}, 0
    for d, t in docs:
        ids = ids_of(t)
        want[d] = at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op12_token_files(spark, SF).collect()} == want


def test_token_pieces_are_exact():
    """What is put together from pieces equals the tokenizer's own ids, whatever stands together."""
    rng = random.Random(2)
    parts = ["a", "B", "c ", " d", "  ", "\n", "\t", "é", "×", "÷", "ö.", "日", "—", "'", "'s", "'ll", "!", "1", "²", ",", "ÿ", "Ā", "…", " '", "<|endoftext|>", "\xa0", "\x1d"]
    texts = [None, "", *["".join(rng.choice(parts[: 24 if k % 2 else 27]) for _ in range(rng.randrange(30))) for k in range(4000)]]
    own = token_files.Encoder(BYTE_BPE, 2)
    assert own.parted
    for part in (texts, texts[::-1], [None], []):
        ids, to = own.ids(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)] == [ids_of(t) for t in part]


def test_unparted_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert not token_files.parted(token_files.tokenizer(path))
    docs = spark.createDataFrame([(2, "b <|startoftext|>"), (1, None)], "doc_id long, text string")
    got = [np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.round_trip(docs, path, 2).orderBy("start").collect()]
    assert got == [[2], [*token_files.tokenizer(path).encode("b <|startoftext|>", add_special_tokens=False).ids, 2]]


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    return cost


def test_code_lengths():
    """Optimal where the limit is far, within it and decodable where it is near, canonical always."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = (rng.random(rng.integers(3, 60)) ** 6 * 1000).astype(int)
        if np.count_nonzero(counts) < 3:
            continue
        assert (token_files.code_lengths(counts, 30).astype(int) * counts).sum() == huffman_cost(counts)
        short = token_files.code_lengths(counts, 6)
        assert 0 < short.max() <= 6 and sum(2.0 ** -int(x) for x in short if x) == 1
        code = token_files.Code(short)
        pairs = sorted((int(short[i]), i, int(code.codes[i])) for i in np.flatnonzero(short))
        assert [c << (6 - n) for n, _, c in pairs] == sorted(c << (6 - n) for n, _, c in pairs)
    assert token_files.code_lengths(np.array([0, 5])).tolist() == [0, 1] and token_files.code_lengths(np.array([0, 0])).tolist() == [0, 0]
    with pytest.raises(ValueError, match="no codes of 2 bits"):
        token_files.code_lengths(np.ones(5, int), 2)


def test_reading_begins_at_any_id():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 300_000) % 5000).astype(np.uint32)
    code = token_files.Code(token_files.code_lengths(np.bincount(ids, minlength=5000)))
    content = token_files.pack_file(code, [None, 4, -9], [ids[:5], ids[5:5], ids[5:]], 11)
    f = token_files.File(content)
    assert f.head["before"] == 11 and f.count.tolist() == [5, 0, len(ids) - 5] and f.keys[f.known].tolist() == [4, -9]
    for a, b in [(0, len(ids)), (0, 0), (65_535, 65_537), *[sorted(rng.integers(0, len(ids), 2).tolist()) for _ in range(100)]]:
        assert (f.read(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError, match="damaged"):
        token_files.File(content[:-3] + b"\0\0\0").read(0, len(ids))
    for bad in (b"", b"nothing of it", content[:-1]):
        with pytest.raises((ValueError, zlib.error)):
            token_files.File(bad)


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    """What another attempt left behind isn't read; without a manifest there is nothing to read."""
    folder = f"file://{tmp_path}/f"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    token_files.save(docs, folder, BYTE_BPE, 2)
    one = next((tmp_path / "f").glob("*.ids"))
    part, attempt, k = re.fullmatch(r"part-(\d+)-(\d+)-(\d+)\.ids", one.name).groups()
    (tmp_path / "f" / f"part-{part}-{int(attempt) + 1000}-{k}.ids").write_bytes(one.read_bytes())
    assert token_files.load(spark, folder).count() == 9
    (tmp_path / "f" / files.MANIFEST).unlink()
    with pytest.raises(FileNotFoundError):
        token_files.load(spark, folder)


# --- periodic runs


def runs_of(text):
    w = brute.words_of(text)
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    found = sorted((s, e - s, q) for (s, e), q in best.items())
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(n, seed=5):
    rng = random.Random(seed)

    def piece():
        kind = rng.randrange(6)
        if kind == 0:
            return [rng.choice("ab") for _ in range(rng.randrange(40))]
        if kind == 1:
            return [rng.choice(["x", "yy", "é"])] * rng.randrange(30)
        if kind == 2:
            return ([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20))] * rng.randrange(1, 8))[: rng.randrange(1, 150)]
        if kind == 3:
            return [f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        if kind == 4:
            return ([rng.choice("ab") for _ in range(5)] * rng.randrange(1, 5) + ["c"]) * rng.randrange(1, 5)
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(2, 9)):
            a, b = b, b + a
        return b

    return [rng.choice([" ", "\n", " \t "]).join(sum([piece() for _ in range(rng.randrange(6))], [])) for _ in range(n)]


def test_runs_against_brute_force():
    texts = [None, "", " \n", *periodic_texts(1500)]
    got = runs.detect_slice(*raw(pa.array(texts, pa.string())))
    for t, n, rs, c in zip(texts, got["n_words"].to_pylist(), got["runs"].to_pylist(), got["collapsed"].to_pylist(), strict=True):
        assert (n, [(r["start"], r["length"], r["period"]) for r in rs], c) == runs_of(t)


def test_runs_by_small_blocks(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 17)
    monkeypatch.setattr(runs, "HASHED", 9)
    for t in periodic_texts(150, 8):
        got = runs.detect_slice(*raw(pa.array([t])))
        assert [(r["start"], r["length"], r["period"]) for r in got["runs"][0].as_py()] == runs_of(t)[1]


def test_runs_edges(spark):
    docs = edge_frame(spark, [*TEXTS, " x\x0by " * 9, "p q " * 5 + "p q r " + "p q " * 6])
    got = runs.detect(docs)
    assert got.columns == [*docs.columns, "periodic"]
    for r in got.collect():
        p = r["periodic"]
        want = (len(r["text"].split()), [(0, 40_000, 1)], "word") if r["text"] and r["text"].startswith("word word") else runs_of(r["text"])
        assert (p["n_words"], [tuple(x) for x in p["runs"]], p["collapsed"]) == want
    assert runs.detect(docs.limit(0)).count() == 0


def test_repeated_tails(spark):
    docs = spark.createDataFrame([*[(i, f"a{i} b c d e f g h " * (i % 5)) for i in range(200)], (None, "a b c"), (1000, None)], "doc_id long, text string")
    for r in docs.select(F.col("doc_id"), F.col("text").alias("was")).join(runs.repeat_tails(docs), "doc_id").collect():
        h, w = zlib.crc32(str(r["doc_id"]).encode()), brute.words_of(r["was"])
        want = r["was"]
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        assert r["text"] == want, r["doc_id"]
    assert runs.repeat_tails(docs).filter("doc_id is null").first()["text"] == "a b c"
