"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit of the code one binary classifier over hashed byte n-grams tells the
languages whose bit is 1 from those whose bit is 0. A text's margins are decoded against all codewords by a loss that
weighs each bit by how reliably it came out right for that language on held-back rows; the nearest codeword wins, and a
runner-up that is almost as near marks the text as ambiguous.

The classifiers are naive Bayes: a bit's weights are log ratios of sums of the languages' n-gram counts, so one counting
job over the training rows fits all bits at once. The model has languages x BUCKETS numbers, whatever the input's size.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bound_batches, free_name, raw, slices, with_struct

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Bound of the fit: about this many rows of each label are learned from, chosen by a hash of the row's number.
TRAIN_ROWS = 20_000
#: One in so many of them is held back to weigh the bits.
HELD_BACK = 10
#: A runner-up whose loss is nearer than this marks a text as ambiguous.
MARGIN = 0.7


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[9, 10, 11, 12, 13]] = 32
    return t


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row starts) of all n-grams of each row, each row between spaces, so that no gram reaches into the next one.

    buckets has len(ORDERS) rows, one for each order; a row of n bytes has n + 1 grams of each order. Rows must not be empty of bytes.
    """
    n, gap = len(off) - 1, max(ORDERS)
    size = np.diff(off)
    padded = np.full(int(off[-1]) + gap * n, 32, dtype=np.uint8)
    at = np.repeat(gap * np.arange(n), size) + np.arange(int(off[-1]))
    padded[at + 1] = _lower()[data]  # one space before, the others behind
    wide = np.append(padded, np.full(gap, 32, np.uint8)).astype(np.uint64)
    begins = np.zeros(len(padded), dtype=bool)
    begins[at] = True
    begins[off[1:] + gap * np.arange(n)] = True
    code, out = np.zeros(len(padded), np.uint64), []
    for k in range(gap):
        code = (code << np.uint64(8)) | wide[k : k + len(padded)]
        if k + 1 in ORDERS:
            h = (code[begins] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            out.append((h >> np.uint64(48)).astype(np.int32))
    return np.stack(out), off[:-1] + np.arange(n)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    code: np.ndarray  # labels x bits, +1 or -1
    weights: np.ndarray  # BUCKETS x bits
    trust: np.ndarray  # labels x bits, rows sum to the number of bits


def codewords(n: int) -> np.ndarray:
    """n codewords: all splits of up to seven labels, else the best spread of a few fixed random draws."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        bits = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(bits, dtype=np.int8).T
    rng = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), size=(n, math.ceil(10 * math.log2(n))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = (code.shape[1] - (code.astype(int) @ code.T.astype(int))) // 2
        np.fill_diagonal(gap, code.shape[1])
        if gap.min() > far:
            best, far = code, gap.min()
    return best


def margins(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bits summed log ratios, number of grams a row) of rows with at least a byte each."""
    bucket, starts = grams(data, off)
    sums = np.zeros((len(starts), model.weights.shape[1]), np.float64)
    for row in bucket:
        sums += np.add.reduceat(model.weights[row], starts, axis=0, dtype=np.float64)
    return sums, (np.diff(off) + 1) * len(bucket)


def losses(model: Model, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows x labels: the weighted logistic losses of each codeword. Margins are means, scaled by a root of the length."""
    f = sums / count[:, None] * np.minimum(np.sqrt(count), 40.0)[:, None]
    out = np.zeros((len(sums), len(model.labels)))
    for k in range(len(model.labels)):
        out[:, k] = (np.logaddexp(0, -model.code[k] * f) * model.trust[k]).sum(axis=1)
    return out


def _chosen(docs: DataFrame, text: str, label: str, key: str, per_label: int) -> DataFrame:
    """About per_label rows of each label, by a hash of the key, with a mark for those held back."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))  # as many rows as labels
    share = F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("__n"))
    spot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    back = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("back")), F.lit(HELD_BACK)) == 0
    return rows.join(F.broadcast(counts), label).filter(spot < share).select(F.col(text).alias("text"), F.col(label).alias("label"), back.alias("back"))


def _runs(batch: pa.RecordBatch):
    """(labels, data, offsets) of slices; the slice is small because a byte makes several grams."""
    for part in slices(batch, "text", SLICE_BYTES // 4):
        yield part.column(1).to_pylist(), *raw(part.column(0))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = TRAIN_ROWS) -> Model:
    """Learn the labels of docs from a bounded sample of rows with a text and a label. No such row: a model of no label."""
    bound_batches(docs.sparkSession)
    chosen = _chosen(docs, text, label, key, per_label)

    def tally(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for labels, data, off in _runs(batch):
                bucket, starts = grams(data, off)
                ends = np.append(starts[1:], bucket.shape[1])
                names = sorted(set(labels))
                at = np.repeat(np.searchsorted(names, labels) if names else [], ends - starts)
                for i, name in enumerate(names):
                    mine = bucket[:, at == i]
                    sums[name] = sums.get(name, 0) + np.bincount(mine.ravel(), minlength=BUCKETS)
        for name, x in sums.items():
            hit = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"label": [name] * len(hit), "bucket": hit.astype(np.int32), "n": x[hit].astype(np.int64)})

    counts = chosen.filter(~F.col("back")).select("text", "label").mapInArrow(tally, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = tuple(sorted(counts["label"].unique()))
    code = codewords(len(labels))
    table = np.zeros((len(labels), BUCKETS))
    if labels:
        table[np.searchsorted(labels, counts["label"]), counts["bucket"]] = counts["n"]
    rate = table / np.maximum(table.sum(axis=1, keepdims=True), 1)  # each label counts alike, however many rows it has
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        pos, neg = rate[code[:, b] > 0].mean(axis=0) + 1e-7, rate[code[:, b] < 0].mean(axis=0) + 1e-7
        weights[:, b] = np.log(pos / neg)
    model = Model(labels, code, weights, np.ones(code.shape))
    if len(labels) < 2:
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def trial(batches):
        good = np.zeros((len(labels), code.shape[1] + 1), np.int64)
        for batch in batches:
            for names, data, off in _runs(batch):
                known = np.isin(names, labels)
                sums, _ = margins(held.value, data, off)
                k = np.searchsorted(labels, np.array(names)[known])
                np.add.at(good[:, :-1], k, (sums[known] * code[k]) > 0)
                np.add.at(good[:, -1], k, 1)
        yield pa.RecordBatch.from_pydict({"label": list(labels), "good": good.tolist()})

    tried = chosen.filter("back").select("text", "label").mapInArrow(trial, "label string, good array<long>")
    each = [F.sum(F.col("good")[b]).alias(f"g{b}") for b in range(code.shape[1] + 1)]
    trust = np.ones(code.shape)
    for row in tried.groupBy("label").agg(*each).collect():  # one row a label
        if row[-1]:
            trust[labels.index(row[0])] = (np.array(row[1:-1]) + 1) / (row[-1] + 2)
    return Model(labels, code, weights, trust * (code.shape[1] / trust.sum(axis=1, keepdims=True)))


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) and a struct column out: lang, score (0 to 1), runner_up, margin, ambiguous.

    lang is UNKNOWN with score 0 where the text is null, has no letter, or nothing was learned. Whole texts are read.
    Row by row: no shuffle; repeated rows get the same answer. Of equal losses the label that sorts first wins.
    """
    keep = docs.columns if keep is None else keep
    letters = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"\p{L}")
    body = free_name(docs, "__letters")
    rows = docs.withColumn(body, F.when(letters, F.col(f"`{text}`")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def work(texts: pa.Array) -> dict:
            n = len(texts)
            lang, score, second, gap = [UNKNOWN] * n, np.zeros(n), [None] * n, np.zeros(n)
            data, off = raw(texts)
            full = np.flatnonzero(np.diff(off))
            if len(full) and m.labels:
                lens = np.diff(off)[full]
                own = np.concatenate([[0], np.cumsum(lens)])  # empty rows take no bytes
                loss = np.zeros((len(full), len(m.labels)))
                at = 0
                while at < len(full):  # a quarter of a slice at a time
                    to = max(at + 1, int(np.searchsorted(own, own[at] + SLICE_BYTES // 4, side="right")) - 1)
                    loss[at:to] = losses(m, *margins(m, data[own[at] : own[to]], own[at : to + 1] - own[at]))
                    at = to
                order = np.argsort(loss, axis=1, kind="stable")
                near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
                share = near.max(axis=1) / near.sum(axis=1)
                for j, i in enumerate(full):
                    lang[i], score[i] = m.labels[order[j, 0]], share[j]
                    if len(m.labels) > 1:
                        second[i] = m.labels[order[j, 1]]
                        gap[i] = loss[j, order[j, 1]] - loss[j, order[j, 0]]
            sure = (gap >= MARGIN) | (score > 0) & (len(m.labels) == 1)
            return {"lang": lang, "score": score, "runner_up": second, "margin": gap, "ambiguous": ~sure}

        return work

    return with_struct(rows, body, out, "lang string, score double, runner_up string, margin double, ambiguous boolean", make, keep)


def learnable(key: Column) -> Column:
    """True for the rows that may be learned from: crc32 of the key as text, modulo 3, isn't 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def accept(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """The documents in some language, columns as they came: those rejected have no letter, or no codeword nearer than others."""
    model = fit(docs.filter(learnable(F.col(key))), text, label, key)
    out = free_name(docs, "__language")
    good = identify(docs, model, text, out).filter((F.col(f"{out}.lang") != UNKNOWN) & ((F.col(f"{out}.score") > 0.4) | (F.lit(len(model.labels)) < 2)))
    return good.select(*[F.col(f"`{c}`") for c in docs.columns])


