"""Fill-in-the-middle transformation by displacement scatter.

A slice of texts is one byte array. A scan counts the units of each text (runs of ASCII letters, and single other
characters) and finds the bytes where its two cuts fall. Prefix, middle and suffix then each move by one distance, so the
output place of every byte of the slice is given by a few numbers a text: they are put into a difference array at the
segments' first bytes, its cumulative sum is the displacement of each byte, and one scatter writes all outputs. Restoring is
the inverse: sentinels are found in the output, their segments give the difference array, and one gather reads the texts back.

Bytes are moved in blocks, so what is held beside a text and its output is masks and counts, about ten times its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_name, raw, slices

SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes that are moved at once.
BLOCK = 1 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_P, _S, _M = (b[1] for b in SENTINELS.values())


def move(out: np.ndarray, data: np.ndarray, at: np.ndarray, by: np.ndarray, total: int, gather: bool = False) -> None:
    """out[i + shift(i)] = data[i] for i below total, or with gather out[i] = data[i + shift(i)]; from at[k] on, the shift is by[k].

    at ascends; where entries are equal the last holds. The difference array of a block is summed up to the displacements.
    """
    if not total:
        return
    step = np.diff(by, prepend=0)
    edge = np.searchsorted(at, np.arange(0, total + BLOCK, BLOCK))
    carry = 0
    for k, lo in enumerate(range(0, total, BLOCK)):
        hi = min(lo + BLOCK, total)
        a, b = edge[k], edge[k + 1]
        shift = np.zeros(hi - lo + 1, np.int64)
        np.add.at(shift, at[a:b] - lo, step[a:b])
        shift[0] += carry
        place = np.cumsum(shift)[:-1]
        carry = int(place[-1]) + int(shift[-1])
        place += np.arange(lo, hi)
        if gather:
            out[lo:hi] = data[place]
        else:
            out[place] = data[lo:hi]


def _before(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and before the end."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def marks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the sentinels that stand within one row."""
    at = np.flatnonzero(data == ord("<"))
    at = at[at + 2 < len(data)]
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], (_P, _S, _M))]
    row = np.searchsorted(off, at, side="right") - 1
    inside = at + 3 <= off[row + 1]
    return at[inside], row[inside]


def scan(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units, chars): how many units, and how many characters, begin before each byte. A unit never reaches into the next row."""
    lead = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = True
    return _before(start), _before(lead)


def transform_slice(data: np.ndarray, off: np.ndarray, draws: list[np.ndarray], plain_percent: int, spm_percent: int) -> dict[str, np.ndarray]:
    """n, form, places and lengths of a slice's rows, and its output bytes with their offsets. draws: four unsigned numbers a row."""
    rows = len(off) - 1
    units, chars = scan(data, off)
    n = (units[off[1:]] - units[off[:-1]]).astype(np.int64)
    x, y = draws[0] % (n + 1), draws[1] % (n + 1)
    # The k-th unit of a row begins at the first byte up to which more than k units have begun; beyond the last one is the end.
    cut = [np.where(k < n, np.searchsorted(units[1:], units[off[:-1]] + k, side="right"), off[1:]) for k in (np.minimum(x, y), np.maximum(x, y))]
    marked = np.zeros(rows, dtype=bool)
    marked[marks(data, off)[1]] = True
    plain = (n == 0) | marked | (draws[2] % 100 >= 100 - plain_percent)
    form = np.where(plain, PLAIN, np.where(draws[3] % 100 < spm_percent, SPM, PSM))
    lp, lm, ls = cut[0] - off[:-1], cut[1] - cut[0], off[1:] - cut[1]
    size = np.diff(off) + np.where(plain, 0, 9)
    to = np.concatenate([[0], np.cumsum(size)])
    base = to[:-1] - off[:-1]
    spm = form == SPM
    shift = np.stack([base + np.where(plain, 0, np.where(spm, 6 + ls, 3)), base + np.where(plain, 0, 9 + ls), base + np.where(plain, 0, np.where(spm, 3 - lp - lm, 6 - lm))], axis=1)
    out = np.empty(int(to[-1]), np.uint8)
    move(out, data, np.stack([off[:-1], cut[0], cut[1]], axis=1).ravel(), shift.ravel(), len(data))
    some = np.flatnonzero(~plain)
    own = to[:-1][some]
    where = {
        "prefix": own + np.where(spm[some], 3 + ls[some], 0),
        "suffix": own + np.where(spm[some], 0, 3 + lp[some]),
        "middle": own + 6 + lp[some] + ls[some],
    }
    for name, word in SENTINELS.items():
        for i, byte in enumerate(word):
            out[where[name] + i] = byte
    counts = chars[cut[0]] - chars[off[:-1]], chars[cut[1]] - chars[cut[0]]
    return {"n": n, "form": form, "plain": plain, "prefix_chars": counts[0].astype(np.int64), "middle_chars": counts[1].astype(np.int64), "data": out, "off": to}


def restore_slice(data: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, fine): the texts of outputs, and which rows have the sentinels of their form. Others are empty."""
    rows = len(off) - 1
    at, row = marks(data, off)
    plain = form == PLAIN
    keep = ~plain[row]
    at, row = at[keep], row[keep]
    count = np.bincount(row, minlength=rows)
    fine = plain | (count == 3) & (form > PLAIN)
    three = fine[row]
    some = np.flatnonzero(fine & ~plain)
    s = at[three].reshape(-1, 3)
    kinds = data[s + 1]
    order = np.where((form[some] == SPM)[:, None], np.array([_S, _P, _M]), np.array([_P, _S, _M]))
    good = (kinds == order).all(axis=1) & (s[:, 0] == off[:-1][some])
    fine[some[~good]] = False
    some, s = some[good], s[good]
    size = np.where(fine, np.diff(off), 0)
    size[some] -= 9
    to = np.concatenate([[0], np.cumsum(size)])
    spm = form[some] == SPM
    first = np.where(spm, s[:, 1], s[:, 0]) + 3  # where prefix, middle and suffix begin in the output
    last = np.where(spm, s[:, 0], s[:, 1]) + 3
    lp = np.where(spm, s[:, 2], s[:, 1]) - first
    lm = off[1:][some] - s[:, 2] - 3
    begin = np.repeat(to[:-1, None], 3, axis=1)
    source = np.repeat(off[:-1, None], 3, axis=1)
    begin[some, 1] += lp
    begin[some, 2] += lp + lm
    source[some, 0], source[some, 1], source[some, 2] = first, s[:, 2] + 3, last
    out = np.empty(int(to[-1]), np.uint8)
    move(out, data, begin.ravel(), (source - begin).ravel(), len(out), gather=True)
    return out, to, fine


def _strings(data: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    wide = off[-1] >= 1 << 31
    kind = pa.large_string() if wide else pa.string()
    return pa.Array.from_buffers(kind, len(off) - 1, [bits, pa.py_buffer(off.astype(np.int64 if wide else np.int32)), pa.py_buffer(data)])


def draws_of(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers: the first hex digits, by eights, of the sha256 of `seed:key`. A null key counts as empty."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) and a struct column out: n units, form, lengths of prefix and middle in characters, output.

    The cuts and the form are drawn from the key, so a row gives the same output wherever and however often it stands;
    repeated rows are answered alike. plain_percent of the texts stay as they are, as do empty ones, null (whose output is
    empty) and those in which a sentinel stands; of the others spm_percent have their suffix first. The lengths of a
    plain row are null. A text of any length is transformed whole. An empty table stays empty. Row by row: no shuffle.
    """
    bound_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    names: list[str] = []
    for i in range(4):
        names.append(free_name(docs, f"__draw{i}"))
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], *[d.alias(n) for d, n in zip(draws_of(F.col(f"`{key}`"), seed), names, strict=True)])
    made = T._parse_datatype_string(MADE)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, made, False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                data, off = raw(column(text))
                got = transform_slice(data, off, [column(c).to_numpy() for c in names], plain_percent, spm_percent)
                fields = [
                    pa.array(got["n"]), pa.array(np.array(FORMS, dtype=object)[got["form"]], pa.string()), pa.array(got["prefix_chars"], mask=got["plain"]), pa.array(got["middle_chars"], mask=got["plain"]),
                    _strings(got["data"], got["off"]).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*map(column, keep), pa.StructArray.from_arrays(fields, names=made.names)], names=[*keep, out])

    return source.mapInArrow(run, schema)


def restore(rows: DataFrame, output: Column, form: Column, out: str = "restored") -> DataFrame:
    """rows and a string column out: the text of an output of transform and its form, nothing else.

    Null where output or form is null, or the output hasn't the sentinels of its form, each once and in their places.
    Row by row; repeated rows are answered alike, an empty table stays empty.
    """
    bound_batches(rows.sparkSession)
    a, b = free_name(rows, "__output"), free_name(rows, "__form")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    keep = rows.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, a):
                column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                data, off = raw(column(a))
                code = np.array([FORMS.index(x) if x in FORMS else -1 for x in column(b).to_pylist()], np.int64)
                code[column(a).is_null().to_numpy(zero_copy_only=False)] = -1
                made, to, fine = restore_slice(data, off, code)
                yield pa.RecordBatch.from_arrays([*map(column, keep), _strings(made, to, fine).cast(pa.string())], names=[*keep, out])

    return rows.select("*", output.alias(a), form.alias(b)).mapInArrow(run, schema)
