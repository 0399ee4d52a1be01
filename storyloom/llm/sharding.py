"""Sharding along a Hilbert curve.

Each row gets a cell from a few quantised metadata dimensions; cells are walked in curve order, and equal runs of that
walk are the shards, so that a file holds a small box of the metadata space and readers prune files on any dimension.

The global rank needs no global sort. A row's place is the rows in earlier cells (a fixed number of cells), plus the
rows in earlier salts of its cell (one for each ROWS_A_SALT rows of the table), plus its place in its own cell and salt. Only
these three counts move between tasks, so a third of all rows in one cell spreads over its salts, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BITS = 4
#: Salts of a cell: this many at least, one for so many rows at least.
SALTS, ROWS_A_SALT = 256, 500_000


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of coords (n x dimensions, each below 2**bits)."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(dims):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def cell_of(dims: list[Column], bits: int = BITS) -> Column:
    """The curve index of integer columns, each clipped to 0 .. 2**bits - 1; null counts as 0."""
    top = (1 << bits) - 1

    @F.pandas_udf(T.LongType())
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([c.to_numpy() for c in cols], axis=1), bits))

    return index(*[F.coalesce(F.least(F.greatest(d.cast("int"), F.lit(0)), F.lit(top)), F.lit(0)) for d in dims])


def document_dims(size: str, lang: str, source: str) -> list[Column]:
    """log2 of the size from 16 bytes up, and small hashes of language and source."""
    return [F.floor(F.log2(F.greatest(F.col(size), F.lit(1)))) - 4, F.pmod(F.xxhash64(F.col(lang)), F.lit(16)), F.pmod(F.xxhash64(F.col(source)), F.lit(16))]


def shard(df: DataFrame, dims: list[Column], order: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """df with `cell`, `shard` (0 .. shards - 1) and `slot` (gapless from 0 in each shard); row counts differ by one at most.

    Within a cell rows run by a hash of order's columns and then by these columns; rows equal in all of them are
    interchangeable. Null values of order sort first. Columns of df named like the three are replaced. An empty table
    stays empty; with fewer rows than shards, some shards stay empty.
    """
    df = df.drop("cell", "shard", "slot")
    salts = max(SALTS, df.count() // ROWS_A_SALT)
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    rows = df.withColumns({"cell": cell_of(dims, bits), "__salt": salt})
    counts = rows.groupBy("cell", "__salt").agg(F.count("*").alias("__n"))
    cells = counts.groupBy("cell").agg(F.sum("__n").alias("__m"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**(bits * dimensions) rows
    total = Window.partitionBy()
    cells = cells.select("cell", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"), F.sum("__m").over(total).alias("__total"))
    within = Window.partitionBy("cell").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)  # salts rows at most
    starts = counts.join(F.broadcast(cells), "cell").select("cell", "__salt", "__total", (F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__start"))
    place = Window.partitionBy("cell", "__salt").orderBy(*order)
    rows = rows.withColumn("__place", F.row_number().over(place) - 1).join(starts, ["cell", "__salt"])
    rank = F.col("__start") + F.col("__place")
    cut = F.expr(f"cast((__start + __place) * {shards} div __total as int)")
    rows = rows.withColumn("shard", cut)
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return rows.withColumn("slot", (rank - first).cast("long")).select(*df.columns, "cell", "shard", "slot")


def ranges(cut: DataFrame, cols: list[str]) -> DataFrame:
    """(shard, rows, low_c and high_c of each of cols): what a reader needs to skip shards that a filter can't touch."""
    return cut.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("low", F.min), ("high", F.max))])
