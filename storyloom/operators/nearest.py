"""Exact nearest vectors by blocks: Spark deals the rows and pairs blocks of queries with slices of the corpus; a pair is one product of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import durable

#: Queries of a block and rows of a slice; rows of the corpus that one task sees beside one block.
BLOCK, SLICE, SHARE = 4096, 8192, 65_536
#: Distances are compared rounded to six places: what lies so near to the k-th best must stay. Queries that are multiplied at once.
NEAR, AT_ONCE = 1e-6, 128
PACK, FOUND = "dims int, cell int, ids binary, v binary", "query_id long, vec_id long, distance double"


def _packs(size: int, keep: int | None):
    """Rows (id, v) or (id, v, cell) as packs of up to size: ids and vectors as bytes, one number of dimensions and one cell each. Of equal vectors in a pack only the
    `keep` smallest ids are kept, as no others can be among a query's `keep` nearest."""

    def pack(cell: int, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], np.ascontiguousarray(v[order])
        if keep is not None and v.shape[1]:
            same = np.unique(v.view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
            by = np.argsort(same, kind="stable")
            first = np.r_[True, same[by][1:] != same[by][:-1]]
            nth = np.arange(by.size) - np.maximum.accumulate(np.where(first, np.arange(by.size), 0))
            stay = np.sort(by[nth < keep])
            ids, v = ids[stay], v[stay]
        yield int(v.shape[1]), cell, ids.tobytes(), v.tobytes()

    def run(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            cells = b.column(2).to_numpy(zero_copy_only=False) if b.num_columns > 2 else np.zeros(b.num_rows, np.int64)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            for dims, cell in np.unique(np.stack([lengths, cells], 1), axis=0).tolist():
                rows = np.flatnonzero((lengths == dims) & (cells == cell))
                have = held.setdefault((dims, cell), [])
                have.append((ids[rows], flat[starts[rows][:, None] + np.arange(dims)] + 0.0))  # zeros have one sign
                if sum(x[0].size for x in have) >= size:
                    i, w = (np.concatenate(x) for x in zip(*have, strict=True))
                    whole = size * (i.size // size)
                    held[dims, cell] = [(i[whole:], w[whole:])]
                    for s in range(0, whole, size):
                        yield from map(_batch, pack(cell, i[s : s + size], w[s : s + size]))
        for (_, cell), have in held.items():
            i, w = (np.concatenate(x) for x in zip(*have, strict=True))
            if i.size:
                yield from map(_batch, pack(cell, i, w))

    return run


def _batch(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary()), pa.array([row[3]], pa.binary())], ["dims", "cell", "ids", "v"])


def _best(held: tuple, k: int, n: int) -> tuple[tuple, np.ndarray]:
    """Of candidates (query, distance, id) those that may be among a query's k nearest after rounding, and each query's k-th distance."""
    r, d, i = held
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    at = np.arange(r.size)
    start = np.searchsorted(r, np.arange(n))
    last = np.searchsorted(r, np.arange(n), side="right")
    bound = np.full(n, np.inf)
    full = last - start >= k
    bound[full] = d[start[full] + k - 1]
    group = np.maximum.accumulate(np.where(np.r_[True, (r[1:] != r[:-1]) | (d[1:] != d[:-1])], at, 0)) if r.size else at
    stay = (d <= bound[r] + NEAR) & (at - group < k)
    return (r[stay], d[stay], i[stay]), bound


def _probed(q: np.ndarray, centres: tuple[np.ndarray, np.ndarray], probes: int) -> np.ndarray:
    """Is a cell, by its number, among a query's `probes` nearest?"""
    cells, at = centres
    out = np.zeros((q.shape[0], int(cells.max()) + 1), bool)
    for s in range(0, q.shape[0], AT_ONCE):
        far = (at * at).sum(1)[None, :] - 2.0 * (q[s : s + AT_ONCE] @ at.T)
        near = np.argsort(far, axis=1, kind="stable")[:, :probes]
        out[np.arange(s, s + far.shape[0])[:, None], cells[near]] = True
    return out


def _search(k: int, centres: tuple[np.ndarray, np.ndarray] | None = None, probes: int = 0, within: float = np.inf):
    """Pairs of packs as (query_id, vec_id, distance): each task's k nearest of every query, of those not farther than within, and what ties with them after rounding.

    With centres (cells' numbers and places, in order of number), a query only meets the packs of its `probes` nearest cells.
    """

    def run(batches):
        blocks: dict[bytes, list] = {}
        room = np.empty(AT_ONCE * SLICE)
        for b in batches:
            for row in b.to_pylist():
                if row["dims"] != row["q_dims"]:
                    continue
                ids, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"], np.float64).reshape(-1, row["dims"])
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_v"], np.float64).reshape(-1, row["dims"])
                none = np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, np.int64)
                block = blocks.setdefault(row["q_ids"] + bytes([row["dims"] % 251]), [q_ids, none, np.full(q_ids.size, within), None])
                if centres is not None and block[3] is None:
                    block[3] = _probed(q, centres, probes)
                asks = np.arange(q_ids.size) if centres is None else np.flatnonzero(block[3][:, row["cell"]])
                found = [block[1]]
                qq, vv = (q * q).sum(1), (v * v).sum(1)
                for s in range(0, asks.size, AT_ONCE):
                    part = asks[s : s + AT_ONCE]
                    far = room[: part.size * ids.size].reshape(part.size, ids.size)  # less the queries' own squares
                    np.matmul(-2.0 * q[part], v.T, out=far)
                    far += vv
                    # The product's error is far below this margin.
                    margin = 2 * NEAR + 1e-12 * (qq[part] + (vv.max() if vv.size else 0.0))
                    most = block[2][part] - qq[part] + margin
                    stay = far <= most[:, None]
                    many = np.flatnonzero(np.count_nonzero(stay, axis=1) > 2 * k)
                    if many.size:
                        most[many] = np.minimum(most[many], np.partition(far[many], k - 1, axis=1)[:, k - 1] + margin[many])
                        stay[many] = far[many] <= most[many, None]
                    x, y = np.nonzero(stay)
                    for t in range(0, x.size, 100_000):
                        xs, ys = x[t : t + 100_000], y[t : t + 100_000]
                        by = q[part][xs] - v[ys]
                        exact = np.cumsum(by * by, axis=1)[:, -1] if by.shape[1] else np.zeros(xs.size)  # summed in the dimensions' order
                        found.append((part[xs], exact, ids[ys]))
                block[1], best = _best(tuple(np.concatenate(c) for c in zip(*found, strict=True)), k, q_ids.size)
                block[2] = np.minimum(best, within)
        for q_ids, (r, d, i), *_ in blocks.values():
            for s in range(0, r.size, 50_000):
                e = s + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r[s:e]]), pa.array(i[s:e]), pa.array(d[s:e])], ["query_id", "vec_id", "distance"])

    return run


def _asked(queries: DataFrame) -> tuple[DataFrame, int]:
    q = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    blocks = max(1, -(-q.count() // BLOCK))
    return durable(q.repartition(blocks).mapInArrow(_packs(BLOCK, None), PACK)).select(*[F.col(x).alias(f"q_{x}") for x in ("dims", "ids", "v")]), blocks


def _shares(n: int, blocks: int, cores: int) -> int:
    return max(-(-n // SHARE), min(-(-2 * cores // blocks), -(-n // 1024)), 1)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, within: float = np.inf) -> DataFrame:
    """(query_id, vec_id, distance): for each query (query_id, embedding) its k nearest of corpus (vec_id, embedding) by squared L2, and a few more.
    Of those farther than within some are left out, which spares most of the work where few are so near.

    Exact: products of matrices only leave out what can't be near; the rest is summed term by term. Each task gives its own k nearest, so
    the rows still are to be ranked. Ids are whole numbers. Rows without a vector, or with one of another length than the query's, are left out.
    """
    c = corpus.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked, blocks = _asked(queries)
    shares = _shares(c.count(), blocks, queries.sparkSession.sparkContext.defaultParallelism)
    packed = durable(c.repartition(shares).mapInArrow(_packs(SLICE, k), PACK))
    return packed.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(_search(k, within=within), FOUND)


def nearest_in_cells(queries: DataFrame, centres: DataFrame, rows: DataFrame, k: int, probes: int) -> DataFrame:
    """As nearest, among rows (vec_id, embedding, cell, part) of the `probes` cells whose centres (cell, centre) are nearest to a query."""
    at = sorted((r["cell"], r["centre"]) for r in centres.select("cell", "centre").collect())
    if not at:
        return queries.sparkSession.createDataFrame([], FOUND)
    known = np.array([c for c, _ in at]), np.array([x for _, x in at], np.float64)
    asked, blocks = _asked(queries)
    shares = _shares(rows.count(), blocks, queries.sparkSession.sparkContext.defaultParallelism)
    c = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("cell").cast("long"), "part")
    packed = durable(c.repartition(shares, "cell", "part").drop("part").mapInArrow(_packs(SLICE, k), PACK))
    return packed.crossJoin(asked).mapInArrow(_search(k, known, probes), FOUND)
