"""What the operators of this subpackage share: reading, Arrow slices, byte arrays, checkpoints.

Texts travel to Python tasks as Arrow batches and are viewed as one byte array with offsets, so that the work on
them is a few vector operations over a slice of a few megabytes. A slice always holds whole texts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python task works on at once (a single longer text is its own slice).
SLICE_BYTES = 2 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes too: ten thousand long texts at once would not fit in a worker. Spark reads the setting when a
    query runs, so it stays set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where it names none, one of this machine's if Spark runs on it alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="storyloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*tables: DataFrame) -> None:
    """The files of durable() tables that nothing will read again go; else they stay until the driver happens to collect its garbage."""
    for t in tables:
        drop(t.sparkSession, t._jdf.queryExecution().logical().rdd().getCheckpointFile().get())


def drop(spark: SparkSession, path: str) -> None:
    """A folder in a place that Spark reads goes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files when it ends; else they stay on disk until the driver happens to collect its garbage.

    It is for chains of durable() tables: each is written once, and nothing goes back to the shuffles behind it.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. Row i is bytes[offsets[i]:offsets[i + 1]]."""
    texts = pa.concat_arrays([texts.fill_null("")]) if texts.null_count or texts.offset else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose texts have most bytes at most, one row at least."""
    if not batch.num_rows:
        return
    _, off = raw(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Hand freed memory back to the machine at a task's end, as a worker process lives on and Spark shares the executor's memory with it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def with_struct(df: DataFrame, text: str, name: str, ddl: str, make: Callable[[], Callable[[pa.Array], dict]], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) and a struct column name of type ddl, computed from slices of the column text.

    make() is called once for each task; what it returns maps a string array to a dict of Arrow arrays or lists, one
    for each field of the struct. Other columns pass through untouched, whatever they are called.
    """
    bound_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    fields = T._parse_datatype_string(ddl)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, fields, False)])
    kinds = {f.name: f.dataType for f in fields.fields}
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = {k: to_arrow_type(v) for k, v in kinds.items()}
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                made = work(part.column(part.schema.get_field_index(text)))
                cols = [made[k] if isinstance(made[k], pa.Array) else pa.array(made[k], type=types[k]) for k in types]
                cols = [c if c.type == t else c.cast(t) for c, t in zip(cols, types.values(), strict=True)]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.StructArray.from_arrays(cols, names=list(types))], names=[*keep, name])
        del work
        give_back()

    return source.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of each data[start:end], the same wherever that content stands."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64))
    np.cumsum(table[data] * powers(BASE, n), out=total[1:])
    back = powers(_BACK, n + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def tokens(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the runs of bytes that aren't gaps, none across two rows; first[i]: row i's first run."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[off[:-1]] = edge[off[1:]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, off)
