"""Files of an own format that tasks write side by side, and their commit.

A task names its files by its partition, its attempt and a count, so two attempts at one partition never write one file.
The job's result says which attempt of each partition ended well; the driver writes that as the folder's manifest, one line a
partition, last of all. Readers take the files that the manifest names: what a lost executor or a second attempt left
behind is not read, and a folder without a manifest was never finished.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


def write_files(rows: DataFrame, folder: str, suffix: str, contents: Callable[[Iterable[pa.RecordBatch]], Iterable[tuple[bytes, int]]]) -> list[dict]:
    """Write what contents makes of each partition's batches: (bytes, units) of a file each. Returns the manifest: part, attempt, files, units.

    folder is a place that all tasks and the driver reach by one address. The driver gets one row a partition.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt, files, units = context.partitionId(), context.taskAttemptId(), 0, 0
        for content, n in contents(batches):
            with store.open_output_stream(f"{base}/part-{part:06d}-{attempt}-{files:06d}{suffix}", compression=None) as f:
                f.write(content)
            files, units = files + 1, units + n
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in (("part", part), ("attempt", attempt), ("files", files), ("units", units))})

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    done = [r.asDict() for r in rows.mapInArrow(run, "part long, attempt long, files long, units long").collect()]
    done = sorted((r for r in done if r["files"]), key=lambda r: r["part"])
    with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as f:
        f.write("\n".join(map(json.dumps, done)).encode())
    return done


def manifest(folder: str) -> list[dict]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return [json.loads(x) for x in f.read().decode().split("\n") if x]


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, part, before, content) of the files that the folder's manifest names, by Spark's source of binary files; before: the units of earlier parts."""
    rows, before = [], 0
    for r in manifest(folder):
        rows.append((r["part"], r["attempt"], before))
        before += r["units"]
    known = spark.createDataFrame(rows, "part long, attempt long, before long")  # a row a partition
    found = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"part-*{suffix}").load(folder)
    name = lambda k: F.regexp_extract("path", r"part-(\d+)-(\d+)-\d+[^/]*$", k).cast("long")
    return found.select("path", name(1).alias("part"), name(2).alias("attempt"), "content").join(F.broadcast(known), ["part", "attempt"]).select("path", "part", "before", "content")


def remove(folder: str) -> None:
    """The folder goes, if it is there."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(base).type != fs.FileType.NotFound:
        store.delete_dir(base)
