"""A streaming source of changed rows that gives a bounded number of rows a trigger, whatever their files' sizes.

Change files are Parquet, landed in a folder under names that ascend in order of arrival (or by their times of change). The offset is a place in
that order: a file's name and the rows of it that were read. A query that starts again goes on at the row. Each trigger reads the next rows alone,
so what passes through the driver, as it does with this kind of source, is `rows` rows (20 where not said).

A trigger has its own cost whatever it reads, and a stream's triggers come one after the other. So several streams can share the folder as lanes,
each with the files of some writers and an offset of its own. Order then holds in a lane: rows that must follow each other come from one writer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

NAME = "row_changes"


def _values(column) -> list:
    """As Python values; times, which files hold in UTC, with their zone."""
    import pyarrow as pa

    return (column.cast(pa.timestamp("us", "UTC"), safe=False) if pa.types.is_timestamp(column.type) else column).to_pylist()


def _lane(name: str, lanes: int) -> int:
    """Of a file: by its writer's number where the name has one (part-00002-...), else by the name."""
    writer = re.match(r"part-(\d+)", name)
    return (int(writer[1]) if writer else zlib.crc32(name.encode())) % lanes


class _Place:
    """An open file at a row. Row groups before it aren't read; the next rows go on where the last ones ended."""

    def __init__(self, store, file: tuple[int, str], row: int, columns: list[str], size: int):
        import pyarrow.parquet as pq

        opened, first, groups = pq.ParquetFile(file[1], filesystem=store), 0, []
        for g in range(opened.num_row_groups):
            n = opened.metadata.row_group(g).num_rows
            if groups or row < first + n:
                groups.append(g)
            else:
                first += n
        self.file, self.row, self.most, self.rest = file, row, max(opened.metadata.num_rows - row, 0), None
        self.batches = opened.iter_batches(batch_size=size, row_groups=groups, columns=columns) if groups else iter(())
        self.skip = row - first

    def take(self, n: int) -> Iterator:
        """The next n rows, as slices of record batches."""
        while n > 0:
            batch = self.rest if self.rest is not None else next(self.batches)
            lo = min(self.skip, batch.num_rows)
            hi = min(batch.num_rows, lo + n)
            self.skip -= lo
            self.rest = batch.slice(hi) if hi < batch.num_rows else None
            if lo < hi:
                n, self.row, self.most = n - (hi - lo), self.row + hi - lo, self.most - (hi - lo)
                yield batch.slice(lo, hi - lo)


class ChangedRows(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, rows: int, columns: list[str], lane: int = 0, lanes: int = 1):
        self.folder, self.rows, self.columns, self.lane, self.lanes = folder, rows, columns, lane, lanes
        self._place: _Place | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "file": "", "row": 0}

    def _files(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")) and _lane(f.base_name, self.lanes) == self.lane]
        return store, sorted((f.mtime_ns or 0, f.path) for f in found)

    def _after(self, start: dict, most: int | None, end: dict | None = None) -> tuple[list[tuple], dict]:
        """The rows from start on, `most` of them or up to end, and the offset behind them."""
        store, files = self._files()
        at, out = dict(start), []
        for time, path in files:
            if (time, path) < (at["time"], at["file"]) or end and (time, path) > (end["time"], end["file"]):
                continue
            row = at["row"] if path == at["file"] else 0
            if self._place is None or (self._place.file, self._place.row) != ((time, path), row):
                self._place = _Place(store, (time, path), row, self.columns, max(most or 0, 1000))
            stop = end["row"] - row if end and path == end["file"] else None
            for part in self._place.take(min(x for x in (stop, None if most is None else most - len(out), self._place.most) if x is not None)):
                out += list(zip(*[_values(part.column(part.schema.get_field_index(c))) for c in self.columns], strict=True))
            at = {"time": time, "file": path, "row": self._place.row}
            if most is not None and len(out) >= most:
                break
        return out, at

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}  # tasks open files of their own

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = self._after(start, self.rows)
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._after(start, None, end)[0])

    def commit(self, end: dict) -> None:
        pass


class RowChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def simpleStreamReader(self, schema: StructType) -> ChangedRows:  # noqa: N802
        return ChangedRows(self.options["path"], int(self.options.get("rows", "20")), schema.fieldNames(), int(self.options.get("lane", "0")), int(self.options.get("lanes", "1")))


def row_changes(spark: SparkSession, path: str, schema: StructType, rows: int = 20, lane: int = 0, lanes: int = 1) -> DataFrame:
    """A stream over the rows of the change files under path (of one lane of them), at most `rows` a trigger; a checkpoint resumes it at the row."""
    spark.dataSource.register(RowChanges)
    return spark.readStream.format(NAME).schema(schema).option("path", path).option("rows", rows).option("lane", lane).option("lanes", lanes).load()


def drain_rows(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run the stream batch by batch over what there is, and stop. `each` must be idempotent by batch id."""
    drain_lanes([stream], lambda lane: checkpoint, lambda df, lane, n: each(df, n))


def drain_lanes(streams: list[DataFrame], checkpoint: Callable[[int], str], each: Callable[[DataFrame, int, int], None]) -> None:
    """Run the streams side by side over what there is, and stop. `each` must be idempotent by lane and batch id; checkpoint names each lane's folder."""
    running = []
    try:
        for i, stream in enumerate(streams):
            running.append(stream.writeStream.option("checkpointLocation", checkpoint(i)).foreachBatch(lambda df, n, i=i: each(df, i, n)).start())
        for query in running:
            query.processAllAvailable()
    finally:
        for query in running:
            query.stop()
