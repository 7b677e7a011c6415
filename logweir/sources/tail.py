"""A streaming source of growing log files.

The offset of a batch is the end of the last finished line of every file, so an
appended file gives only its new lines and a line still being written is held back
until its end is there, or until its file has not changed for a while.  New bytes
are cut into splits of bounded size, whichever files they are in; a split gives the
lines that begin in it.

Files are opened with Arrow's file systems (local, HDFS, S3, GCS, ABFS).  Stores that
only Spark can read are served by ``lines.stream_log``, which takes whole new files.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from logweir.functions import text as X
from logweir.session import arrow_files

SPLIT = 64 << 20
HOLD = 10.0  # seconds without a change after which an unfinished last line counts as finished
BLOCK = 1 << 20
ROWS = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("value", pa.string())])


def finished(system, path: str, begin: int, size: int) -> int:
    """The end of the last line that is finished, between two places of a file."""
    with system.open_input_file(path) as f:
        end = size
        while end > begin:
            low = max(begin, end - BLOCK)
            at = f.read_at(end - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return begin


def lines_from(f, low: int, begin: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that begin in [begin, end) of the bytes [low, size) of a file."""
    at = begin
    if begin > low:  # the line that holds the byte before begins before
        at = begin - 1
        while at < size:
            block = f.read_at(min(BLOCK, size - at), at)
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(block)
    rest = b""
    start = at  # of the line that ``rest`` holds the beginning of
    while start < end and at < size:
        block = f.read_at(min(BLOCK, size - at), at)
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if start >= end:
                return
            yield line
            start += len(line) + 1
    if rest and start < end:
        yield rest


class Split(InputPartition):
    def __init__(self, path: str, low: int, begin: int, end: int, size: int):
        self.path, self.low, self.begin, self.end, self.size = path, low, begin, end, size


class TailReader(DataSourceStreamReader):
    """Offsets are {"files": {path: end}}: one number a file of the folder, so files that are done should be
    moved away.  A file that has become shorter is read from its start."""

    def __init__(self, folder: str, split: int, hold: float):
        self.folder, self.split, self.hold = folder, split, hold

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = arrow_files(self.folder)
        ends = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = f.base_name
            if f.is_file and not name.startswith((".", "_")):
                settled = f.mtime is not None and time.time() - f.mtime.timestamp() > self.hold
                ends[f.path] = f.size if settled else finished(system, f.path, 0, f.size)
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, out = json.loads(start["files"]), []
        for path, size in json.loads(end["files"]).items():
            low = before.get(path, 0)
            low = 0 if size < low else low
            out += [Split(path, low, at, min(at + self.split, size), size) for at in range(low, size, self.split)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = arrow_files(self.folder)
        held, size = [], 0
        with system.open_input_file(partition.path) as f:
            for line in lines_from(f, partition.low, partition.begin, partition.end, partition.size):
                held.append(line.decode("utf-8", "replace"))
                size += len(line)
                if size > 8 * BLOCK or len(held) >= 10_000:
                    yield self._batch(partition, held)
                    held, size = [], 0
        if held:
            yield self._batch(partition, held)

    @staticmethod
    def _batch(p: Split, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p.path] * len(lines)), pa.array([p.begin] * len(lines), pa.int64()), pa.array(lines)], schema=ROWS)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, begin long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o = self.options
        return TailReader(o["path"], int(o.get("split", SPLIT)), float(o.get("hold", HOLD)))


def tail_log(spark: SparkSession, folder: str, split: int = SPLIT, hold: float = HOLD) -> DataFrame:
    """Streaming (source, path, begin, raw): stripped non-blank lines that are new in the files under ``folder``.
    ``source`` is a file's folder, ``begin`` the place of its split; the lines of a split come in order."""
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("log_tail").option("path", folder).option("split", split).option("hold", hold).load()
    source = F.regexp_replace("path", "/[^/]*$", "")
    return rows.select(source.alias("source"), "path", "begin", X.strip(F.col("value")).alias("raw")).where("raw <> ''")
