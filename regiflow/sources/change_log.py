"""A change log of JSON lines as a Spark streaming source (S3).

A log is a folder of files that are only appended to, read in the order of
their paths: a dump of a change topic, or what a connector without a broker
writes.  The offset of the stream is a file and a byte in it, so a stream
resumes at an event inside a file that has grown meanwhile; an unfinished last
line waits for its end.

    spark.dataSource.register(ChangeLog)
    changes = change_log(spark, "/shared/log")          # key string, value string

Files are listed on the driver, and read by the tasks in ranges of bytes
through Arrow's file systems, so the folder must be reachable by that path
from everywhere.  A task hands over lines; they are parsed by built-in
functions.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 32 << 20       # of a file for one task
_BLOCK = 1 << 20
_START = {"file": "", "byte": 0}


class LogRange(InputPartition):
    """The lines that begin in bytes ``begin`` to ``end`` of a file."""

    def __init__(self, path: str, begin: int, end: int, limit: int):
        self.path, self.begin, self.end, self.limit = path, begin, end, limit


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def _files(self) -> list[tuple[str, int]]:
        """The files of the log and their sizes, in order; names that start
        with a dot or an underscore are not part of it."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        own = [(posixpath.relpath(f.path, root), f.size) for f in found if f.is_file]
        return sorted((p, n) for p, n in own if not any(part[0] in "._" for part in p.split("/") if "=" not in part))

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        """The end of the last whole line of the last file that has one."""
        system, root = fs.FileSystem.from_uri(self.path)
        for path, size in reversed(self._files()):
            if end := _last_line_end(system, posixpath.join(root, path), size):
                return {"file": path, "byte": end}
        return dict(_START)

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        system, root = fs.FileSystem.from_uri(self.path)
        out = []
        for path, size in self._files():
            if not start["file"] <= path <= end["file"]:
                continue
            begin = start["byte"] if path == start["file"] else 0
            # a file that another one follows is finished: whatever stands at its end is its last line
            limit = end["byte"] if path == end["file"] else size
            out += [LogRange(posixpath.join(root, path), at, min(at + self.range_bytes, limit), limit)
                    for at in range(begin, limit, self.range_bytes)]
        return out

    def read(self, partition: LogRange) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as file:
            yield from _lines(file, partition)

    def commit(self, end: dict) -> None:
        """Nothing is deleted."""


def _last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
    """Where the last whole line of a file ends; 0 without one."""
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            begin = max(0, end - _BLOCK)
            file.seek(begin)
            if (at := file.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return 0


def _lines(file, own: LogRange) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the range, in bounded batches.  A range's first
    line belongs to it only if the byte before it ends a line."""
    at, rest = own.begin, b""
    skip = own.begin > 0
    if skip:
        at -= 1                                                     # the line end before the range, if it stands there
    while at < own.limit and (at < own.end or rest or skip):
        file.seek(at)
        data = file.read(min(_BLOCK, own.limit - at))
        if not data:
            break
        begin, at = at - len(rest), at + len(data)
        data = rest + data
        if skip:
            if (cut := data.find(b"\n")) < 0:
                rest = b""
                continue
            begin, data, skip = begin + cut + 1, data[cut + 1:], False
            if begin >= own.end:
                return
        cut = len(data) if at >= own.limit else data.rfind(b"\n") + 1
        whole, rest = data[:cut], data[cut:]
        out = []
        for line in whole.splitlines(keepends=True):
            if begin >= own.end:
                break
            begin += len(line)
            if line.strip():
                out.append(line.decode("utf-8", "replace"))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])
        if begin >= own.end:
            return


class ChangeLog(DataSource):
    """``spark.readStream.format("change_log").load(folder)``: one row per
    line.  Option ``range_bytes``: how much of a file a task reads."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema) -> ChangeLogReader:
        path = self.options["path"]
        return ChangeLogReader(path if "://" in path else f"file://{path}", int(self.options.get("range_bytes", RANGE_BYTES)))


def change_log(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S3: the change events ``key string, value string`` of a log folder as a
    stream.  A line is a JSON object with both as strings (null: a tombstone);
    one that is not gives a null key and the line as its value, which the
    parser of changes rejects with a reason."""
    spark.dataSource.register(ChangeLog)
    lines = spark.readStream.format("change_log").option("range_bytes", range_bytes).load(path)
    event = lines.select("line", F.from_json("line", "key string, value string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return event.select("e.key", F.when(F.col("e._bad").isNull(), F.col("e.value")).otherwise(F.col("line")).alias("value"))
