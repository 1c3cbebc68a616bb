"""Text files that grow: the lines of byte ranges of them, as a table and as a stream that goes on where it stopped.

Ranges are read by tasks through pyarrow's file systems (file, hdfs, s3, gs), since Spark's own text source always begins
at a file's start. Only a line feed ends a line. Compressed files have no ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, which one task reads.
RANGE_BYTES = 32 << 20
#: Bytes read at once.
STEP_BYTES = 4 << 20
#: Bytes before a place whose checksum tells whether a file still has what it had.
TAIL_BYTES = 1 << 16
#: Tasks for ranges at most.
MAX_TASKS = 10_000
SCHEMA = "file string, block long, mid long, text string"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("mid", pa.int64()), ("text", pa.string())])


def _open(file: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(file)
    return system.open_input_file(path)


def whole_lines(handle: pa.NativeFile, start: int, end: int, stop: int) -> Iterator[list[bytes]]:
    """The lines that begin in [start, end), many at a time. No byte from stop on is read."""
    handle.seek(max(start - 1, 0))
    inside = start > 0 and handle.read(1) != b"\n"  # what comes first belongs to a line that began before
    at, begin, held = start, start, []
    while at < stop and begin < end:
        piece = handle.read(min(STEP_BYTES, stop - at))
        if not piece:
            break
        at += len(piece)
        if b"\n" not in piece:
            if inside and at >= end:  # the whole range lies inside a long line
                return
            held.append(piece)
            continue
        *lines, rest = b"".join([*held, piece]).split(b"\n")
        starts = list(accumulate((len(x) + 1 for x in lines), initial=begin))
        kept = [x for x, s in zip(lines, starts, strict=False) if s < end]
        yield kept[1:] if inside else kept
        inside, begin, held = False, starts[-1], [rest]
    last = b"".join(held)
    if last and begin < end and not inside:
        yield [last]


def range_batches(file: str, block: int, end: int, stop: int) -> Iterator[pa.RecordBatch]:
    """file, block, mid (from 0) and text of the lines that begin in a range. Bytes that are no UTF-8 are replaced."""
    n = 0
    with _open(file) as handle:
        for lines in whole_lines(handle, block, end, stop):
            text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
            mid = pa.array(range(n, n + len(lines)), pa.int64())
            n += len(lines)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array([block] * len(lines), pa.int64()), mid, text], schema=_ARROW)


def read_ranges(parts: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, block, mid and text, as lines.read_splits gives them, of files from byte start to byte stop.

    parts: file (as a scan names it), start and stop, a row for each file, in storage or at hand. A file's bytes are dealt to
    many tasks; a line belongs to the range in which it begins.
    """
    cut = F.explode(F.sequence("start", F.col("stop") - 1, F.lit(range_bytes).cast("long")))
    ranges = parts.filter("stop > start").select("file", cut.alias("block"), "stop")
    ranges = ranges.select("file", "block", F.least(F.col("block") + range_bytes, "stop").alias("end"), "stop")
    tasks = min(max(ranges.count(), 1), MAX_TASKS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from range_batches(row["file"], row["block"], row["end"], row["stop"])

    return ranges.repartition(tasks, "file", "block").mapInArrow(read, SCHEMA)


def tail_of(handle: pa.NativeFile, end: int) -> int | None:
    """Checksum of the bytes before end; null where the last of them ends no line, or the file is shorter."""
    start = max(end - TAIL_BYTES, 0)
    handle.seek(start)
    data = handle.read(end - start)
    return zlib.crc32(data) if len(data) == end - start and data.endswith(b"\n") else None


def tails(files: DataFrame) -> DataFrame:
    """file, bytes and tail (tail_of) of files at a length; each file is opened once, by a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with _open(row["file"]) as handle:
                    found.append(tail_of(handle, row["bytes"]))
            yield pa.RecordBatch.from_arrays([batch["file"], batch["bytes"], pa.array(found, pa.int64())], names=["file", "bytes", "tail"])

    return files.select("file", "bytes").mapInArrow(read, "file string, bytes long, tail long")


class Range(InputPartition):
    def __init__(self, file: str, block: int, end: int, stop: int):
        self.file, self.block, self.end, self.stop = file, block, end, stop


class GrowingReader(DataSourceStreamReader):
    """Offsets are the bytes of each file that have been handed over, always whole lines."""

    def __init__(self, options: dict[str, str]):
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _end(self, file: str, size: int) -> int:
        """Where a file's last whole line ends; found from its end, and looked for no further than it was last time."""
        low = self.ends.get(file, 0)
        at = size
        with _open(file) as handle:
            while at > low:
                begin = max(at - TAIL_BYTES, low)
                handle.seek(begin)
                if (k := handle.read(at - begin).rfind(b"\n")) >= 0:
                    return begin + k + 1
                at = begin
        return low

    def latestOffset(self) -> dict:  # noqa: N802
        system, folder = fs.FileSystem.from_uri(self.path)
        root = self.path.split("://")[0] + "://"
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.is_file and not name.startswith((".", "_")):
                file = root + quote(info.path)
                if info.size < self.ends.get(file, 0):  # cut or replaced: from its start
                    del self.ends[file]
                if info.size > self.ends.get(file, 0):
                    self.ends[file] = self._end(file, info.size)
        return {f: n for f, n in sorted(self.ends.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, stop in end.items():
            begin = start.get(file, 0)
            begin = 0 if begin > stop else begin
            out += [Range(file, k, min(k + self.range_bytes, stop), stop) for k in range(begin, stop, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from range_batches(partition.file, partition.block, partition.end, partition.stop)

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """Stream of the lines added to the files of a folder (option path, a URI): new files and new ends of known ones.

    A line is handed over once it is ended by a line feed. A file that becomes shorter is taken as a new one. The offset
    names every file with its length, so it suits folders of thousands of files, not of millions.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingReader:  # noqa: N802
        return GrowingReader(dict(self.options))


def follow(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, block, mid and text of lines as they are added to the files of a folder, a stream.

    The checkpoint of a query on it holds how far each file has been read, so a query that starts again goes on there.
    """
    spark.dataSource.register(GrowingFiles)
    uri = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"
    return spark.readStream.format("growing_text").option("path", uri).option("rangeBytes", range_bytes).load()
