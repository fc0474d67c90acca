"""Log files by byte ranges: a data source whose partitions are ranges, and a stream that follows growing files by a byte for each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

SCHEMA = "file string, size long, part int, nth long, start long, end long, line string, complete boolean"
_ARROW = pa.schema([("file", pa.string()), ("size", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.string()), ("complete", pa.bool_())])
#: Bytes that are read at once, of a range, and lines of a batch; bytes up to which ranges share a partition, and that are read at once beyond its ends.
CHUNK, RANGE, LINES, TASK, REACH = 1 << 20, 64 << 20, 20_000, 8 << 20, 64 << 10


@dataclass
class Range(InputPartition):
    """The lines of a file that start in [low, high), which are ranges of `each` bytes from the `part`th on; those that aren't ended by a line feed only if `open_end`."""

    path: str
    file: str
    size: int
    part: int
    low: int
    high: int
    open_end: bool
    each: int = RANGE


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs) and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def log_files(path: str) -> list[tuple[str, str, int]]:
    """(path, name below the folder, size) of its files, without hidden ones; a path of one file gives this."""
    system, root = filesystem(path)
    top = system.get_file_info(root)
    if top.type == fs.FileType.File:
        return [(root, top.base_name, top.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [(f.path, f.path[len(root.rstrip("/")) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if not any(p[0] in "._" for p in n[1].split("/")))


def last_line_end(file, size: int) -> int:
    """The byte after the last line feed in the first `size` bytes, read from the end."""
    at = size
    while at > 0:
        low = max(0, at - CHUNK)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def tail_start(file, size: int, n: int) -> int:
    """Where the last n lines begin, read from the end."""
    if n <= 0 or not size:
        return size
    file.seek(size - 1)
    at, left = size, n + (file.read(1) == b"\n")
    while at > 0:
        low = max(0, at - CHUNK)
        file.seek(low)
        held = file.read(at - low)
        found = len(held)
        while left and (found := held.rfind(b"\n", 0, found)) >= 0:
            left -= 1
        if not left:
            return low + found + 1
        at = low
    return 0


def _blocks(file, own: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of whole lines that start in [low, high): read from the byte before it, so that a line which starts with it is known to. Only the last block of a file may be without a line feed at its end."""
    at = own.low
    if at:
        file.seek(at - 1)
        while (found := (held := file.read(REACH)).find(b"\n")) < 0:  # the line that reaches into the range belongs to an earlier one
            at += len(held)
            if not held or at >= own.high:
                return
        at += found
        file.seek(at)
    rest: list[bytes] = []
    start = at
    while start < min(own.high, own.size):
        held = file.read(min(CHUNK, max(own.high - at, REACH), own.size - at))
        if not held:
            break
        last = held.find(b"\n", max(0, own.high - 1 - at)) if at + len(held) >= own.high else -1  # the line that starts last may end beyond
        last = last if last >= 0 else held.rfind(b"\n")
        at += len(held)
        rest.append(held[: last + 1] if last >= 0 else held)
        if last >= 0:
            block = b"".join(rest)
            yield start, block
            start, rest = start + len(block), [held[last + 1 :]]
    if start < own.high and own.open_end and (block := b"".join(rest)):
        yield start, block


def _batches(own: Range) -> Iterator[pa.RecordBatch]:
    """Lines of a partition's ranges in one pass, with the range that each starts in and its place there."""
    system, path = filesystem(own.path)
    last, seen = -1, 0  # range of the line before, and its lines so far
    with system.open_input_file(path) as file:
        for start, block in _blocks(file, own):
            lines, whole = block.split(b"\n"), block.endswith(b"\n")
            if whole:
                lines.pop()
            n = len(lines)
            sizes = np.fromiter(map(len, lines), np.int64, n)
            ends = start + np.cumsum(sizes + 1)
            starts = ends - sizes - 1
            part = own.part + (starts - own.low) // own.each
            nth = np.arange(n) - np.searchsorted(part, part) + np.where(part == last, seen, 0)
            last, seen = int(part[-1]), int(nth[-1]) + 1
            complete = np.ones(n, bool)
            if not whole:
                ends[-1], complete[-1] = ends[-1] - 1, False
            try:
                text = pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
            columns = [pa.repeat(own.file, n), pa.repeat(pa.scalar(own.size, pa.int64()), n), pa.array(part.astype(np.int32)), pa.array(nth), pa.array(starts), pa.array(ends), text, pa.array(complete)]
            batch = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
            for k in range(0, n, LINES):
                yield batch.slice(k, LINES)


def _partitions(path: str, name: str, size: int, first: int, last: int, each: int, open_end: bool) -> list[Range]:
    """[first, last) of a file in ranges of `each` bytes; small ranges share a partition, up to TASK bytes."""
    many = max(1, TASK // each)
    return [Range(path, name, size, k * many, at, min(last, at + many * each), open_end, each) for k, at in enumerate(range(first, last, many * each))]


def _uri(path: str, own: str) -> str:
    return f"{path.split('://', 1)[0]}://{own}" if "://" in path and not path.startswith("file:") else own


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.options = options["path"], options

    def partitions(self) -> list[Range]:
        """Ranges of `range_bytes`; only what `tail` (lines), or `low` and `high` or `back` from the end (bytes) of each file ask for."""
        each, tail = int(self.options.get("range_bytes", RANGE)), self.options.get("tail")
        low, high = int(self.options.get("low", 0)), int(self.options.get("high", 1 << 62))
        out, system = [], filesystem(self.path)[0]
        for path, name, size in log_files(self.path):
            first, last = max(0, low, size - int(self.options.get("back", size))), min(size, high)
            if tail is not None:
                with system.open_input_file(path) as file:
                    first, last = tail_start(file, size, int(tail)), size
            out += _partitions(_uri(self.path, path), name, size, first, last, each, True)
        return out or [Range("", "", 0, 0, 0, 0, False)]

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        if own.size:
            yield from _batches(own)


class _Follower(DataSourceStreamReader):
    """Offsets are the bytes of each file up to which lines are complete. A file that has become shorter is a new one."""

    def __init__(self, options):
        self.path, self.each = options["path"], int(options.get("range_bytes", RANGE))
        self.seen: dict[str, tuple[int, int]] = {}  # size of a file when looked at last, and where its last line ended

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system = filesystem(self.path)[0]
        for path, name, size in log_files(self.path):
            if self.seen.get(name, (-1, 0))[0] != size:
                with system.open_input_file(path) as file:
                    self.seen[name] = (size, last_line_end(file, size))
        return {name: end for name, (_, end) in self.seen.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, held = [], {name: path for path, name, _ in log_files(self.path)}
        for name, last in sorted(end.items()):
            first = start.get(name, 0)
            first = 0 if first > last else first
            if name in held:
                out += _partitions(_uri(self.path, held[name]), name, last, first, last, self.each, False)
        return out or [Range("", "", 0, 0, 0, 0, False)]

    def read(self, own: Range) -> Iterator[pa.RecordBatch]:
        if own.size:
            yield from _batches(own)


class LogLines(DataSource):
    """spark.read / readStream.format("log_lines"): file, its size, part and place in it, first byte, byte after the last, text, and whether a line feed ends it."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follower(self.options)


def _format(spark: SparkSession, reader, path: str, options: dict):
    spark.dataSource.register(LogLines)
    return reader.format("log_lines").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def read_log_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """All lines of a folder's files, in ranges of `range_bytes`; a line belongs to the range that it starts in."""
    return _format(spark, spark.read, path, {"range_bytes": range_bytes})


def follow_log_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The stream of complete lines: each once, an unfinished one when it has ended. Progress is a byte of each file, kept in the checkpoint."""
    return _format(spark, spark.readStream, path, {"range_bytes": range_bytes})


def numbered(lines: DataFrame) -> DataFrame:
    """With line_no (from 1) in place of part and nth. Lines are counted for each range, the counts added up over a file's ranges, and the sums joined to the lines."""
    counts = lines.groupBy("file", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", "part", ahead.alias("ahead"))
    return lines.join(counts, ["file", "part"]).withColumn("line_no", F.col("ahead") + F.col("nth") + 1).drop("ahead", "part", "nth")


def tail_of_files(spark: SparkSession, path: str, n: int = 500) -> DataFrame:
    """The last n lines of each file (500 if n is not positive, at most 10000); only their bytes are read, from the end of the file."""
    return _format(spark, spark.read, path, {"tail": min(n if n > 0 else 500, 10_000)}).drop("part", "nth")


def range_of_files(spark: SparkSession, path: str, after: int | None = None, before: int | None = None, limit: int = 128 << 10) -> DataFrame:
    """Lines of each file in `limit` bytes after an offset, before one, or before the end; with has_more_before and has_more_after.

    What is read are the ranges alone. Forward, lines start at or after `after` and end within the range; backward they start in it and end
    by `before`. The limit is 128 KiB if not positive, and 1 MiB at most.
    """
    if after is not None and before is not None:
        raise ValueError("before and after cannot be used together")
    if (after or 0) < 0 or (before or 0) < 0:
        raise ValueError("offsets are not negative")
    limit = min(limit if limit > 0 else 128 << 10, 1 << 20)
    if after is None and before is None:
        lines, low, high = _format(spark, spark.read, path, {"back": limit}), F.greatest(F.col("size") - limit, F.lit(0)), F.col("size")
    else:
        low, high = (after, after + limit) if after is not None else (max(0, before - limit), before)
        lines, low, high = _format(spark, spark.read, path, {"low": low, "high": high}), F.lit(low), F.lit(high)
    got = lines.where((F.col("start") >= low) & (F.col("end") <= high))
    own = got.groupBy("file").agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    return got.join(own, "file").select("file", "start", "end", "line", (F.col("_first") > 0).alias("has_more_before"), (F.col("_last") < F.col("size")).alias("has_more_after"))


def day_of(file: Column) -> Column:
    """The day in a log's name, `<name>-YYYY-MM-DD.NNN.log`."""
    return F.try_to_date(F.regexp_extract(file, r"(?:^|/)[a-z]+-(\d{4}-\d{2}-\d{2})\.\d+\.log$", 1), "yyyy-MM-dd")
