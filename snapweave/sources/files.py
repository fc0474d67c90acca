"""A store of files in a layout of its own: a data source that writes rows as files, whole or not at all, one that hashes files in blocks, and one that reads folders of a day each."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .logfiles import filesystem, log_files

BLOCK, TOGETHER = 1 << 20, 256 << 20
#: Files of a folder that are read by one task (of some TOGETHER bytes at most), and files and bytes of a batch.
SHARE, ROWS, HELD = 8192, 1000, 8 << 20
_FOUND = pa.schema([("file_path", pa.string()), ("length", pa.int64()), ("file_hash", pa.string())])
_CONTENT = pa.schema([("file_path", pa.string()), ("content", pa.binary())])


@dataclass
class Written(WriterCommitMessage):
    """The number of files that a task has made; their names are in its list under the job's folder."""

    files: int = 0


class _Writer(DataSourceArrowWriter):
    """Rows (path, part, content) of one path after the other. A file is written beside its place and moved there when it is complete.

    `existing` says what becomes of a file that is there: `skip` (it holds the same, as its name is its hash), `replace`, or `append`.
    With `skip`, each task lists what it makes in a hidden folder of the job, which goes when the job ends: names of files never reach the driver.
    """

    def __init__(self, options):
        self.root, self.existing, self.named = options["path"], options.get("existing", "skip"), options.get("named_by_hash") == "true"
        self.lists = f".made-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.root)
        done, own, at, out, hashed = Written(), None, "", None, hashlib.sha256()
        listed, made = f"{root}/{self.lists}/{uuid.uuid4().hex}", None

        def close() -> None:
            nonlocal out, at, made
            if out is None:
                return
            out.close()
            out = None
            if self.named and hashed.hexdigest() != own.rsplit("/", 1)[1].split(".")[0]:
                raise ValueError(f"the content of {own} has the hash {hashed.hexdigest()}")
            if self.existing == "skip" and made is None:
                system.create_dir(f"{root}/{self.lists}", recursive=True)
                made = system.open_output_stream(listed)
            system.move(at, f"{root}/{own}")
            at = ""
            if made is not None:
                made.write(json.dumps(own).encode() + b"\n")
            done.files += 1

        try:
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    if path != own:
                        close()
                        own = path
                        folder, name = f"{root}/{path}".rsplit("/", 1)
                        there = system.get_file_info(f"{root}/{path}").type != fs.FileType.NotFound
                        if there and self.existing == "skip":
                            continue
                        system.create_dir(folder, recursive=True)
                        at, hashed = f"{folder}/.{name}.{uuid.uuid4().hex}", hashlib.sha256()
                        out = system.open_output_stream(at)
                        if there and self.existing == "append":
                            with system.open_input_stream(f"{root}/{path}") as old:
                                while block := old.read(BLOCK):
                                    out.write(block)
                    if out is not None and content.is_valid:
                        out.write(content.as_buffer())
                        hashed.update(content.as_buffer())
            close()
            if made is not None:
                made.close()
        except BaseException:
            if out is not None:
                out.close()
            if at:
                _remove(system, at)
            if made is not None:
                made.close()
                _remove_listed(system, root, listed)
            raise
        return done

    def commit(self, messages) -> None:
        """Files are in their places; the lists of them go."""
        system, root = filesystem(self.root)
        if system.get_file_info(f"{root}/{self.lists}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.lists}")

    def abort(self, messages) -> None:
        """What the tasks of a failed job have made goes again, if it was not there before."""
        system, root = filesystem(self.root)
        for listed in system.get_file_info(fs.FileSelector(f"{root}/{self.lists}", allow_not_found=True)):
            _remove_listed(system, root, listed.path)
        self.commit(messages)


def _remove(system: fs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)


def _remove_listed(system: fs.FileSystem, root: str, listed: str) -> None:
    """The files that a task's list names, and the list; of a task that was killed the last line may be unfinished."""
    with system.open_input_stream(listed, buffer_size=BLOCK) as lines:
        for line in io.TextIOWrapper(lines, "utf-8"):
            if line.endswith("\n"):
                _remove(system, f"{root}/{json.loads(line)}")
    _remove(system, listed)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class _Hasher(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("most", 200 << 20))

    def partitions(self) -> list[Files]:
        """Files of some 256 MB together; those over `most` bytes aren't opened."""
        out: list[list] = [[]]
        size = 0
        for path, _, length in log_files(self.path):
            if length <= self.most:
                if size + length > TOGETHER and out[-1]:
                    out.append([])
                    size = 0
                out[-1].append((path, length))
                size += length
        return [Files(f) for f in out]

    def read(self, own: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        for path, length in own.files:
            hashed = hashlib.sha256()
            with system.open_input_stream(path) as file:
                while block := file.read(BLOCK):
                    hashed.update(block)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([hashed.hexdigest()])], schema=_FOUND)


class StoredFiles(DataSource):
    """write.format("stored_files"): rows (path, part, content) as files; read: file_path, length and SHA-256 of each."""

    @classmethod
    def name(cls) -> str:
        return "stored_files"

    def schema(self) -> str:
        return "file_path string, length long, file_hash string"

    def reader(self, schema) -> DataSourceReader:
        return _Hasher(self.options)

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _Writer(self.options)


@dataclass
class Share(InputPartition):
    """Files of a folder whose names are dealt to the kth of `of` shares."""

    folder: str
    k: int
    of: int


def _listed(system: fs.FileSystem, folder: str, ending: str) -> Iterator[tuple[str, int]]:
    """Names and sizes of a folder's files of an ending, without hidden ones."""
    for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if f.type == fs.FileType.File and f.base_name.endswith(ending) and f.base_name[0] not in "._":
            yield f.base_name, f.size


def day_folders(path: str, low: str | None = None, high: str | None = None) -> list[str]:
    """Folders YYYY/MM/DD below a path, of the days from `low` to `high` (YYYY/MM/DD) alone. Only years, months and days are listed, no files."""
    system, root = filesystem(path)
    held = [""]
    for digits in (4, 2, 2):
        found = [(f"{h}/{f.base_name}" if h else f.base_name) for h in held for f in system.get_file_info(fs.FileSelector(f"{root}/{h}", allow_not_found=True)) if f.type == fs.FileType.Directory and re.fullmatch(rf"\d{{{digits}}}", f.base_name)]
        held = [f for f in found if (not low or f >= low[: len(f)]) and (not high or f <= high[: len(f)])]
    return sorted(held)


class _Contents(DataSourceReader):
    def __init__(self, options):
        self.path, self.ending, self.shares = options["path"], options["ending"], json.loads(options["shares"])

    def partitions(self) -> list[Share]:
        return [Share(folder, k, of) for folder, of in self.shares for k in range(of)] or [Share("", 0, 0)]

    def read(self, own: Share) -> Iterator[pa.RecordBatch]:
        """Files that go while they are read have no row."""
        if not own.of:
            return
        system, root = filesystem(self.path)
        folder = f"{root}/{own.folder}"
        paths, contents, size = [], [], 0
        for name in [n for n, _ in _listed(system, folder, self.ending) if zlib.crc32(n.encode()) % own.of == own.k]:
            try:
                with system.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    contents.append(file.read())
            except FileNotFoundError:
                continue
            paths.append(f"{folder}/{name}")
            size += len(contents[-1])
            if len(paths) == ROWS or size > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=_CONTENT)
                paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=_CONTENT)


class FileContents(DataSource):
    """spark.read.format("file_contents"): file_path and content of files in folders, which tasks list."""

    @classmethod
    def name(cls) -> str:
        return "file_contents"

    def schema(self) -> str:
        return "file_path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Contents(self.options)


def read_days(spark: SparkSession, path: str, ending: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """file_path and content of the files in a path's folders of days from `low` to `high` (YYYY/MM/DD).

    The driver holds a number for each day: tasks count a day's files, and those that read them list their day again and take a share of it by the hash of names.
    """
    days = day_folders(path, low, high)

    def shares(day: str) -> tuple[str, int]:
        system, root = filesystem(path)
        sizes = [size for _, size in _listed(system, f"{root}/{day}", ending)]
        return day, max(-(-len(sizes) // SHARE), -(-sum(sizes) // TOGETHER), 1)

    counted = spark.sparkContext.parallelize(days, len(days)).map(shares).collect() if days else []
    spark.dataSource.register(FileContents)
    return spark.read.format("file_contents").options(ending=ending, shares=json.dumps(counted)).load(path)


def write_files(rows: DataFrame, path: str, existing: str = "skip", named_by_hash: bool = False) -> None:
    """Rows (path, content and, for files in parts, part) as files under `path`.

    A file's rows are dealt to one task and written in order of part, so that no file need be held whole. A file stands in its place when
    it is complete; a job that fails takes away what it has made (with `skip`). With `named_by_hash` a file that is not what its name says is an error.
    """
    rows.sparkSession.dataSource.register(StoredFiles)
    part = F.col("part").cast("int") if "part" in rows.columns else F.lit(0)
    rows = rows.select("path", part.alias("part"), F.col("content").cast("binary").alias("content"))
    rows = rows.repartition("path").sortWithinPartitions("path", "part")
    rows.write.format("stored_files").option("existing", existing).option("named_by_hash", str(named_by_hash).lower()).mode("append").save(path)


def hash_files(spark: SparkSession, path: str, most: int = 200 << 20) -> DataFrame:
    """file_path, length and file_hash of stored files, read in blocks of a MiB; those over `most` bytes aren't opened."""
    spark.dataSource.register(StoredFiles)
    return spark.read.format("stored_files").option("most", most).load(path)
