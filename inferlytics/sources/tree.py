"""Directory trees as tables: a data source that sees what Spark's file listing hides.

Spark lists files only, and none whose name starts with an underscore or a dot. ``file_tree`` gives every entry below a
folder, directories (also empty ones) and hidden names among them, and the text of the files whose name matches ``glob``.
It also writes trees: one file per row of (path, text), or a directory where the text is null.

The driver lists level by level only until there are enough directories to deal out; tasks list the rest and read the
files. A task that is repeated gives the same rows, or writes the same files again.
"""

from __future__ import annotations

import fnmatch
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, name string, is_dir boolean, size long, text string"
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Python workers can reach."""
    scheme, colon, rest = uri.partition(":")
    if not colon or len(scheme) == 1:
        return fs.LocalFileSystem(), uri.rstrip("/") or "/"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    try:
        found, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
        raise ValueError(f"directories of {uri} cannot be listed: {error}") from error
    return found, path.rstrip("/")


class _Part(InputPartition):
    """Directories to list: those in ``deep`` with all below them, those in ``flat`` alone."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.glob = options["path"], options.get("glob", "")
        self.want = int(options.get("partitions", 64))

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.base)
        deep, flat = [root], []
        while deep and len(deep) < self.want:
            below = [x.path for d in deep for x in files.get_file_info(fs.FileSelector(d)) if x.type == fs.FileType.Directory]
            flat += deep
            deep = below
        n = max(1, min(self.want, max(len(deep), len(flat))))
        return [_Part(deep[k::n], flat[k::n]) for k in range(n)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.base)
        rows: list[tuple] = []
        size = 0
        todo = [(d, False) for d in partition.flat] + [(d, True) for d in partition.deep]
        while todo:
            folder, below = todo.pop()
            for entry in files.get_file_info(fs.FileSelector(folder)):
                is_dir = entry.type == fs.FileType.Directory
                if is_dir and below:
                    todo.append((entry.path, True))
                text = None
                if not is_dir and self.glob and fnmatch.fnmatchcase(entry.base_name, self.glob):
                    with files.open_input_stream(entry.path) as stream:
                        text = stream.read().decode("utf-8", "replace")
                rows.append((entry.path[len(root) :].lstrip("/"), entry.base_name, is_dir, entry.size, text))
                size += len(text or "")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.base = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = opened(self.base)
        made: set[str] = set()
        for row in iterator:
            path = f"{root}/{row['path'].strip('/')}"
            folder = path if row["text"] is None else path.rpartition("/")[0]
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            if row["text"] is not None:
                with files.open_output_stream(path) as stream:
                    stream.write(row["text"].encode())
        return WriterCommitMessage()


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a tree is only added to; use mode('append')")
        return _Writer(self.options)


_SESSIONS: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def register(spark: SparkSession) -> None:
    if spark not in _SESSIONS:
        spark.dataSource.register(FileTree)
        _SESSIONS.add(spark)


def read_tree(spark: SparkSession, base: str, glob: str = "", partitions: int = 64) -> DataFrame:
    """(path below ``base``, name, is_dir, size, text) of every entry; text of the files whose name matches ``glob``."""
    opened(base)  # a store that cannot be listed is told here and not in a task
    register(spark)
    return spark.read.format("file_tree").option("glob", glob).option("partitions", partitions).load(base)


def write_tree(df: DataFrame, base: str) -> None:
    """One file per row of (path below ``base``, text); a null text makes a directory. Paths are unique."""
    register(df.sparkSession)
    df.select("path", "text").write.format("file_tree").mode("append").save(base)
