"""Each row as a file of its own, written and read; files appear under their names only once the whole job has succeeded.

    spark.dataSource.register(NamedFiles)
    rows.write.format("named_files").option("path", uri).mode("append").save()

rows: (name string, content binary). Tasks write into a folder of the job's own beside the files; the commit moves what
the successful attempts wrote, and removes the rest, as an abort removes all. The path is of any file system that pyarrow
opens and that driver and executors share.
"""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt, and eight bytes of hash for each name in it; the names stay on disk."""

    folder: str
    hashes: bytes


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        return fs, root, f"{root}/_job-{self.job}"

    def begin(self) -> None:
        """On the driver, before any task: the job's folder."""
        fs, _, stage = self._open()
        fs.create_dir(stage, recursive=True)

    def write(self, batches) -> Written:
        fs, _, stage = self._open()
        context = TaskContext.get()
        folder, names = f"{stage}/{context.partitionId()}-{context.taskAttemptId()}", set()
        fs.create_dir(folder, recursive=False)  # of a job that was aborted there is nothing left to write into
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                if not name or "/" in name or name.startswith(("_", ".")) or name in names:
                    raise ValueError(f"no file, or no other, can be named {name!r}")
                names.add(name)
                with fs.open_output_stream(f"{folder}/{name}", compression=None) as f:
                    if content.is_valid:
                        f.write(content.as_buffer())
        return Written(folder, b"".join(hashlib.blake2b(n.encode(), digest_size=8).digest() for n in names))

    def commit(self, messages) -> None:
        fs, root, _ = self._open()
        names = np.sort(np.frombuffer(b"".join(m.hashes for m in messages if m is not None), np.uint64))
        if (names[1:] == names[:-1]).any():
            self.abort(messages)
            raise ValueError("two rows have one name; nothing was written")
        fs.create_dir(root, recursive=True)
        listed = lambda folder: [f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file]
        if self.overwrite:
            for f in listed(root):
                if not f.base_name.startswith(("_", ".")):
                    fs.delete_file(f.path)
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is not None:
                    list(pool.map(lambda f: fs.move(f.path, f"{root}/{f.base_name}"), listed(m.folder)))
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, _, stage = self._open()
        for pause in (0.2, 1, 3, 0):  # a task that still runs may write while its folder goes
            try:
                return fs.delete_dir(stage)
            except FileNotFoundError:
                return
            except OSError:
                time.sleep(pause)


@dataclass
class _Share(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    """Files in order of their names, several a task. Spark's own reader of binary files leaves empty ones out."""

    #: Bytes of files and files of a task at most, and bytes after which files are passed on.
    BYTES, FILES, BATCH = 32 << 20, 1000, 1 << 20

    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[_Share]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        out, size = [_Share([])], 0
        for f in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.base_name):
            if f.is_file and not f.base_name.startswith(("_", ".")):
                if out[-1].paths and (size + f.size > self.BYTES or len(out[-1].paths) == self.FILES):
                    out.append(_Share([]))
                    size = 0
                out[-1].paths.append(f.path)
                size += f.size
        return out

    def read(self, partition: _Share):
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        names, contents, size = [], [], 0
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as f:
                names.append(path.rsplit("/", 1)[-1])
                contents.append(f.read())
            size += len(contents[-1])
            if size > self.BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["name", "content"])
                names, contents, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary())], ["name", "content"])


class NamedFiles(DataSource):
    """Option path: the folder's URI. Mode append adds files, replacing those of the same names; overwrite removes all others too."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        kinds = {f.name: f.dataType for f in schema.fields}
        if kinds != {"name": StringType(), "content": BinaryType()}:
            raise ValueError("columns must be name string, content binary")
        own = _Writer(self.options["path"], overwrite)
        own.begin()
        return own


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="inkframe-")


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder that is not yet there, under spark.checkpoint.dir (where unset, on a local master only, under a temporary folder)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = (base or _own_folder()).rstrip("/")
    return f"{base if ':/' in base else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def save_files(rows: DataFrame, uri: str, mode: str = "append") -> None:
    """rows (name, content) as files in the folder uri. An empty name, one with a slash or of a leading "_" or ".", and two rows of one name fail the job, and then nothing is written; a null content makes an empty file."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").option("path", uri).mode(mode).save()


def read_files(spark: SparkSession, uri: str) -> DataFrame:
    """(name, content) of the folder's files, but those of a leading "_" or "."."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("path", uri).load()
