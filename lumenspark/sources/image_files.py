"""Image files as a data source: ``spark.read.format("images")`` and ``df.write.format("images")``.

Reading deals files into partitions by their size and knows files by their ending before any is opened, also from a filter on ``path``.  Writing goes through a folder for each attempt of a task: what a task has written
becomes part of the result when all tasks have ended, and what attempts without success left goes (what a task still writes after its job
has failed stays in a folder that readers pass over).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, StringEndsWith, WriterCommitMessage

from . import images

#: Bytes of files that a task reads.
PARTITION = 64 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs), or this machine's for a plain path, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class ImageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], options.get("rows", "frames")
        self.endings = [tuple(x.strip().lower() for x in options["endings"].split(","))] if options.get("endings") else [images.ENDINGS]
        self.exact: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Endings of ``path`` are looked at when files are listed; all else is left to Spark."""
        for f in filters:
            if isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.exact.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, folder = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        wanted = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[_.]", f.path.removeprefix(folder.rstrip("/") + "/")) and all(f.path.lower().endswith(e) for e in self.endings) and all(f.path.endswith(e) for e in self.exact)]
        out, held = [], 0
        for f in sorted(wanted, key=lambda f: f.path):
            if not out or held + f.size > PARTITION:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        for path in partition.paths if partition else ():
            with system.open_input_stream(path, compression=None) as f:
                content = f.read()
            yield from images.described_rows(path, content) if self.rows == "frames" else images.pixel_rows(path, content)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class ImageWriter(DataSourceArrowWriter):
    """Rows (name, content) become files; a name must be one below the folder."""

    def __init__(self, options: dict) -> None:
        self.path, self.run = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = filesystem(self.path)
        context = TaskContext.get()
        held = f"_attempts-{self.run}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(f"{folder}/{held}", recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"no name of a file: {name}")
                with system.open_output_stream(f"{folder}/{held}/{name}", compression=None) as f:
                    f.write(content.as_buffer())
        return Attempt(held)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = filesystem(self.path)
        for message in messages:
            if message:
                for f in system.get_file_info(fs.FileSelector(f"{folder}/{message.folder}")):
                    system.move(f.path, f"{folder}/{f.base_name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = filesystem(self.path)
        held = f"{folder}/_attempts-{self.run}"
        if system.get_file_info(held).type == fs.FileType.Directory:
            system.delete_dir(held)


class ImageSource(DataSource):
    """Options of reading: ``rows`` (``frames``: size and metadata of each file; ``pixels``), ``endings`` (with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return images.PIXELS if self.options.get("rows") == "pixels" else images.FRAMES

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ImageWriter(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session with this source, and with the push-down of filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
    return spark
