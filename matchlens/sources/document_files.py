"""Documents as files of their own name, by a Python data source: batch and stream.

A task writes its documents to a folder of its attempt; only folders of attempts that Spark commits are moved to their place, so a lost executor, a speculative
attempt or a failed job leaves nothing behind. A document written again replaces the file of its name: a replayed batch changes nothing.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "matchlens_documents"
MOVERS = 16                  # files that are moved at once


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a plain path is a local (mounted) one."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt, and how many documents are in it."""
    folder: str
    documents: int


class _Files:
    """What the batch and the stream writer have in common."""

    def __init__(self, options: dict[str, str], schema: StructType):
        if "path" not in options:
            raise ValueError("documents need a path")
        name, text = options.get("name", "filename"), options.get("text", "document")
        for column in (name, text):
            if column not in schema.names:
                raise ValueError(f"documents have no column {column}")
        self.path, self.name, self.text = options["path"].rstrip("/"), schema.names.index(name), schema.names.index(text)
        self.staging = f".writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = located(self.path)
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{folder}", recursive=True)
        count = 0
        for row in rows:
            name = row[self.name]
            if not name or name != posixpath.basename(name) or name.startswith("."):
                raise ValueError(f"no name for a document: {name!r}")
            with system.open_output_stream(f"{root}/{folder}/{name}") as out:
                out.write((row[self.text] or "").encode())
            count += 1
        return Written(folder, count)

    def settle(self, messages: list[Written | None]) -> None:
        """Moves what committed attempts wrote to its place; what others left goes."""
        system, root = located(self.path)

        def move(info: fs.FileInfo) -> None:
            place = f"{root}/{info.base_name}"
            if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(place).type != fs.FileType.NotFound:
                system.delete_file(place)                # a local move replaces the file itself
            system.move(info.path, place)
        with ThreadPoolExecutor(MOVERS) as pool:
            for message in messages:
                if message is not None:
                    list(pool.map(move, system.get_file_info(fs.FileSelector(f"{root}/{message.folder}"))))
        self.clear(messages)

    def clear(self, messages: list[Written | None]) -> None:
        """Attempts write below the staging folder of the writer that they were sent with."""
        system, root = located(self.path)
        for staging in {self.staging, *(m.folder.partition("/")[0] for m in messages if m is not None)}:
            if system.get_file_info(f"{root}/{staging}").type != fs.FileType.NotFound:
                system.delete_dir(f"{root}/{staging}")


class _BatchWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.files, self.overwrite = _Files(options, schema), overwrite

    def write(self, iterator: Iterator) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            system, root = located(self.files.path)
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        self.files.settle(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.files.clear(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.files = _Files(options, schema)

    def write(self, iterator: Iterator) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.files.settle(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.files.clear(messages)


class DocumentFiles(DataSource):
    """Options: path; name and text, the columns of a document's file name and text (filename, document)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)


def write_files(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One file per document, exactly <path>/<filename>; overwrite replaces all files of the folder once all documents are written."""
    register(documents.sparkSession)
    documents.select("filename", "document").write.format(FORMAT).mode(mode).option("path", path).save()
