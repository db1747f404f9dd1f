"""Word files and migration text as Spark data sources.

    register(spark)
    spark.read.format("lectern_docx").option("anchors", "A|B").load(folder)
    statements.write.format("lectern_sql").mode("append").option("name", "questions").save(folder)

Paths are local ones or URIs that Arrow's file systems know; they must mean the
same to the driver and all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from lectern.sources.docx import SCHEMA, file_rows

BUNDLE_BYTES, ROWS = 64 << 20, 10_000


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(WordSource)
    spark.dataSource.register(StatementSink)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(store: fs.FileSystem, where: str) -> list[fs.FileInfo]:
    """The files at or under a path by name, without hidden ones."""
    own = store.get_file_info(where)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(where)
    inside = [own] if own.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
    hidden = lambda path: any(part[:1] in ("_", ".") for part in path[len(where) :].split("/"))
    return sorted((i for i in inside if i.type == fs.FileType.File and not hidden(i.path)), key=lambda i: i.path)


@dataclass
class Bundle(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


class WordSource(DataSource):
    """Rows of ``docx.SCHEMA``; options: ``path``, ``anchors`` (parted by ``|``), ``bundleBytes`` (of files a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "lectern_docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WordReader(self.options["path"], tuple(filter(None, self.options.get("anchors", "").split("|"))), int(self.options.get("bundleBytes", BUNDLE_BYTES)))


class WordReader(DataSourceReader):
    """The driver lists files; a task opens its own ones, one at a time. A file that is no Word file gives one row with its error."""

    def __init__(self, path: str, anchors: tuple[str, ...], most: int):
        self.path, self.anchors, self.most = path, anchors, most

    def partitions(self) -> list[Bundle]:
        bundles, size = [[]], 0
        for info in _files(*_located(self.path)):
            if bundles[-1] and size + info.size > self.most:
                bundles.append([])
                size = 0
            bundles[-1].append(info.path)
            size += info.size
        return [Bundle(tuple(paths)) for paths in bundles]

    def read(self, partition: Bundle) -> Iterator[tuple]:
        store, _ = _located(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as stream:
                data = stream.read()
            yield from file_rows(path, data, self.anchors)


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote, in order."""

    partition: int
    paths: tuple[str, ...]


class StatementSink(DataSource):
    """A column ``statement`` as numbered files ``0001_<name>.sql``, a statement a line.

    Options: ``path``, ``name`` (default ``migration``), ``rowsPerFile``. Modes are ``append``, which goes on with the
    number behind the highest there, and ``overwrite``, which replaces the files of this name. The order of the rows
    stays, over partitions too; null statements are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "lectern_sql"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["statement"] or not isinstance(schema[0].dataType, StringType):
            raise ValueError("lectern_sql writes one column, statement string")
        return StatementWriter(self.options["path"], self.options.get("name", "migration"), int(self.options.get("rowsPerFile", ROWS)), overwrite)


class StatementWriter(DataSourceWriter):
    """Tasks write below a hidden folder under names of their attempt; only the commit gives files their numbers."""

    def __init__(self, path: str, name: str, rows: int, overwrite: bool):
        self.path, self.label, self.rows, self.overwrite = path.rstrip("/"), name, rows, overwrite
        self.hidden = f"_staged-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        store, where = _located(self.path)
        return store, where, f"{where}/{self.hidden}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, _, staged = self._place()
        store.create_dir(staged, recursive=True)
        task = TaskContext.get()
        paths, out, inside = [], None, 0
        try:
            for row in iterator:
                if row["statement"] is None:
                    continue
                if out is None or inside == self.rows:
                    if out is not None:
                        out.close()
                    paths.append(f"{staged}/{task.partitionId()}-{task.taskAttemptId()}-{len(paths)}.sql")
                    out, inside = store.open_output_stream(paths[-1]), 0
                out.write(row["statement"].encode() + b"\n")
                inside += 1
        finally:
            if out is not None:
                out.close()
        return Staged(task.partitionId(), tuple(paths))

    def commit(self, messages: list[Staged | None]) -> None:
        store, where, staged = self._place()
        store.create_dir(where, recursive=True)
        here = {i.path: i.base_name for i in store.get_file_info(fs.FileSelector(where)) if i.type == fs.FileType.File}
        own = {path: name for path, name in here.items() if name.endswith(f"_{self.label}.sql") and name.split("_")[0].isdecimal()}
        if self.overwrite:
            for path in own:
                store.delete_file(path)
                here.pop(path)
        number = max((int(n.split("_")[0]) for n in here.values() if n.split("_")[0].isdecimal()), default=0)
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for path in message.paths:
                number += 1
                store.move(path, f"{where}/{number:04d}_{self.label}.sql")
        self._clear(store, staged)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, staged = self._place()
        self._clear(store, staged)

    @staticmethod
    def _clear(store: fs.FileSystem, staged: str) -> None:
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)
