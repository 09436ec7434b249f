"""Ordered datasets on shared storage, written by the executors and committed in two phases.

A dataset is a folder of parts that follow one another: JSON Lines, JSON arrays or CSV with a header, a part for each
partition that has rows. Each task writes a file of its own under a hidden folder of the job and tells the driver its name
and number of rows; only when all have done so are the files renamed to parts, in the order of the partitions, and listed
in `_SUCCESS`. A job that fails leaves none: its hidden folder is deleted, and readers pass it over until then. No row
passes the driver.

The writer is a Python data source, so it works wherever Python on the executors can write: local and mounted folders, and
what pyarrow opens by a URI (s3, gs, hdfs, abfs).
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .storage import qualified

NAME = "askloom_dataset"
KINDS = {"jsonl": "jsonl", "json": "json", "csv": "csv"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified URI, and the path on it."""
    parts = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme == "file" else fs.FileSystem.from_uri(uri)


def array_pieces(records: Iterator[dict], indent: int = 2) -> Iterator[str]:
    """The text of one JSON array; an empty one is []."""
    before = "["
    for record in records:
        body = json.dumps(record, ensure_ascii=False, indent=indent, default=str)
        yield before + "\n" + "\n".join(" " * indent + line for line in body.split("\n"))
        before = ","
    yield "[]" if before == "[" else "\n]"


def line_pieces(records: Iterator[dict]) -> Iterator[str]:
    for record in records:
        yield json.dumps(record, ensure_ascii=False, default=str) + "\n"


def csv_pieces(names: list[str], rows: Iterator[list]) -> Iterator[str]:
    """A header and the rows; missing cells are empty."""
    line = io.StringIO()
    writer = csv.writer(line)
    writer.writerow(names)
    yield line.getvalue()
    for row in rows:
        line.seek(0)
        line.truncate()
        writer.writerow(["" if v is None else v for v in row])
        yield line.getvalue()


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str | None  # none of a partition without rows
    rows: int


class DatasetWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, kind: str, names: list[str], overwrite: bool):
        self.uri, self.kind, self.names, self.overwrite = uri.rstrip("/"), kind, names, overwrite
        self.staged = f"{self.uri}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        files, path = opened(f"{self.staged}/{task.partitionId():06d}-{task.taskAttemptId()}")
        rows = 0

        def records() -> Iterator[dict]:
            nonlocal rows
            for batch in iterator:
                rows += batch.num_rows
                yield from batch.to_pylist()

        first = next(every := records(), None)
        if first is None:
            return Written(task.partitionId(), None, 0)

        def all_records() -> Iterator[dict]:
            yield first
            yield from every

        if self.kind == "csv":
            pieces = csv_pieces(self.names, (list(r.values()) for r in all_records()))
        else:
            pieces = line_pieces(all_records()) if self.kind == "jsonl" else array_pieces(all_records())
        try:
            with files.open_output_stream(path) as out:  # not after an abort: the folder is gone
                for piece in pieces:
                    out.write(piece.encode())
        except BaseException:
            if files.get_file_info(path).type == fs.FileType.File:
                files.delete_file(path)
            raise
        return Written(task.partitionId(), path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.uri)
        files.create_dir(root)
        before = [f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file]
        if self.overwrite:
            for old in before:
                files.delete_file(old.path)
        number, parts = 0 if self.overwrite else sum(f.base_name.startswith("part-") for f in before), []
        for m in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.partition):
            name = f"part-{number + len(parts):06d}.{KINDS[self.kind]}"
            files.move(m.file, f"{root}/{name}")
            parts.append({"part": name, "rows": m.rows})
        self._clear()
        with files.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, path = opened(self.staged)
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)


class DatasetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DatasetWriter:
        kind = self.options["kind"]
        if kind not in KINDS:
            raise ValueError(f"unknown kind of dataset {kind!r}")
        writer = DatasetWriter(self.options["uri"], kind, schema.names, overwrite)
        files, path = opened(writer.staged)
        files.create_dir(path)
        return writer


def write_dataset(rows: DataFrame, path: str, kind: str, order: list[str] | None = None, mode: str = "overwrite") -> str:
    """rows as a dataset at path, sorted by the columns of order; mode: overwrite or append. Returns the path with its scheme."""
    uri = qualified(rows.sparkSession, path)
    rows.sparkSession.dataSource.register(DatasetSource)
    ordered = rows.orderBy(*order) if order else rows
    ordered.write.format(NAME).option("uri", uri).option("kind", kind).mode(mode).save()
    return uri


def read_dataset(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else reader.json(path, multiLine=kind == "json")
