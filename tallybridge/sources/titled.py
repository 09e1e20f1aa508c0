"""Text files whose header stands below title lines, as a Spark data source: read in byte ranges by the executors, never whole on the driver."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .headers import HEADER_ROWS, find_header, norm_header

#: Bytes of a range, which is one task, and rows of a batch that it hands over.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 4096


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The file system of a path or address, and the file or the files of the folder, hidden ones left out."""
    fs, at = pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    found = fs.get_file_info(pafs.FileSelector(at)) if info.type == pafs.FileType.Directory else [info]
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._"), key=lambda f: f.path)


def _opened(fs: pafs.FileSystem, path: str) -> io.BufferedReader:
    return io.BufferedReader(fs.open_input_file(path), 1 << 20)


def _split(line: bytes, options: dict) -> list[str]:
    text = line.decode(options.get("encoding", "utf-8"), errors="replace").lstrip("﻿").rstrip("\r\n")
    return next(csv.reader([text], delimiter=options.get("sep", ",")), [])


@dataclass
class Head:
    """The header of a file: its line from 0, the expected names that it has, its names, and where the rows begin."""

    line: int
    hits: int
    names: list[str]
    stop: int


def head_of(f: io.BufferedReader, options: dict) -> Head:
    """The line among the first ten that has most of the expected names."""
    lines = [x for x in (f.readline() for _ in range(HEADER_ROWS)) if x]
    rows = [_split(x, options) for x in lines]
    line, hits = find_header(rows, json.loads(options.get("expected", "[]")))
    return Head(line, hits, [norm_header(v) for v in rows[line]] if rows else [], sum(map(len, lines[: line + 1])))


def first_head(path: str, **options: str) -> Head | None:
    """The header of the first file of ``path``; None where there is no file."""
    fs, files = _files(path)
    if not files:
        return None
    with _opened(fs, files[0].path) as f:
        return head_of(f, options)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class TitledReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[Range]:
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        return [Range(f.path, at, min(at + step, f.size)) for f in _files(self.options["path"])[1] for at in range(0, f.size, step)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Rows of the lines that begin within the range."""
        if not part.path:
            return
        with _opened(_files(self.options["path"])[0], part.path) as f:
            head = head_of(f, self.options)
            at = head.stop
            if part.start > at:
                f.seek(part.start - 1)  # a line that begins just here belongs to this range
                at = part.start - 1 + len(f.readline())
            else:
                f.seek(at)
            places = [head.names.index(n) if n in head.names else -1 for n in self.names]
            rows: list[list[str | None]] = []
            while at < part.stop and (line := f.readline()):
                at += len(line)
                values = _split(line, self.options)
                if values:
                    rows.append([values[k] or None if 0 <= k < len(values) else None for k in places])
                if len(rows) == BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], self.names)


class TitledText(DataSource):
    """Format ``titled_text``: separated text, one row a line, whose header is found among the first ten lines of every file.

    Options: ``expected`` (the names to look for, as a JSON list), ``sep``, ``encoding`` (one in which a line end is the byte 10) and ``rangeBytes``. All columns are
    text; an empty value is null, as is one that a short line lacks; values beyond the header, columns without a name and later ones of equal name are left
    out, as are empty lines. Files may have their columns in different orders: those of the first file are read. A folder without files has no columns and is an error.
    A value can't hold a line end, so any byte range can be read by itself. Paths are those of pyarrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "titled_text"

    def schema(self) -> T.StructType:
        head = first_head(**dict(self.options))
        if head is None:
            raise ValueError(f"no files in {self.options['path']}")
        return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(head.names) if n])

    def reader(self, schema: T.StructType) -> TitledReader:
        return TitledReader(schema, dict(self.options))


def read_titled(spark: SparkSession, path: str, expected: list[str], **options):
    """A DataFrame of ``titled_text``."""
    spark.dataSource.register(TitledText)
    return spark.read.format("titled_text").options(expected=json.dumps(expected), **options).load(path)
