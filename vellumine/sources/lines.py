"""Line-oriented files as a Spark data source: ``spark.read.format("vellumine_lines").load(folder)``.

Files are cut into byte ranges, small ones are put together, and each task reads the lines
that begin in its ranges, so no file must fit a row or a task. A schema with fewer columns
leaves out their work. Any store that pyarrow opens by its address can be read.

Columns: path, at (the byte at which the line begins, which orders a file's lines), text,
cells (the values of delimited text, or of a Markdown row with pipes).

Options: format (txt, csv or md; by the extension if unset), encoding and delimiter (told by the
head of each file if unset), glob, recursive (true), compact (true: of blank lines of txt that
follow one another the first stays), multiline (false: a quoted value ends with its line; true: a
file of delimited text is one range), range_bytes, pushdown.

With ``pushdown`` filters on path choose files and filters on at choose ranges before anything
is opened. Spark 4.1 keeps one set of pushed filters for each load, the last: a DataFrame that is
used with several filters, or with and without one, would lose rows. So it is off unless
asked for, and then each use needs its own load.
"""

from __future__ import annotations

import csv
import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from vellumine.sources.office import SAMPLE, encoding_of
from vellumine.sources.text import delimiter_of

SCHEMA = "path string, at long, text string, cells array<string>"
RANGE_BYTES, CHUNK, BATCH = 32 << 20, 1 << 20, 4096
#: What a file costs beside its bytes when ranges are put together, as bytes.
OPEN_BYTES = 1 << 20
ENDS = re.compile(rb"\r\n|\n|\r")
# The extensions of delimited text and Markdown; all others are plain text.
BY_EXTENSION = {"csv": "csv", "tsv": "csv", "md": "md", "markdown": "md"}


def opened(address: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what stands before the path in an address."""
    store, path = fs.FileSystem.from_uri(address)
    return store, path, address[: -len(path)] if address.endswith(path) else ""


def lines_of(f: BinaryIO, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in [start, stop) and where; a line ends with CR LF, LF or CR."""
    base = max(start - 1, 0)
    f.seek(base)
    buf, ended, sought = b"", False, 0
    begin = 0 if start == 0 else None  # of the line that is read, once one has begun in the range
    while True:
        m = ENDS.search(buf, sought)
        if m is None or (not ended and m.end() == len(buf)):  # a CR at the end may be half of CR LF
            if ended:
                if begin is not None and begin < stop:
                    yield begin, buf[begin - base :]
                return
            gone = begin - base if begin is not None else max(len(buf) - 1, 0)
            chunk = f.read(CHUNK)
            sought, ended = (m.start() if m else len(buf)) - gone, not chunk
            buf, base = buf[gone:] + chunk, base + gone
            continue
        if begin is not None:
            yield begin, buf[begin - base : m.start()]
        begin, sought = base + m.end(), m.end()
        if begin >= stop:
            return


def line_before(f: BinaryIO, at: int) -> bytes:
    """The line that ends just before the line at ``at``."""
    back = 256
    while True:
        start = max(0, at - back)
        f.seek(start)
        data = f.read(at - start)
        data = data[: -len(ENDS.findall(data)[-1])]
        ends = list(ENDS.finditer(data))
        if ends or not start:
            return data[ends[-1].end() :] if ends else data
        back *= 8


@dataclass
class Slice:
    path: str
    start: int
    stop: int


class LineReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        yes = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.address, self.names, self.schema = options["path"], schema.names, schema
        self.format, self.encoding, self.delimiter, self.glob = (options.get(k) for k in ("format", "encoding", "delimiter", "glob"))
        self.recursive, self.compact, self.multiline = yes("recursive", True), yes("compact", True), yes("multiline", False)
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.of_path, self.least, self.most = [], 0, None

    # --- on the driver

    def files(self) -> list[tuple[str, int]]:
        store, path, before = opened(self.address)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.address)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=self.recursive))
        inner = lambda p: p[len(path) :].strip("/").split("/") if p != path else [""]
        seen = [i for i in infos if i.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in inner(i.path)) and (not self.glob or fnmatch.fnmatch(i.base_name, self.glob))]
        return sorted((before + i.path, i.size) for i in seen if all(test(before + i.path, v) for test, v in self.of_path))

    def partitions(self) -> list[ds.InputPartition]:
        """Ranges of large files, and small files together up to a range's bytes."""
        groups, room = [[]], self.range_bytes
        for path, size in self.files():
            step = size + 1 if self.multiline and self.kind(path) == "csv" else self.range_bytes
            for start in range(0, size + 1, step):
                stop = min(start + step, size + 1)
                if stop <= self.least or (self.most is not None and start > self.most):
                    continue
                cost = stop - start + OPEN_BYTES
                if groups[-1] and cost > room:
                    groups.append([])
                    room = self.range_bytes
                groups[-1].append(Slice(path, start, stop))
                room -= cost
        return [ds.InputPartition(g) for g in groups]

    def kind(self, path: str) -> str:
        return self.format or BY_EXTENSION.get(path.rpartition(".")[2].lower(), "txt")

    # --- in a task

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"path": pa.string(), "at": pa.int64(), "text": pa.string(), "cells": pa.list_(pa.string())}[n]) for n in self.names])
        held = {n: [] for n in self.names}
        for piece in partition.value:
            for row in self.rows(piece):
                for n in self.names:
                    held[n].append(row[n])
                if len(held[self.names[0]]) >= BATCH:
                    yield pa.RecordBatch.from_pydict(held, schema)
                    held = {n: [] for n in self.names}
        yield pa.RecordBatch.from_pydict(held, schema)

    def rows(self, piece: Slice) -> Iterator[dict]:
        store, path, _ = opened(piece.path)
        with store.open_input_file(path) as f:
            head = f.read(SAMPLE + 1)
            encoding = self.encoding or encoding_of(head)
            kind, wanted = self.kind(piece.path), "cells" in self.names
            text = head[:SAMPLE].decode(encoding, "ignore") if kind == "csv" and wanted else ""
            delimiter = self.delimiter or delimiter_of(text, piece.path.rpartition(".")[2])
            if encoding.startswith("utf-16"):  # ends of lines are no single bytes: the first range reads all
                lines = self.of_wide(f, encoding) if piece.start == 0 else iter(())
            else:
                lines = ((at, line.decode(encoding if at == 0 else encoding.removesuffix("-sig"), "replace")) for at, line in lines_of(f, piece.start, piece.stop))
            if kind == "csv" and wanted and self.multiline:
                yield from self.records(piece.path, lines, delimiter)
                return
            blank = None
            for at, line in lines:
                if kind == "txt" and self.compact:
                    if not line.strip():
                        if blank is None and at:
                            blank = not line_before(f, at).decode(encoding, "replace").strip("﻿").strip()
                        if blank:
                            continue
                    blank = not line.strip()
                cells = None
                if wanted and kind == "csv":
                    cells = next(csv.reader([line], delimiter=delimiter), [])
                elif wanted and kind == "md" and "|" in line:
                    cells = [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]
                yield {"path": piece.path, "at": at, "text": line, "cells": cells}

    @staticmethod
    def of_wide(f: BinaryIO, encoding: str) -> Iterator[tuple[int, str]]:
        f.seek(0)
        data = f.read()
        at = 2 if data[:2] in (b"\xff\xfe", b"\xfe\xff") else 0
        for n, line in enumerate(re.split("(\r\n|\n|\r)", data.decode(encoding, "replace"))):
            if n % 2 == 0:
                yield at if n else 0, line
            at += len(line.encode("utf-16-le", "surrogatepass"))

    @staticmethod
    def records(path: str, lines: Iterator[tuple[int, str]], delimiter: str) -> Iterator[dict]:
        """Records of delimited text whose quoted values may hold ends of lines; at is where the record begins."""
        taken: list[tuple[int, str]] = []

        def fed() -> Iterator[str]:
            for at, line in lines:
                taken.append((at, line))
                yield line + "\n"

        for cells in csv.reader(fed(), delimiter=delimiter):
            yield {"path": path, "at": taken[0][0], "text": "\n".join(line for _, line in taken), "cells": cells}
            taken.clear()


class PushingReader(LineReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Those on path are all that is needed; those on at choose ranges, whose rows Spark tests again."""
        tests = {ds.EqualTo: lambda p, v: p == v, ds.In: lambda p, v: p in v, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda p, v: v in p}
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and type(f) in tests and value is not None:
                self.of_path.append((tests[type(f)], value))
                continue
            if column == ("at",) and value is not None:
                if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                    self.least = max(self.least, value + isinstance(f, ds.GreaterThan))
                if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                    last = value - isinstance(f, ds.LessThan)
                    self.most = last if self.most is None else min(self.most, last)
            yield f


class Lines(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellumine_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LineReader:
        kind = PushingReader if str(self.options.get("pushdown")).lower() == "true" else LineReader
        return kind(dict(self.options), schema)


def read_lines(spark: SparkSession, path: str, *, columns: str = SCHEMA, **options) -> DataFrame:
    """The lines of a file or folder; ``columns`` is the schema, or a part of it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Lines)
    reader = spark.read.format(Lines.name()).schema(columns)
    return reader.options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)
