"""Files as blocks, and their conversion: one row per file, read and written on the executors.

A file that cannot be read gives a row with its error and does not fail the job.
"""

from __future__ import annotations

import contextlib
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from vellumine.shared import dealt
from vellumine.sinks.office import WRITERS
from vellumine.sources import office
from vellumine.sources.formats import FORMATS, format_of_ext, resolve
from vellumine.sources.lines import opened
from vellumine.sources.office import Options, ReadError, format_of_content
from vellumine.sources.pdf import read_pdf
from vellumine.sources.runs import RUNS, block
from vellumine.sources.xls import read_xls

READERS = office.READERS | {"pdf": read_pdf, "xls": read_xls}
BLOCKS = f"array<struct<kind:string,text:string,heading:int,list_kind:string,level:int,cells:array<struct<r:int,c:int,row_span:int,col_span:int,text:string>>,runs:{RUNS},align:string,image:binary>>"
#: Files that a task holds as Python objects at once, by rows and by bytes of Arrow; one larger file is held alone.
PIECE_ROWS, PIECE_BYTES = 64, 1 << 20
#: Files that a task opens.
FILES = 5_000
#: What a damaged file can raise.
DAMAGE = (ReadError, ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError, RecursionError, struct.error, zlib.error, zipfile.BadZipFile)


def scan(spark: SparkSession, path: str | list[str], *, recursive: bool = True, glob: str | None = None, known_only: bool = False) -> DataFrame:
    """path, content, length of the files of folders or globs, or of files; ``known_only`` leaves out unknown extensions.

    Places that hold one another would list a file twice: name each file once.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    got = reader.load(path).select("path", "content", "length")
    if not known_only:
        return got
    known = [e for _, es, *_ in FORMATS for e in es]
    return got.where(F.lower(F.regexp_extract("path", r"\.([^./\\\\]+)$", 1)).isin(*known))


def contents(files: DataFrame, *, path: str = "path") -> DataFrame:
    """path, content, length of the files that rows name, null where there is none.

    Tasks open them, so the driver lists nothing. Paths are as ``write_files`` reports them: a folder's address and a bare name.
    """
    return dealt(files.select(F.col(path).alias("path")), "path", each=FILES).mapInArrow(_contents, "path string, content binary, length long")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("length", pa.int64())])
    stores: dict[str, tuple[fs.FileSystem, str]] = {}
    for batch in batches:
        rows, held = [], 0
        for path in batch["path"].to_pylist():
            content = None
            if path is not None:
                folder, _, name = path.rpartition("/")
                if folder not in stores:
                    stores[folder] = opened(folder)[:2]
                store, place = stores[folder]
                with contextlib.suppress(FileNotFoundError), store.open_input_stream(f"{place}/{name}") as f:
                    content = f.read()
            rows.append({"path": path, "content": content, "length": None if content is None else len(content)})
            held += len(content or b"")
            if held > PIECE_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def detect(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with format: content and extension together."""

    @F.pandas_udf("string")
    def inside(data: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else format_of_content(bytes(x)) for x in data], dtype=object)

    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    return files.withColumn("format", resolve(format_of_ext(ext), inside(content)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces: as Python objects, a whole batch of nested rows takes many times its bytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(PIECE_ROWS, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > PIECE_BYTES:
                n //= 2
            yield b.slice(at, n)
            at += n


def _in_pieces(rows: DataFrame, run: Callable[[pa.RecordBatch], dict[str, list]], kept: list[str], added: dict[str, str]) -> DataFrame:
    """The columns ``kept`` of ``rows`` and those ``added`` that ``run`` makes of a piece as lists."""
    types = {k: to_arrow_type(DataType.fromDDL(t)) for k, t in added.items()}  # on the driver, which parses them

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = run(b)
            yield pa.RecordBatch.from_pydict({k: b[k] for k in kept} | {k: pa.array(made[k], t) for k, t in types.items()})

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(each, ", ".join(f"{k} {t}" for k, t in ({k: kinds[k] for k in kept} | added).items()))


def _as_rows(blocks: list[dict]) -> list[dict]:
    return [b | {"cells": [dict(zip(("r", "c", "row_span", "col_span", "text"), x, strict=True)) for x in b["cells"]]} for b in blocks]


def _from_rows(blocks) -> list[dict]:
    """Blocks from rows; fields that the rows don't have are plain."""
    out = []
    for row in blocks:
        b = {k: v for k, v in dict(row).items() if v is not None}
        runs = [dict(r) for r in b.pop("runs", [])]
        cells = [(x["r"], x["c"], x["row_span"], x["col_span"], x["text"]) for x in b.pop("cells", [])]
        out.append(block(**b, cells=cells, runs=runs))
    return out


def _read(data: bytes | None, fmt: str | None, options: dict) -> tuple[list[dict], str | None, list[str]]:
    """Blocks, error and warnings of one file."""
    asked = Options(**options)
    try:
        if data is None or fmt not in READERS:
            raise ReadError(f"no reader for {fmt}")
        return READERS[fmt](bytes(data), asked), None, asked.warnings
    except DAMAGE as e:
        return [], f"{type(e).__name__}: {e}", asked.warnings


def read(files: DataFrame, *, key: str = "path", content: str = "content", fmt: str = "format", **options) -> DataFrame:
    """key, blocks, error, warnings: null content or an unknown format is an error too.

    Options are those of ``office.Options``: delimiter, pages, hidden_sheets, max_rows.
    """

    def run(b: pa.RecordBatch) -> dict[str, list]:
        got = [_read(data, f, options) for data, f in zip(b["_content"].to_pylist(), b["_format"].to_pylist(), strict=True)]
        return {"blocks": [_as_rows(x) for x, _, _ in got], "error": [e for _, e, _ in got], "warnings": [w for _, _, w in got]}

    rows = files.select(key, F.col(content).alias("_content"), F.col(fmt).alias("_format"))
    return _in_pieces(rows, run, [key], {"blocks": BLOCKS, "error": "string", "warnings": "array<string>"})


PROPERTIES = "title string, author string, subject string, keywords string, page_width double, page_height double, margin_left double, margin_right double, margin_top double, margin_bottom double"


def properties(files: DataFrame, *, key: str = "path", content: str = "content", fmt: str = "format") -> DataFrame:
    """key and what each document says about itself; nulls where it says nothing or can't be read."""
    names = [p.split()[0] for p in PROPERTIES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data, f in zip(b["_content"], b["_format"], strict=True):
                try:
                    rows.append(office.properties(bytes(data), f) if data is not None else {})
                except DAMAGE:
                    rows.append({})
            yield pd.DataFrame({key: b[key].array} | {n: pd.Series([r.get(n) for r in rows], dtype="float64" if n.startswith(("page", "margin")) else object) for n in names})

    return files.select(key, F.col(content).alias("_content"), F.col(fmt).alias("_format")).mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, {PROPERTIES}")


def write(documents: DataFrame, target: str, *, key: str = "path") -> DataFrame:
    """key, output (the bytes of a file of the target format) for documents with a column blocks."""
    if target not in WRITERS:
        raise ValueError(f"no writer for {target}")

    def run(b: pa.RecordBatch) -> dict[str, list]:
        rows = b["blocks"].to_pandas(integer_object_nulls=True)  # much faster than to_pylist for what nests
        return {"output": [WRITERS[target](_from_rows(x), "") for x in rows]}

    return _in_pieces(documents.select(key, "blocks"), run, [key], {"output": "binary"})


def convert(files: DataFrame, target: str, **options) -> DataFrame:
    """path, format, output, error, warnings: every file converted where it is read, broken ones with their error.

    A file that has the target's format already is passed on as it is.
    """
    if target not in WRITERS:
        raise ValueError(f"no writer for {target}")

    def run(b: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for data, fmt in zip(b["content"].to_pylist(), b["format"].to_pylist(), strict=True):
            output, warnings = None, []
            if data is not None and fmt == target:
                output, error = bytes(data), None
            else:
                blocks, error, warnings = _read(data, fmt, options)
                output = WRITERS[target](blocks, "") if error is None else None
            rows.append((output, error, warnings))
        return {k: [r[i] for r in rows] for i, k in enumerate(("output", "error", "warnings"))}

    return _in_pieces(detect(files).select("path", "content", "format"), run, ["path", "format"], {"output": "binary", "error": "string", "warnings": "array<string>"})


convert_files = convert  # the name at the package's top, where ``convert`` is a module


def blocks_of(documents: DataFrame, *, key: str = "path") -> DataFrame:
    """key, ord, kind, text, heading, list_kind, level: the blocks as rows."""
    return documents.select(key, F.posexplode("blocks").alias("ord", "b")).select(key, "ord", "b.kind", "b.text", "b.heading", "b.list_kind", "b.level")


def cells_of(documents: DataFrame, *, key: str = "path") -> DataFrame:
    """key, ord, r, c, row_span, col_span, text: the cells of all tables as rows."""
    return documents.select(key, F.posexplode("blocks").alias("ord", "b")).select(key, "ord", F.explode("b.cells").alias("x")).select(key, "ord", "x.r", "x.c", "x.row_span", "x.col_span", "x.text")


def runs_of(documents: DataFrame, *, key: str = "path") -> DataFrame:
    """key, ord, part and the fields of each run as rows."""
    rows = documents.select(key, F.posexplode("blocks").alias("ord", "b"))
    return rows.select(key, "ord", F.posexplode("b.runs").alias("part", "r")).select(key, "ord", "part", "r.*")
