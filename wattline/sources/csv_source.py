"""CSV files as a Spark data source of their own.

Every file has its own header, so a column is found by its name wherever it
lies.  A file is read in ranges of bytes; a record belongs to the range in which
it begins, and each range reads the file's header itself.  Fields may be quoted
and hold commas, doubled quotes and line breaks: a line break ends a record
where an even number of quotes lies before it in the file, so a range that
doesn't begin the file counts the quotes before it (``quotedBreaks`` false skips
that, for files in which no field has a line break).  Records come out as Arrow
batches.  Nothing is read while a plan is built but the list of files.

Files are reached through Arrow's file systems (local paths and the addresses
those know).
"""

from __future__ import annotations

import csv
import fnmatch
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

RANGE_BYTES = 128 << 20
BLOCK = 1 << 20
LONE_RETURN = re.compile("\r(?!\n)")
ROWS = 10_000
#: Ranges of all files together, about; more than that and ranges get longer.
MOST_RANGES = 1024


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """The files (path, size) of a file, a folder and those below it, or a pattern."""
    fs, p = file_system(path)
    if any(c in p for c in "*?["):
        top = posixpath.dirname(p)
        while any(c in top for c in "*?["):
            top = posixpath.dirname(top)
        infos = [i for i in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if fnmatch.fnmatch(i.path, p)]
    else:
        top, one = p, fs.get_file_info(p)
        if one.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [one] if one.is_file else fs.get_file_info(pafs.FileSelector(p, recursive=True))
    hidden = lambda i: any(x[0] in "_." for x in i.path[len(top):].split("/") if x)
    return sorted((i.path, i.size) for i in infos if i.is_file and i.size and not hidden(i))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def records(f, start: int, end: int, quotes_before: int) -> Iterator[bytes]:
    """The records that begin in [start, end) of a readable file;
    ``quotes_before`` counts the quotes before the byte ``start`` - 1."""
    at = max(start - 1, 0)  # the byte before tells whether a record begins at ``start``
    f.seek(at)
    parity, rest, first = quotes_before % 2, b"", at  # ``first``: where ``rest`` begins
    began = start == 0
    while True:
        block = f.read(BLOCK)
        if not block:
            if began and rest and first < end:
                yield rest
            return
        data = np.frombuffer(block, np.uint8)
        odd = (parity + np.cumsum(data == 34)) % 2
        parity = int(odd[-1])
        cut = np.flatnonzero((data == 10) & (odd == 0)) + 1
        lo = 0
        for hi in cut.tolist():
            if began:
                if first >= end:
                    return
                yield rest + block[lo:hi]
            began, rest, first, lo = True, b"", first + len(rest) + hi - lo, hi
        rest += block[lo:]
        if began and first >= end:
            return


def quotes(f, end: int) -> int:
    """How many quotes lie before ``end``."""
    f.seek(0)
    n = 0
    while end > 0:
        block = f.read(min(BLOCK, end))
        if not block:
            break
        n += block.count(b'"')
        end -= len(block)
    return n


def fields(raw: Iterator[bytes]) -> Iterator[list[str]]:
    """The fields of each record.  A carriage return that ends no line is a blank."""
    csv.field_size_limit(1 << 30)
    return csv.reader(LONE_RETURN.sub(" ", r.decode("utf-8", "replace").rstrip("\r\n")) for r in raw)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.headers: dict[str, str] = json.loads(options["headers"])
        self.size = int(options.get("rangebytes") or RANGE_BYTES)
        self.breaks = options.get("quotedbreaks", "true").lower() != "false"

    def partitions(self) -> list[Range]:
        """Ranges of ``rangeBytes`` or longer: each is a task that reads its file's header and
        counts the quotes before it, so their number must not grow with the input."""
        found = files(self.path)
        size = max(self.size, -(-sum(n for _, n in found) // MOST_RANGES))
        return [Range(p, lo, min(lo + size, n)) for p, n in found for lo in range(0, n, size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(part.path) as f:
            head = next(records(f, 0, 1, 0))
            names = [x.strip().lstrip("\ufeff").strip() for x in next(fields(iter([head])))]
            place = {n: names.index(h) if h in names else None for n, h in self.headers.items()}
            before = quotes(f, max(part.start - 1, 0)) if self.breaks and part.start else 0
            own = (r for r in records(f, part.start, part.end, before) if r.rstrip(b"\r\n") != head.rstrip(b"\r\n"))
            rows: list[list[str]] = []
            for row in fields(own):
                if any(x.strip() for x in row):
                    rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(rows, place, part.path)
                    rows = []
            if rows:
                yield self._batch(rows, place, part.path)

    def _batch(self, rows: list[list[str]], place: dict[str, int | None], path: str) -> pa.RecordBatch:
        cols = [pa.array([path] * len(rows), pa.string())]
        for k in place.values():
            cols.append(pa.array([None if k is None or k >= len(r) or r[k] == "" else r[k] for r in rows], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=self.schema.names)


class HeadedCsv(DataSource):
    """``spark.read.format("headed_csv")`` with the options ``headers`` (JSON: column
    name to header), ``rangeBytes`` and ``quotedBreaks``; every column is text."""

    @classmethod
    def name(cls) -> str:
        return "headed_csv"

    def schema(self) -> StructType:
        names = json.loads(self.options["headers"])
        return StructType([StructField("_file", StringType()), *[StructField(n, StringType()) for n in names]])

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))
