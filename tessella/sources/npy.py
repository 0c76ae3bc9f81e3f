"""A Spark data source of .npy arrays: ``spark.read.format("npy").load(path)`` once it is registered.

Files are planned as byte ranges, so a large one is read by many tasks, each of which holds
a block of cells at a time.  Rows and columns that are asked for are options: blocks without an
asked cell aren't read, and only asked cells are decoded.  Conditions aren't pushed down, as Spark
4.1 keeps what was pushed with the DataFrame: a later query on it without conditions would see
the earlier one's cells.
"""

from __future__ import annotations

import fnmatch
import gzip
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

SCHEMA = "path string, row long, column long, value double"
ARROW = pa.schema([("path", pa.string()), ("row", pa.int64()), ("column", pa.int64()), ("value", pa.float64())])
#: Bytes of a file that a task reads.
SPLIT = 64 << 20
#: Cells that a task holds and hands on at once.
CELLS = 1 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ArraySource)


@dataclass
class Axis:
    """The asked places of an axis: lo <= place <= hi, and one of ``among`` (sorted) if that is given."""

    lo: float = -np.inf
    hi: float = np.inf
    among: np.ndarray | None = None

    def meets(self, first: int, last: int) -> bool:
        """Is a place of first to last asked for?"""
        first, last = max(first, self.lo), min(last, self.hi)
        if first > last or self.among is None:
            return first <= last
        at = np.searchsorted(self.among, first)
        return bool(at < len(self.among) and self.among[at] <= last)

    def keeps(self, places: np.ndarray) -> np.ndarray:
        kept = (places >= self.lo) & (places <= self.hi)
        return kept if self.among is None else kept & np.isin(places, self.among)


@dataclass
class Piece(ds.InputPartition):
    """A file's bytes from lo up to hi."""

    path: str
    lo: int
    hi: int


def _file_system(uri: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what stands before that in the full name."""
    local = uri.removeprefix("file:") if uri.startswith("file:") else uri
    if local.startswith("/"):
        return arrow_fs.LocalFileSystem(), "/" + local.lstrip("/"), "file:"
    system, path = arrow_fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)]


def _files(uri: str) -> Iterator[tuple[str, int]]:
    """(full name, bytes) of a file, of all below a folder, or of those that a pattern with * or ? fits."""
    system, path, before = _file_system(uri.rstrip("/"))
    parts = path.split("/")
    wild = next((i for i, p in enumerate(parts) if "*" in p or "?" in p), None)
    if wild is not None:
        found = system.get_file_info(arrow_fs.FileSelector("/".join(parts[:wild]) or "/", recursive=True))
        found = [f for f in found if f.path.count("/") + 1 == len(parts) and all(map(fnmatch.fnmatchcase, f.path.split("/"), parts))]
    else:
        found = system.get_file_info([path])
        if found[0].type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        if found[0].type == arrow_fs.FileType.Directory:
            found = system.get_file_info(arrow_fs.FileSelector(path, recursive=True))
    hidden = lambda f: f.base_name.startswith(("_", "."))
    return iter(sorted((before + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and not hidden(f)))


def _header(f: BinaryIO, path: str) -> tuple[int, int, bool, np.dtype]:
    """(rows, columns, whether columns lie together, type); what follows in the file are the cells."""
    version = np.lib.format.read_magic(f)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"{path}: version {version} of the format isn't read")
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) > 2 or kind.kind not in "biuf":
        raise ValueError(f"{path}: an array of {len(shape)} dimensions of {kind} isn't a table of numbers")
    rows, columns = ((1, 1), (1, *shape), shape)[len(shape)]
    return rows, columns, by_column and len(shape) == 2, kind


class ArrayReader(ds.DataSourceReader):
    def __init__(self, path: str, split: int, rows: Axis, columns: Axis) -> None:
        self.path, self.split, self.axes = path, split, {"row": rows, "column": columns}

    def partitions(self) -> list[Piece]:
        return [Piece(p, at, min(at + self.split, n)) for p, n in _files(self.path) for at in range(0, n, self.split)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:  # there is no file
            return
        system, path, _ = _file_system(partition.path)
        with system.open_input_file(path) as f:
            packed = f.read(2) == b"\x1f\x8b"
            f.seek(0)
            if not packed:
                yield from self._cells(f, partition, partition.lo, partition.hi)
            elif partition.lo == 0:  # can only be read from its beginning on
                with gzip.GzipFile(fileobj=f) as unpacked:
                    yield from self._cells(unpacked, partition, 0, None)

    def _cells(self, f: BinaryIO, piece: Piece, lo: int, hi: int | None) -> Iterator[pa.RecordBatch]:
        """The cells that begin within the piece, in the order of the file."""
        rows, columns, by_column, kind = _header(f, piece.path)
        begin, size = f.tell(), kind.itemsize
        width = rows if by_column else columns
        outer, inner = ("column", "row") if by_column else ("row", "column")
        first = max(0, -((begin - lo) // size))
        last = rows * columns if hi is None else min(rows * columns, max(0, -((begin - hi) // size)))
        for at in range(first, last, CELLS):
            end = min(at + CELLS, last)
            if not self.axes[outer].meets(at // width, (end - 1) // width):
                continue
            if at // width == (end - 1) // width and not self.axes[inner].meets(at % width, (end - 1) % width):
                continue
            f.seek(begin + at * size)
            raw = f.read((end - at) * size)
            if len(raw) < (end - at) * size:
                raise ValueError(f"{piece.path} ends early")
            line, place = np.divmod(np.arange(at, end), width)
            asked = np.flatnonzero(self.axes[outer].keeps(line) & self.axes[inner].keeps(place))
            values = np.frombuffer(raw, kind)[asked].astype(np.float64)
            there = np.flatnonzero(values != 0)  # NaN isn't 0
            where = {outer: line[asked[there]], inner: place[asked[there]]}
            values = pa.array(values[there], mask=np.isnan(values[there]))
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array([piece.path]).take(pa.array(np.zeros(len(there), np.int64))), pa.array(where["row"]), pa.array(where["column"]), values], schema=ARROW)


class ArraySource(ds.DataSource):
    """Options: ``path`` (a file, a folder or a pattern), ``split`` (bytes of a task), ``columns`` (places
    as "3,30"), ``first_row`` and ``last_row`` (both included)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        get = self.options.get
        named = get("columns")
        columns = Axis() if named is None else Axis(among=np.unique(np.array([c for c in named.split(",") if c], np.int64)))
        return ArrayReader(self.options["path"], int(get("split", SPLIT)), Axis(float(get("first_row", "-inf")), float(get("last_row", "inf"))), columns)
