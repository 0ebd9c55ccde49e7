"""Numeric matrices of MATLAB files (version 5 format) as a Spark data source, without other libraries.

A matrix is stored column after column, mostly in one compressed element. A task gives a range of its rows: it opens the
element once for each wanted column, inflates it piece by piece, skips to its rows and puts the columns' pieces side by
side, so its memory is a piece for each column whatever the file's size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: storage types of numbers, the types of an element, and the classes of numeric matrices.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
NUMERIC_CLASSES = range(6, 16)
#: Bytes that are read or inflated at once, and rows of a task.
PIECE, ROWS = 1 << 18, 1 << 20


class Bytes:
    """The bytes of an element, front to back, inflated if they are compressed."""

    def __init__(self, stream, size: int, compressed: bool):
        self.stream, self.left, self.z, self.held = stream, size, zlib.decompressobj() if compressed else None, b""

    def _more(self) -> bytes:
        if self.z is not None and self.z.unconsumed_tail:
            return self.z.decompress(self.z.unconsumed_tail, PIECE)
        raw = self.stream.read(min(PIECE, self.left))
        self.left -= len(raw)
        if not raw:
            raise ValueError("the file ends inside an element")
        return raw if self.z is None else self.z.decompress(raw, PIECE)

    def take(self, n: int) -> bytes:
        parts = [self.held]
        size = len(self.held)
        while size < n:
            parts.append(self._more())
            size += len(parts[-1])
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = self._more()
        self.held = self.held[n:]


@dataclass(frozen=True)
class Found:
    """A matrix in a file: where its element is, and what its numbers look like there."""

    at: int
    size: int
    compressed: bool
    order: str
    rows: int
    columns: int
    kind: str
    data: int  # bytes of the element before the numbers


def _matrix(body: Bytes, order: str) -> tuple[str, int, tuple[int, ...], str, int]:
    """(name, class, dimensions, type of the numbers, bytes up to them) of a matrix element after its tag."""
    used = 0

    def element() -> tuple[int, bytes]:
        nonlocal used
        head = body.take(8)
        kind, size = struct.unpack(order + "II", head)
        used += 8
        if kind >> 16:
            return kind & 0xFFFF, head[4 : 4 + (kind >> 16)]
        data = body.take(size + -size % 8)[:size]
        used += size + -size % 8
        return kind, data

    _, flags = element()
    _, dims = element()
    _, name = element()
    shape = struct.unpack(f"{order}{len(dims) // 4}i", dims)
    kind, _ = struct.unpack(order + "II", head := body.take(8))
    # a small element of numbers stands in its own tag
    at = used + (4 if kind >> 16 else 8)
    body.held = (head[4:] if kind >> 16 else b"") + body.held
    return name.decode("latin-1"), struct.unpack(order + "I", flags[:4])[0] & 0xFF, shape, NUMBERS.get(kind & 0xFFFF, ""), at


def find(path: str, name: str) -> Found:
    """Look through a file for the matrix ``name``; of other elements no more than their heads is inflated."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        head, end = f.read(128), f.size()
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise ValueError("not a MATLAB file of version 5")
        order, at, seen = "<" if head[126:128] == b"IM" else ">", 128, []
        while at + 8 <= end:
            f.seek(at)
            kind, size = struct.unpack(order + "II", f.read(8))
            body = Bytes(f, size, kind == COMPRESSED)
            before = 0
            if kind == COMPRESSED:
                kind, _ = struct.unpack(order + "II", body.take(8))
                before, compressed = 8, True
            else:
                compressed = False
            if kind == MATRIX:
                own, group, shape, number, used = _matrix(body, order)
                if own == name:
                    if group not in NUMERIC_CLASSES or len(shape) != 2 or not number:
                        raise ValueError(f"{name} isn't a full matrix of numbers")
                    return Found(at + 8, size, compressed, order, shape[0], shape[1], number, before + used)
                seen.append(own)
            at += 8 + size + (0 if compressed else -size % 8)
    raise ValueError(f"no matrix {name!r}; there are {', '.join(seen) or 'none'}")


def columns(path: str, m: Found, wanted: int, first: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Pieces of rows ``first`` on: an array for each of the first ``wanted`` columns."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    width, streams = np.dtype(m.kind).itemsize, []
    try:
        for c in range(wanted):
            f = system.open_input_file(inner)
            streams.append((f, Bytes(f, m.size, m.compressed)))
            f.seek(m.at)
            streams[-1][1].skip(m.data + (c * m.rows + first) * width)
        while rows:
            n = min(rows, PIECE // width)
            yield [np.frombuffer(body.take(n * width), m.order + m.kind).astype(np.float64) for _, body in streams]
            rows -= n
    finally:
        for f, _ in streams:
            f.close()


@dataclass
class Rows(InputPartition):
    first: int
    rows: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, name: str, wanted: int, at_once: int):
        self.path, self.wanted, self.at_once = path, wanted, at_once
        self.found = find(path, name)
        if self.found.columns < wanted:
            raise ValueError(f"{name} has {self.found.columns} columns, not {wanted}")

    def partitions(self) -> list[InputPartition]:
        n = self.found.rows
        return [Rows(k, min(self.at_once, n - k)) for k in range(0, n, self.at_once)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for piece in columns(self.path, self.found, self.wanted, partition.first, partition.rows):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in piece], [f"c{k}" for k in range(self.wanted)])


class MatrixSource(DataSource):
    """``spark.read.format("mat5").option("matrix", name).option("columns", n).load(path)``, with ``rows`` for a task: columns c0, c1, ... as doubles."""

    @classmethod
    def name(cls) -> str:
        return "mat5"

    def schema(self) -> str:
        return ", ".join(f"c{k} double" for k in range(int(self.options["columns"])))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        path = self.options["path"]
        return MatrixReader(path if "://" in path or path.startswith("file:") else f"file://{path}", self.options["matrix"], int(self.options["columns"]), int(self.options.get("rows", ROWS)))


def read_matrix(spark: SparkSession, path: str, name: str, schema: str, rows: int = ROWS) -> DataFrame:
    """The first columns of a matrix, as ``schema`` names and types them."""
    kinds = T._parse_datatype_string(schema)
    spark.dataSource.register(MatrixSource)
    found = spark.read.format("mat5").option("matrix", name).option("columns", len(kinds)).option("rows", rows).load(path)
    return found.select(*[F.col(f"c{k}").cast(f.dataType).alias(f.name) for k, f in enumerate(kinds)])
