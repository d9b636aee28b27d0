"""A data source for sequence files of any line length: byte ranges of files, read piece by piece.

A record may be one line of hundreds of megabytes, which no line reader can
cut. Here the files are planned as ranges of bytes. Each range is read by its
own task in small buffers, finds the headers that begin in it and hands out
residues in pieces of bounded length, so neither a task nor a row ever holds a
record. Compressed files cannot be entered in the middle: one task reads such
a file as a stream, in the same pieces.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

RANGE_BYTES = 64 << 20
PIECE = 1 << 16
BUFFER = 1 << 20
#: A header line is shorter than this; so far a range looks back for the start of the line it begins in.
LONGEST_HEADER = 1 << 16

SCHEMA = "line string, file string, _tile bigint, _at bigint"
SUFFIXES = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}


def _open(path: str):
    """(file system, path inside) of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, codec: str | None):
        self.path, self.start, self.end, self.codec = path, start, end, codec


def buffers(part: Range) -> Iterator[tuple[bytes, bool]]:
    """Bytes from the range's start on, to the end of the file, and whether the first of them stands inside a header."""
    system, path = _open(part.path)
    if part.codec:
        with system.open_input_stream(path, compression=part.codec) as stream:
            while data := stream.read(BUFFER):
                yield data, False
        return
    with system.open_input_file(path) as file:
        inside = False
        if part.start:
            back = max(0, part.start - LONGEST_HEADER)
            before = file.read_at(part.start - back, back)
            line = before[before.rfind(b"\n") + 1 :] if b"\n" in before or back == 0 else b""
            inside = line.startswith(b">")
        at = part.start
        while data := file.read_at(BUFFER, at):
            yield data, inside
            inside = False
            at += len(data)


def lines(part: Range, piece: int) -> Iterator[tuple[int, str]]:
    """(place in the file, text) of headers that begin in the range, and of residues in it, in order.

    A header is read to its end even beyond the range; residues of the range
    stop at its end.
    """
    at, end = part.start, part.end if not part.codec else None
    header: list[bytes] | None = None  # pieces of an open header
    skipping, new_line = False, part.start == 0
    first = True
    held: list[bytes] = []
    size, held_at = 0, part.start

    for data, inside in buffers(part):
        if first:
            first = False
            skipping = inside
            if part.start and not inside:  # a line may begin exactly here
                system, path = _open(part.path)
                if not part.codec:
                    with system.open_input_file(path) as file:
                        new_line = file.read_at(1, part.start - 1) == b"\n"
        i = 0
        while i < len(data):
            if header is not None or skipping:
                stop = data.find(b"\n", i)
                if header is not None:
                    header.append(data[i : stop if stop >= 0 else len(data)])
                i = len(data) if stop < 0 else stop + 1
                if stop >= 0:
                    if header is not None:
                        yield header_at, b"".join(header).rstrip().decode("utf-8", "replace")
                    header, skipping, new_line = None, False, True
                continue
            if end is not None and at + i >= end:
                break
            if new_line and data[i : i + 1] == b">":
                if size:
                    yield held_at, b"".join(held).decode("utf-8", "replace")
                    held, size = [], 0
                header, header_at, new_line = [], at + i, False
                continue
            stop = data.find(b"\n", i)
            to = len(data) if stop < 0 else stop
            if end is not None:
                to = min(to, end - at)
            text = b"".join(data[i:to].split())
            while text:
                if not size:
                    held_at = at + i
                part_of = text[: piece - size]
                held.append(part_of)
                size += len(part_of)
                text = text[len(part_of) :]
                if size == piece:
                    yield held_at, b"".join(held).decode("utf-8", "replace")
                    held, size = [], 0
            new_line = to == stop
            i = to + 1 if new_line else to
        at += len(data)
        if end is not None and at >= end and header is None and not skipping:
            break
    if header is not None:
        yield header_at, b"".join(header).rstrip().decode("utf-8", "replace")
    if size:
        yield held_at, b"".join(held).decode("utf-8", "replace")


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.size, self.piece = int(options["bytes"]), int(options["piece"])

    def partitions(self) -> list[Range]:
        out = []
        for path, length in self.files:
            codec = next((c for s, c in SUFFIXES.items() if path.endswith(s)), None)
            step = max(1, length) if codec else self.size
            out += [Range(path, a, min(a + step, length), codec) for a in range(0, max(1, length), step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int, int]] = []
        size = order = read = 0
        for _, text in lines(partition, self.piece):
            # the tiles of a stream follow its residues, those of a range are one
            tile = read // self.size if partition.codec else partition.start
            rows.append((text, partition.path, tile, order))
            order += 1
            size += len(text)
            read += len(text)
            if size >= 1 << 22:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
        names = ["line", "file", "_tile", "_at"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class SequenceRanges(DataSource):
    """``files`` (JSON list of path and length), ``bytes`` of a range, longest ``piece``."""

    @classmethod
    def name(cls) -> str:
        return "sequence_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_range_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, piece: int = PIECE) -> DataFrame:
    """Headers and pieces of residues (line, file, _tile, _at), ordered by _tile and _at within a file.

    The driver lists names and lengths of the files; contents are read by the
    tasks. Paths must be of a file system that pyarrow opens.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    spark.dataSource.register(SequenceRanges)
    files = json.dumps(sorted([r["path"], r["length"]] for r in found))
    return spark.read.format("sequence_ranges").options(files=files, bytes=str(range_bytes), piece=str(piece)).load()
