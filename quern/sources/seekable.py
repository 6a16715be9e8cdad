"""Seekable zstd files as splits: a Python data source that plans partitions by the seek table.

A seek table is a skippable frame at the end of the file: an entry of compressed and
decompressed size for each frame, and a footer. A partition is a run of frames. It owns the
lines that begin behind its first byte, up to the one that begins at its last byte's
successor: it passes over what comes before its first line end and reads on into the next
frames to the end of its last line. A file without a table is one partition, read in a stream.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The magic numbers of the table's frame and of its footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Compressed bytes of a partition, about, and decompressed ones in a batch.
SPLIT, BATCH = 32 << 20, 4 << 20


def local(path: str) -> str | None:
    """The path as this machine's own, if it is one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def frames(file: BinaryIO, size: int) -> list[tuple[int, int]] | None:
    """Compressed and decompressed size of each frame; nothing without a table that fits the file."""
    if size < 17:
        return None
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    entry = 12 if flags & 0x80 else 8
    start = size - 9 - n * entry - 8
    if magic != FOOTER or start < 0:
        return None
    file.seek(start)
    head, length = struct.unpack("<II", file.read(8))
    if head != SKIPPABLE or length != n * entry + 9:
        return None
    table = file.read(n * entry)
    found = [struct.unpack_from("<II", table, k * entry) for k in range(n)]
    return found if sum(c for c, _ in found) == start else None


class _Run(InputPartition):
    def __init__(self, start: int, own: int | None):
        super().__init__((start, own))  # first byte in the file, decompressed bytes that are its own (all: None)


class SeekableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[_Run]:
        with open(self.path, "rb") as file:
            table = frames(file, os.path.getsize(self.path))
        if not table:
            return [_Run(0, None)]
        out, at, start, own = [], 0, 0, 0
        for packed, plain in table:
            at, own = at + packed, own + plain
            if at - start >= self.split:
                out.append(_Run(start, own))
                start, own = at, 0
        return [*out, _Run(start, own)] if own or not out else out

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        start, own = partition.value
        part, held = [], 0
        for line in self._lines(start, own):
            part.append(line)
            held += len(line)
            if held > BATCH:
                yield _batch(start, part)
                part, held = [], 0
        if part:
            yield _batch(start, part)

    def _lines(self, start: int, own: int | None) -> Iterator[bytes]:
        import zstandard

        with open(self.path, "rb") as file:
            file.seek(start)
            with zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True) as stream:
                begun, at, rest = start == 0, 0, b""  # ``at``: where ``rest`` begins
                while block := stream.read(BATCH):
                    *whole, tail = (rest + block).split(b"\n")
                    for line in whole:
                        if begun:
                            yield line
                        begun = True
                        at += len(line) + 1
                        if own is not None and at > own:
                            return
                    rest = tail
                if rest and begun:
                    yield rest


def _batch(start: int, lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block_start": pa.array([start] * len(lines), pa.int64()), "value": pa.array(lines, pa.binary())})


class SeekableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zstdlines"

    def schema(self) -> str:
        return "block_start long, value binary"

    def reader(self, schema) -> SeekableReader:
        return SeekableReader(dict(self.options))


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Lines of a zstd file on this machine or a folder that all share: block_start and value."""
    spark.dataSource.register(SeekableSource)
    return spark.read.format("zstdlines").option("path", local(path)).option("split", str(split)).load()
