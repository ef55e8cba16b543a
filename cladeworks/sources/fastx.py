"""FASTA and FASTQ files as a Spark data source: ``spark.read.format("fastx").load(paths)``.

Rows: ``file, ordinal, format, id, comment, seq, qual``. Plain FASTA files are split by byte ranges (option
``splitBytes``): a record belongs to the range its ">" lies in, so ranges are read independently and
``ordinal`` is then the record's byte offset; it orders a file's records in any case. FASTQ cannot be split
safely (qualities may hold any character) and compressed files cannot either: one task each, ``ordinal``
counting from 0. Compression (gzip, bzip2, xz) is told by magic bytes per file.

Records may span lines. A quality of another length than its sequence is an error; option ``permissive``
leaves the record out instead. Files are taken from a path, a folder, a glob or a comma-separated list, on local disks or any file system by URI.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeworks.sources.files import list_files, open_file, size_of

SCHEMA = "file string, ordinal bigint, format string, id string, comment string, seq string, qual string"
_MAGIC = ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open))
_SPLIT = 64 << 20


def open_any(path: str) -> tuple[io.BufferedReader, bool]:
    """(binary stream, compressed)."""
    stream = open_file(path)
    head = stream.read(6)
    stream.seek(0)
    for magic, opener in _MAGIC:
        if head.startswith(magic):
            return opener(stream, "rb"), True
    return (stream if isinstance(stream, io.BufferedReader) else io.BufferedReader(stream)), False


def _header(line: bytes) -> tuple[str, str]:
    text = line[1:].decode("utf-8", "replace").rstrip("\r\n")
    parts = text.split(None, 1)
    return (parts[0], parts[1] if len(parts) > 1 else "") if parts else ("", "")


def parse(stream, permissive: bool = False) -> Iterator[tuple[int, str, str, str, str, str | None]]:
    """(offset, format, id, comment, seq, qual) of every record."""
    line, offset = stream.readline(), 0
    while line:
        if line[:1] not in (b">", b"@"):
            offset += len(line)
            line = stream.readline()
            continue
        start, (name, comment) = offset, _header(line)
        offset += len(line)
        line, seq = stream.readline(), []
        while line and line[:1] not in (b">", b"@", b"+"):
            seq.append(line.strip())
            offset += len(line)
            line = stream.readline()
        text = b"".join(seq)
        if line[:1] != b"+":
            yield start, "fasta", name, comment, text.decode("latin-1"), None
            continue
        offset += len(line)
        qual, size = [], 0
        while size < len(text) and (line := stream.readline()):
            offset += len(line)
            qual.append(line.strip(b"\r\n"))
            size += len(qual[-1])
        line = stream.readline()
        if size != len(text):
            if not permissive:
                raise ValueError(f"record {name}: {len(text)} letters, {size} qualities")
        else:
            yield start, "fastq", name, comment, text.decode("latin-1"), b"".join(qual).decode("latin-1")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.permissive = str(options.get("permissive", "false")).lower() == "true"
        self.split = int(options.get("splitBytes", _SPLIT))
        self.paths: list[str] = []
        for part in str(options.get("path", options.get("paths", ""))).split(","):
            if part.strip():
                self.paths += list_files(part.strip())
        if not self.paths:
            raise ValueError("fastx: no path given")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in self.paths:
            stream, packed = open_any(p)
            with stream:
                first = stream.read(1)
            size = size_of(p)
            if packed or first != b">" or size <= self.split:
                out.append(_Range(p, 0, None))
            else:
                out += [_Range(p, s, min(size, s + self.split)) for s in range(0, size, self.split)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        stream, _ = open_any(partition.path)
        with stream:
            if partition.end is None:
                for n, (_, *rest) in enumerate(parse(stream, self.permissive)):
                    yield (partition.path, n, *rest)
                return
            start = partition.start
            if start:
                # a line that begins exactly at the range's start is in this range
                stream.seek(start - 1)
                start += len(stream.readline()) - 1
            for at, *rest in parse(stream, self.permissive):
                if start + at >= partition.end:
                    return
                yield (partition.path, start + at, *rest)


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, *paths: str, **options) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").options(**options).load(",".join(paths))


def fasta_text(header: Column, seq: Column, width: int = 72) -> Column:
    """A FASTA record as text."""
    from cladeworks.functions.columns import wrapped

    return F.concat(F.lit(">"), header, F.lit("\n"), wrapped(seq, width))


def write_text(df: DataFrame, path: str, line: str, order: str | None = None) -> None:
    """Write one text column; with ``order`` the files' names follow that order (a range sort, no single task)."""
    df = df.orderBy(order) if order else df
    df.select(line).write.mode("overwrite").text(path)
