"""Nucleotide volumes of BLAST databases (index .nin, headers .nhr, sequences .nsq) as a data source.

``spark.read.format("blastdb").load("path/volume")`` gives ``oid, header, taxid, seq``. Options: ``split``
(one row per header of a record), ``taxid`` (headers begin ``kraken:taxid|N|``), ``rows`` per task.

Letters are packed two bits each; the last byte counts the letters in it; ambiguous letters are runs that
overwrite ranges, in 32-bit or 64-bit records. Headers are ASN.1 (BER) lists of definition lines.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeworks.sources.files import open_file

#: Letters of the 4-bit ambiguity masks A=1, C=2, G=4, T=8 (fixed values).
MASK_LETTERS = b"-ACMGRSVTWYHKDBN"
_FOUR = np.frombuffer(b"ACGT", np.uint8)[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]


class VolumeIndex:
    """Offsets of a volume's index file (format versions 4 and 5)."""

    def __init__(self, data: bytes):
        self.at, self.data = 0, data
        self.version, self.kind = self._int(), self._int()
        if self.kind != 0:
            raise ValueError("only nucleotide volumes can be read")
        if self.version >= 5:
            self._int()
        self.title = self._text()
        if self.version >= 5:
            self._text()
        self.date = self._text()
        self.n = self._int()
        self.at += 8
        self.longest = self._int()
        size = 4 * (self.n + 1)
        self.headers, self.seqs, self.ambiguous = (np.frombuffer(data, ">u4", self.n + 1, self.at + i * size).astype(np.int64) for i in range(3))

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">I", self.data, self.at - 4)[0]

    def _text(self) -> str:
        n = self._int()
        self.at += n
        return self.data[self.at - n : self.at].decode("latin-1")


def decode_sequence(packed: bytes, ambiguity: bytes) -> str:
    raw = np.frombuffer(packed, np.uint8)
    rest = int(raw[-1] & 3)
    letters = np.concatenate([_FOUR[raw[:-1]].reshape(-1), _FOUR[raw[-1]][:rest]])
    if len(ambiguity) >= 4:
        first = struct.unpack_from(">I", ambiguity)[0]
        count, wide = first & 0x7FFFFFFF, first >> 31
        if wide:
            runs = [(x >> 60, (x >> 48) & 0xFFF, x & 0xFFFFFFFFFFFF) for (x,) in struct.iter_unpack(">Q", ambiguity[4 : 4 + count // 2 * 8])]
        else:
            runs = [(x >> 28, (x >> 24) & 0xF, x & 0xFFFFFF) for (x,) in struct.iter_unpack(">I", ambiguity[4 : 4 + count * 4])]
        for mask, more, start in runs:
            letters[start : start + more + 1] = MASK_LETTERS[mask]
    return letters.tobytes().decode("ascii")


def ber(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, object]]:
    """(tag, value) of the elements in data[at:end]; constructed values are lists. Lengths may be indefinite."""
    return _ber(data, at, len(data) if end is None else end)[0]


def _ber(data: bytes, at: int, end: int) -> tuple[list, int]:
    out = []
    while at < end:
        tag = data[at]
        at += 1
        if tag == 0 and data[at] == 0:
            return out, at + 1
        if tag & 0x1F == 0x1F:  # a long tag number
            number = 0
            while True:
                number = number << 7 | data[at] & 0x7F
                at += 1
                if not data[at - 1] & 0x80:
                    break
            tag = tag & 0xE0 | 0x1F | number << 8
        size = data[at]
        at += 1
        if size == 0x80:
            value, at = _ber(data, at, end)
        else:
            if size & 0x80:
                k = size & 0x7F
                size = int.from_bytes(data[at : at + k], "big")
                at += k
            value = _ber(data, at, at + size)[0] if tag & 0x20 else data[at : at + size]
            at += size
        out.append((tag, value))
    return out, at


def _leaf(value) -> object:
    while isinstance(value, list) and len(value) == 1:
        value = value[0][1]
    return value


def _text(value) -> str:
    v = _leaf(value)
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else ""


def _number(value) -> int:
    v = _leaf(value)
    return int.from_bytes(v, "big", signed=True) if isinstance(v, bytes) else 0


#: Choices of a sequence id that are text ids with accession and version (context tags; fixed values), and others.
_TEXT_IDS = {4, 5, 6, 7, 9, 10, 12, 13, 15, 16, 17, 18}
_LOCAL, _GENERAL, _GI, _PDB = 0, 10, 11, 14
_TEXT = _TEXT_IDS - {10}


def seq_id(tag: int, value) -> str:
    """Text of one sequence id: accession.version where it has one."""
    choice = tag & 0x1F
    body = value[0][1] if isinstance(value, list) and len(value) == 1 and value[0][0] == 0x30 else value
    if choice in _TEXT and isinstance(body, list):
        parts = {t & 0x1F: v for t, v in body}
        name, accession = _text(parts.get(0, b"")), _text(parts.get(1, b""))
        version = f".{_number(parts[3])}" if 3 in parts else ""
        return (accession or name) + version
    if choice == _GENERAL and isinstance(body, list):
        parts = {t & 0x1F: v for t, v in body}
        tag_value = _leaf(parts.get(1, b""))
        inner = tag_value if isinstance(tag_value, bytes) else b""
        text = inner.decode("utf-8", "replace") if inner.isascii() and inner.decode("latin-1").isprintable() else str(_number(inner))
        return f"gnl|{_text(parts.get(0, b''))}|{text}"
    if choice == _PDB and isinstance(body, list):
        parts = {t & 0x1F: v for t, v in body}
        return "|".join(x for x in ("pdb", _text(parts.get(0, b"")), _text(parts.get(3, parts.get(1, b"")))) if x)
    if choice == _GI:
        return str(_number(value))
    v = _leaf(value)
    if isinstance(v, bytes):
        return v.decode("latin-1") if v.decode("latin-1").isprintable() and v else str(_number(v))
    return ""


def definition_lines(data: bytes) -> list[tuple[str, str, int]]:
    """(id, title, taxid) of a header record."""
    out = []
    for _, lines in ber(data):
        for _, line in lines if isinstance(lines, list) else []:
            title, ids, taxid = "", [], 0
            for tag, value in line:
                if tag & 0x1F == 0:
                    title = _text(value)
                elif tag & 0x1F == 1:
                    inner = value[0][1] if len(value) == 1 and value[0][0] == 0x30 else value
                    ids = [seq_id(t, v) for t, v in inner if t & 0x1F != _GI] or [seq_id(t, v) for t, v in inner]
                elif tag & 0x1F == 2:
                    taxid = _number(value)
            out.append((ids[0] if ids else "", title, taxid))
    return out


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BlastReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = str(options["path"]).removeprefix("file://").removesuffix(".nin")
        self.split = str(options.get("split", "false")).lower() == "true"
        self.tag = str(options.get("taxid", "false")).lower() == "true"
        self.rows = int(options.get("rows", 100_000))

    def _index(self) -> VolumeIndex:
        with open_file(self.path + ".nin") as f:
            return VolumeIndex(f.read())

    def partitions(self) -> list[InputPartition]:
        n = self._index().n
        return [_Rows(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        x = self._index()
        with open_file(self.path + ".nsq") as seqs, open_file(self.path + ".nhr") as heads:
            for i in range(partition.first, partition.last):
                seqs.seek(x.seqs[i])
                block = seqs.read(int(x.seqs[i + 1] - x.seqs[i]))
                cut = int(x.ambiguous[i] - x.seqs[i])
                seq = decode_sequence(block[:cut], block[cut:])
                heads.seek(x.headers[i])
                lines = definition_lines(heads.read(int(x.headers[i + 1] - x.headers[i])))
                texts = [(f"kraken:taxid|{t}|" if self.tag and t else "") + f"{name} {title}".strip() for name, title, t in lines]
                if self.split:
                    for text, (_, _, t) in zip(texts, lines):
                        yield i, text, t, seq
                else:
                    yield i, "\x01".join(texts), lines[0][2] if lines else 0, seq


class BlastSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blastdb"

    def schema(self) -> str:
        return "oid bigint, header string, taxid bigint, seq string"

    def reader(self, schema) -> DataSourceReader:
        return BlastReader(self.options)
