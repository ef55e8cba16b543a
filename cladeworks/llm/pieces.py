"""Splitting oversized items at natural boundaries, with a given overlap of consecutive pieces.

An item is a row of tokens with sizes; ``offsets`` are the prefix sums of the sizes. Cuts are searched by
bisection: the last boundary not beyond ``start + limit`` in the sorted array of boundaries, else a hard cut
at the limit; the next piece begins ``overlap`` before the cut. A boundary that would not bring the next
piece forward is no boundary.

Sequences: a token is a letter of size 1, a natural boundary a maximal run of at least ``min_gap``
characters other than A, C, G, T in either case; a cut may stand at the run's end or anywhere inside it.

Defined cases: null items give no rows; items within the limit (and empty ones) give themselves as one
piece; a limit not greater than the overlap is an error; repeated rows are cut each on its own; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, MIN_GAP = 6000, 200, 10


def find_gaps(text: str, min_gap: int = MIN_GAP) -> list[tuple[int, int]]:
    """(start, length) of the maximal runs of at least min_gap characters that are not A, C, G or T."""
    return [(m.start(), m.end() - m.start()) for m in re.compile(rf"[^ACGTacgt]{{{min_gap},}}").finditer(text)]


class _Letters:
    """Prefix sums of n tokens of size 1, without storing them."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n + 1

    def __getitem__(self, i: int) -> int:
        return i

    def last_at_most(self, x: int) -> int:
        return min(int(x), self.n)

    def first_at_least(self, x: int) -> int:
        return max(int(x), 0)


class _Sizes(_Letters):
    """Prefix sums of tokens of any sizes, searched by bisection."""

    def __init__(self, offsets: np.ndarray):
        super().__init__(len(offsets) - 1)
        self.offsets = offsets

    def __getitem__(self, i: int) -> int:
        return self.offsets[i]

    def last_at_most(self, x: int) -> int:
        return int(np.searchsorted(self.offsets, x, "right")) - 1

    def first_at_least(self, x: int) -> int:
        return int(np.searchsorted(self.offsets, x, "left"))


def cut(offsets: np.ndarray | int, boundaries: np.ndarray, limit: int, overlap: int, inside: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Pieces (first token, end token, kind of cut at the end) of one item.

    ``offsets``: prefix sums of token sizes, length tokens + 1, or the number of tokens of size 1. ``boundaries``: sorted token positions
    before which a cut is natural; ``inside`` gives for each the first position of its run, from which on a
    cut is as natural (default: the boundary itself). A token larger than the limit is a piece of its own.
    """
    sums = _Letters(offsets) if isinstance(offsets, int) else _Sizes(offsets)
    n, start, out = len(sums) - 1, 0, []
    first = boundaries if inside is None else inside
    while True:
        most = sums.last_at_most(sums[start] + limit)
        if most >= n:
            out.append((start, n, "end"))
            return out
        most = max(most, start + 1)
        at, kind = most, "hard"
        b = int(np.searchsorted(boundaries, most, "right")) - 1
        if b + 1 < len(boundaries) and first[b + 1] <= most:
            kind = "natural"
        elif b >= 0 and sums.first_at_least(sums[int(boundaries[b])] - overlap) > start:
            at, kind = int(boundaries[b]), "natural"
        out.append((start, at, kind))
        start = max(start + 1, sums.first_at_least(sums[at] - overlap))


def _checked(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")


def split_sequences(df: DataFrame, key: str, seq: str, limit: int = LIMIT, overlap: int = OVERLAP, min_gap: int = MIN_GAP) -> DataFrame:
    """``key, piece_no, piece_start, piece_end, cut, gap_starts, gap_lens, piece`` of every item.

    ``gap_starts`` and ``gap_lens`` are all natural boundaries of the item, on its first piece only.
    """
    _checked(limit, overlap)
    source = df.select(F.col(key).alias(key), F.col(seq).alias("_seq")).where("_seq IS NOT NULL")
    kind = source.schema[key].dataType.simpleString()
    names = [key, "piece_no", "piece_start", "piece_end", "cut", "gap_starts", "gap_lens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for k, text in zip(b.column(0), b.column(1).to_pylist()):
                gaps = find_gaps(text, min_gap) if len(text) > limit else []
                starts = np.array([g for g, _ in gaps], np.int64)
                ends = starts + np.array([n for _, n in gaps], np.int64)
                for i, (s, e, how) in enumerate(cut(len(text), ends, limit, overlap, starts)):
                    rows.append((k, i + 1, s, e, how, [g for g, _ in gaps] if i == 0 else None, [n for _, n in gaps] if i == 0 else None, text[s:e]))
                    size += e - s
                if size > 8_000_000:
                    yield emit(rows, b)
                    rows, size = [], 0
            if rows:
                yield emit(rows, b)

    def emit(rows: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        keys = pa.array([r[0].as_py() for r in rows], types[0])
        return pa.RecordBatch.from_arrays([keys, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types[1:], 1)]], names)

    return source.mapInArrow(run, f"`{key}` {kind}, piece_no int, piece_start bigint, piece_end bigint, cut string, gap_starts array<bigint>, gap_lens array<bigint>, piece string")


def natural_boundaries(pieces: DataFrame, key: str) -> DataFrame:
    """``key, gap_start, gap_len`` per boundary of the cut items; -1 and 0 where there is none."""
    first = pieces.where("piece_no = 1")
    gaps = F.when(F.size("gap_starts") > 0, F.arrays_zip("gap_starts", "gap_lens")).otherwise(F.array(F.struct(F.lit(-1).cast("bigint").alias("gap_starts"), F.lit(0).cast("bigint").alias("gap_lens"))))
    return first.select(key, F.explode(gaps).alias("g")).select(key, F.col("g.gap_starts").alias("gap_start"), F.col("g.gap_lens").alias("gap_len"))
