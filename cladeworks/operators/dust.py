"""Low-complexity masking: the union of the perfect intervals of the symmetric DUST measure.

For an interval of triplets i..j, R counts the pairs of equal triplets in it and R / (j - i) is its score. It
is perfect if its score is above level/10 and no interval inside it scores more; intervals span at most a
window. R of all intervals of one width follows from the two narrower widths, so the masker runs over whole
sequences in window-2 numpy steps. Runs of A, C, G, T are masked each on its own and upper-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeworks.functions.kmers import DNA_CODE, clean_windows, joined, kmers


def low_complexity(codes: np.ndarray, window: int = 64, level: int = 20) -> np.ndarray:
    """Whether each letter is masked; ambiguous letters never are and end every interval."""
    n = len(codes)
    masked = np.zeros(n, bool)
    m = n - 2
    if m < 2:
        return masked
    t, ok = kmers(codes, 3).astype(np.int16), clean_windows(codes, 3)
    t = np.where(ok, t, -1 - np.arange(m) % 2)
    depth = np.zeros(n + 1, np.int32)
    older, old = np.zeros(m + 1, np.int32), np.zeros(m, np.int32)
    best = np.zeros(m)
    for d in range(1, min(window - 2, m)):
        now = old[1:] + old[:-1] - older[1 : m - d + 1] + ((t[: m - d] == t[d:]) & ok[: m - d])
        whole = clean_windows(codes, d + 3)[: m - d]
        score = np.where(whole, now / d, 0.0)
        inner = np.maximum(best[:-1], best[1:])
        perfect = np.flatnonzero(whole & (now * 10 > level * d) & (score >= inner))
        depth[perfect] += 1
        np.add.at(depth, perfect + d + 3, -1)
        best = np.maximum(inner, score)
        older, old = old, now
    return np.cumsum(depth[:n]) > 0


def mask(seqs: list[str], window: int = 64, level: int = 20, replace: str | None = None) -> list[str]:
    """Masked letters in lower case, or replaced by one letter."""
    if not seqs:
        return []
    codes, ends = joined(seqs)
    hit = low_complexity(codes, window, level)
    raw = np.frombuffer(("\n".join(seqs) + "\n").encode("latin-1", "replace"), np.uint8).copy()
    clean = DNA_CODE[raw] < 4
    raw[clean] &= 0xDF
    if replace is None:
        raw[hit] |= 0x20
    else:
        raw[hit] = ord(replace)
    return [raw[a : b - 1].tobytes().decode("latin-1") for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def mask_low_complexity(df: DataFrame, seq: str = "seq", window: int = 64, level: int = 20, replace: str | None = None) -> DataFrame:
    """The same rows with ``seq`` masked; null stays null."""
    from cladeworks.functions.kmers import chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(seq)
            texts = b.column(i).to_pylist()
            out: list[str] = []
            for _, part in chunks([t or "" for t in texts]):
                out += mask(part, window, level, replace)
            column = pa.array([None if t is None else o for t, o in zip(texts, out)], pa.string())
            yield pa.RecordBatch.from_arrays([column if j == i else c for j, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)
