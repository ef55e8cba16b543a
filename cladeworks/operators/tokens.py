"""Minimizer token runs of reads: one row per run of equal consecutive tokens.

Reads: ``read_id, mate, seq`` (mate 0, or 1 and 2 for pairs). Runs: ``read_id, mate, frame, run, minimizer, n,
is_lookup``; minimizer is null for ambiguous tokens. A run is a look-up if its minimizer differs from the
last unambiguous one of the same mate and frame. Runs, not letters, leave the scan: about a third of a row
per letter at k=35, l=31.

Defined cases: a null or too short sequence has no runs; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.functions.kmers import Scheme, chunks
from cladeworks.functions.translate import six_frames


#: Longer sequences are cut into pieces of this many letters, each with the letters before it that its tokens see.
PIECE = 1 << 20


def pieces(seqs: list[str], k: int, limit: int | None = None) -> tuple[list[str], np.ndarray]:
    """Pieces that together have the tokens of the sequences, and the sequence of each.

    A piece begins k letters early. Its first token is then the last of the piece before: of no consequence for
    sets of minimizers; ``sequence_runs`` drops it.
    """
    limit = limit or PIECE
    out, rows = [], []
    for i, s in enumerate(seqs):
        cuts = range(0, len(s), limit) if len(s) > limit + k else (0,)
        for at in cuts:
            out.append(s[max(0, at - k) : at + limit] if len(cuts) > 1 else s)
            rows.append(i)
    return out, np.array(rows, np.int64)


def sequence_runs(seqs: list[str], scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, minimizer, ambiguous, tokens, is_lookup) of the runs of equal tokens, in order."""
    texts, rows = pieces(seqs, scheme.k)
    parts = []
    for first, part in chunks(texts):
        owner, m, amb = scheme.tokens(part)
        if not len(owner):
            continue
        of = rows[first + owner]
        piece = first + owner
        # the first token of a later piece of a sequence is known already
        later = np.r_[False, rows[1:] == rows[:-1]][piece]
        keep = ~(later & np.r_[True, piece[1:] != piece[:-1]])
        of, m, amb = of[keep], np.where(amb, 0, m)[keep], amb[keep]
        if len(of):
            parts.append((of, m, amb, *_counted(of, m, amb)))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none.astype(bool), none, none.astype(bool)
    of, m, amb, n = (np.concatenate(x) for x in zip(*[(o[at], m[at], a[at], n) for o, m, a, at, n in parts]))
    at, _ = _counted(of, m, amb)  # runs that go on in the next piece
    n = np.add.reduceat(n, at)
    of, m, amb = of[at], m[at], amb[at]
    lookup = ~amb
    # compare with the last unambiguous run of the sequence
    clear = np.flatnonzero(~amb)
    if len(clear) > 1:
        same = (of[clear[1:]] == of[clear[:-1]]) & (m[clear[1:]] == m[clear[:-1]])
        lookup[clear[1:][same]] = False
    return of, m, amb, n, lookup


def _counted(of: np.ndarray, m: np.ndarray, amb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first element, length) of the runs of equal elements of one sequence."""
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (amb[1:] != amb[:-1]) | (m[1:] != m[:-1])])
    return first, np.diff(np.r_[first, len(of)])


def frames_of(seqs: list[str], translated: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sequences to scan, row of each, frame of each)."""
    if not translated:
        return seqs, np.arange(len(seqs)), np.zeros(len(seqs), np.int64)
    return [f for s in seqs for f in six_frames(s)], np.repeat(np.arange(len(seqs)), 6), np.tile(np.arange(6), len(seqs))


def token_runs(reads: DataFrame, scheme: Scheme, translated: bool = False) -> DataFrame:
    source = reads.select("read_id", "mate", "seq").where("seq IS NOT NULL")
    kind = source.schema["read_id"].dataType.simpleString()
    names = ["read_id", "mate", "frame", "run", "minimizer", "n", "is_lookup"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in chunks(b.column(2).to_pylist()):
                seqs, row, frame = frames_of(part, translated)
                o, m, amb, n, lookup = sequence_runs(seqs, scheme)
                if not len(o):
                    continue
                start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                number = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
                rows = pa.array(first + row[o])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(frame[o].astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(m.view(np.int64), mask=amb), pa.array(n.astype(np.int32)), pa.array(lookup)], names
                )

    return source.mapInArrow(run, f"read_id {kind}, mate int, frame int, run int, minimizer bigint, n int, is_lookup boolean")


def lookup_counts(reads: DataFrame, scheme: Scheme, translated: bool = False) -> DataFrame:
    """``minimizer, n``: how often each minimizer is looked up (the runs of ``token_runs`` with is_lookup).

    Combined per chunk in the scan and per task before the shuffle, so that carries no row per look-up.
    """
    source = reads.select("seq").where("seq IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in chunks(b.column(0).to_pylist()):
                _, m, _, _, lookup = sequence_runs(frames_of(part, translated)[0], scheme)
                m, n = np.unique(m[lookup], return_counts=True)
                if len(m):
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n.astype(np.int64))], ["minimizer", "n"])

    return source.mapInArrow(run, "minimizer bigint, n bigint").groupBy("minimizer").agg(F.sum("n").alias("n"))


def distinct_minimizers(df: DataFrame, key: str, seq: str, scheme: Scheme) -> DataFrame:
    """``key, minimizer``: the unambiguous minimizers of each row, distinct per row (of a very long one, per piece)."""
    source = df.select(F.col(key).alias(key), F.col(seq).alias("_s")).where("_s IS NOT NULL")
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = pieces(b.column(1).to_pylist(), scheme.k)
            for first, part in chunks(texts):
                owner, m, amb = scheme.tokens(part)
                owner, m = _distinct(rows[first + owner], m, amb)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(m.view(np.int64))], [key, "minimizer"])

    return source.mapInArrow(run, f"`{key}` {kind}, minimizer bigint")


def _distinct(owner: np.ndarray, m: np.ndarray, amb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sequence, minimizer) pairs; repeats next to each other go before the sort."""
    keep = ~amb
    keep[1:] &= (owner[1:] != owner[:-1]) | (m[1:] != m[:-1]) | amb[:-1]
    owner, m = owner[keep], m[keep]
    order = np.lexsort((m, owner))
    owner, m = owner[order], m[order]
    new = np.ones(len(m), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (m[1:] != m[:-1])
    return owner[new], np.ascontiguousarray(m[new])


def minimizer_ends(df: DataFrame, number: str, seq: str, scheme: Scheme) -> DataFrame:
    """``minimizer, lo, hi``: least and greatest ``number`` (INT) of the rows that hold each minimizer.

    Combined per chunk in the scan, so the shuffle carries a minimizer once per chunk, and then per key.
    """
    source = df.select(F.col(number).cast("int").alias("_n"), F.col(seq).alias("_s")).where("_s IS NOT NULL AND _n IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = pieces(b.column(1).to_pylist(), scheme.k)
            numbers = b.column(0).to_numpy()[rows]
            for first, part in chunks(texts):
                owner, m, amb = scheme.tokens(part)
                keep = ~amb
                keep[1:] &= (owner[1:] != owner[:-1]) | (m[1:] != m[:-1]) | amb[:-1]
                m, n = m[keep], numbers[first + owner[keep]]
                if not len(m):
                    continue
                order = np.argsort(m, kind="stable")
                m, n = m[order], n[order]
                at = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(m[at].view(np.int64)), pa.array(np.minimum.reduceat(n, at)), pa.array(np.maximum.reduceat(n, at))], ["minimizer", "lo", "hi"])

    ends = source.mapInArrow(run, "minimizer bigint, lo int, hi int")
    return ends.groupBy("minimizer").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
