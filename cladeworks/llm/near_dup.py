"""Near-duplicate records by an LSH forest, verified exactly.

Records are sets of shingles; a pair is a link if intersection / union >= ``threshold``. Equal texts are one
class and are compared once. Every class has a signature of min-hashes; a tree of the forest is one order of
the signature's columns, in which the classes are sorted. Candidates are the neighbours whose longest common
prefix reaches the tree's first depth; the classes that share it are a region.

How deep a region is searched adapts to it, without separating pairs. A pair is worth an exact check if
``AGREE`` of the ``SIG`` signature bytes after the prefix agree. Small regions, and those where many pairs agree, are
compared as a whole. In a large region of mostly unlike classes (sampled, ``_hits``) the bytes are sorted again
in ``ORDERS`` further orders and only neighbours with a common prefix of ``DEEPER`` bytes are compared. The orders
cover every way in which AGREE bytes can agree (by the pigeonhole principle), so both ways find the same pairs.
Regions of more than ``BLOCK`` classes whose pairs do agree are cut into blocks, and the pairs of blocks are
dealt to all tasks.

With trees of first depth d the chance to share a region at similarity s is 1 - (1 - s**d)**trees: at 0.6 it is
0.99998 for sequences (24 trees, depth 2) and 0.99999 for headers (48 trees, depth 3), more above. It does not
depend on the number of rows.

Classes are told apart by 128 bits of hash: where 64 of them clash, the class is named by the other 64.
Candidates are verified from their texts' shingles. A text does not travel with every pair: pairs are gathered in
cells of at most about 2 * ``FAMILY`` classes (classes of one home, the least neighbour), and a cell gets each of
its texts once.

Defined cases: null texts are left out; texts without any shingle are in no pair; equal texts with a shingle
are pairs of similarity 1; empty tables give no rows; ids are expected to be distinct (a repeated id would
pair with itself and is left out); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.functions.kmers import clean_windows, joined, kmers
from cladeworks.llm.buckets import MOST_PARTITIONS, SCHEMA, by_bucket, layout, per_bucket
from cladeworks.llm.words import CHUNK, chunks, mix
from cladeworks.session import Scratch

SIG = 24
#: Regions of more classes are compared in tiles of TILE x TILE pairs, smaller ones many at once.
DENSE = 128
TILE = 1024
#: Regions of more classes are cut into blocks and every pair of blocks is a record of its own, dealt to all tasks.
BLOCK = 16_384
PIECE = 512
BLOCK_BYTES = 16 << 20
#: Signature bytes that must agree (of SIG); a pair of similarity 0.6 has fewer with chance 0.002 per tree.
AGREE = 8
#: Of AGREE bytes, DEEPER fall into one of these parts of the signature: AGREE > PARTS * (DEEPER - 1).
PARTS, DEEPER = 3, 3
ORDERS = [c for g in range(PARTS) for c in combinations(range(g * SIG // PARTS, (g + 1) * SIG // PARTS), DEEPER)]
#: Regions up to this size are compared as a whole at once; pairs sampled of larger ones.
SAMPLED, SAMPLE = 2048, 4096
#: Classes of one home per cell of the exact check.
FAMILY = 256
MAX_ROUNDS = 60
#: Classes named by candidates are broadcast up to this number (16 bytes each), else joined by a shuffle.
BROADCAST_CLASSES = 500_000
ENTRY = np.dtype([("key", "<u8"), ("cls", "<i8"), ("sig", "V24")])


class Kind(NamedTuple):
    """How texts of one field are shingled and hashed."""

    name: str
    trees: int
    depth: int
    has_shingle: str  #: SQL condition on the column "text"
    normal: str  #: SQL expression of the text that decides equality


SEQ = Kind("seq", 24, 2, "text rlike '(?i)[ACGT]{16}'", "upper(text)")
HEADER = Kind("header", 48, 3, "length(text) >= 5", "lower(text)")
TEXT_K, SEQ_K = 5, 16


def seq_shingles(seq: str) -> np.ndarray:
    codes, _ = joined([seq])
    clean = clean_windows(codes, SEQ_K)
    return np.unique(kmers(codes, SEQ_K)[clean]) if clean.any() else np.empty(0, np.uint64)


def text_shingles(text: str) -> set[str]:
    t = text.lower()
    return {t[i : i + TEXT_K] for i in range(len(t) - TEXT_K + 1)}


def _densify(table: np.ndarray, empty: int) -> None:
    """Fill the empty bins of one-permutation signatures from other bins, the same way for every record."""
    n, m = table.shape
    rows = np.flatnonzero((table == empty).any(axis=1) & (table != empty).any(axis=1))
    if not len(rows):
        return
    t = table[rows]
    hole = t == empty
    source = t.copy()
    step = 0
    while hole.any() and step < 64 * m:
        step += 1
        probe = mix(np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) % np.uint64(m)
        offer = source[:, probe.astype(np.int64)]
        take = hole & (offer != empty)
        t[take] = mix(offer[take] + np.uint64(step))
        hole &= ~take
    table[rows] = t


def _short_pieces(seqs: list[str]) -> tuple[list[str], np.ndarray]:
    """Very long sequences in pieces that share SEQ_K - 1 letters, and the row of each piece."""
    pieces, rows = [], []
    for i, s in enumerate(seqs):
        for at in range(0, max(1, len(s) - SEQ_K + 1), CHUNK):
            pieces.append(s[at : at + CHUNK + SEQ_K - 1] if len(s) > CHUNK else s)
            rows.append(i)
            if len(s) <= CHUNK:
                break
    return pieces, np.array(rows, np.int64)


def seq_signatures(seqs: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation min-hash signatures, and whether a sequence has a shingle."""
    empty = np.iinfo(np.uint64).max
    table = np.full((len(seqs), m), empty, np.uint64)
    flat = table.reshape(-1)
    pieces, rows = _short_pieces(seqs)
    for first, part in chunks(pieces):
        codes, ends = joined(part)
        at = np.flatnonzero(clean_windows(codes, SEQ_K))
        if len(at):
            h = mix(kmers(codes, SEQ_K)[at])
            owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, np.searchsorted(at, ends)]))
            slot = rows[first + owner] * m + (h % np.uint64(m)).astype(np.int64)
            np.minimum.at(flat, slot, h // np.uint64(m))
    some = (table != empty).any(axis=1)
    _densify(table, empty)
    return table, some


def text_signatures(texts: list[str], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Min-hash signatures over m multiply hashes, and whether a text has a shingle."""
    factors = mix(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
    table = np.full((len(texts), m), np.iinfo(np.uint64).max, np.uint64)
    some = np.zeros(len(texts), bool)
    for first, part in chunks(texts, 1 << 16):
        low = [t.lower() for t in part]
        points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lens = np.array([len(t) for t in low])
        starts = np.cumsum(lens) - lens
        owned = np.maximum(lens - TEXT_K + 1, 0)
        has = owned > 0
        if not has.any():
            continue
        at = np.repeat(starts, owned) + (np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned))
        h = np.zeros(len(at), np.uint64)
        for j in range(TEXT_K):
            h = h * np.uint64(0x100000001B3) + points[at + j]
        h = mix(h)
        edges = (np.cumsum(owned) - owned)[has]
        rows = first + np.flatnonzero(has)
        some[rows] = True
        for j in range(m):
            x = h * factors[j]
            x ^= x >> np.uint64(29)
            table[rows, j] = np.minimum.reduceat(x, edges)
    return table, some


def entries(cls: np.ndarray, table: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, records) of every tree: the key stands for the first columns, the bytes for the columns after them."""
    m = table.shape[1]
    low = (mix(table) & np.uint64(255)).astype(np.uint8)
    salt = np.uint64(sum(map(ord, kind.name)))
    for t in range(kind.trees):
        cols = [(t * kind.depth + i) % m for i in range(kind.depth + SIG)]
        key = mix(np.full(len(cls), np.uint64(t) + salt * np.uint64(1000), np.uint64))
        for c in cols[: kind.depth]:
            key = mix(key + table[:, c])
        rec = np.empty(len(cls), ENTRY)
        rec["key"], rec["cls"] = key, cls
        rec["sig"] = np.ascontiguousarray(low[:, cols[kind.depth :]]).view("V24").reshape(-1)
        yield key, rec


def _signed(df: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    make = seq_signatures if kind.name == "seq" else text_signatures

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = b.column(0).to_numpy()
            _, one = np.unique(cls, return_index=True)
            texts = b.column(1).take(pa.array(one)).to_pylist()
            if not texts:
                continue
            table, some = make(texts, kind.trees * kind.depth)
            keys, records = zip(*entries(cls[one][some], table[some], kind))
            yield by_bucket(np.concatenate(keys), np.concatenate(records), buckets)

    return df.select("cls", "text").mapInArrow(run, SCHEMA)


def _tile_pairs(left: np.ndarray, right: np.ndarray | None, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one region with ``agree`` equal signature bytes, tile by tile: of left with right, or of
    left with itself."""
    same = right is None
    right = left if same else right
    x, y = (np.ascontiguousarray(np.ascontiguousarray(e["sig"]).view(np.uint8).reshape(-1, SIG).T) for e in (left, right))
    for i in range(0, len(left), TILE):
        for j in range(i if same else 0, len(right), TILE):
            p, q = x[:, i : i + TILE], y[:, j : j + TILE]
            n = np.zeros((p.shape[1], q.shape[1]), np.uint8)
            for k in range(SIG):
                n += p[k][:, None] == q[k][None, :]
            u, v = np.nonzero(n >= agree)
            if same and i == j:
                u, v = u[u < v], v[u < v]
            a, b = left["cls"][i + u], right["cls"][j + v]
            yield np.minimum(a, b), np.maximum(a, b)


def _bytes(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries["sig"]).view(np.uint8).reshape(-1, SIG)


def _close_pairs(region: np.ndarray, cls: np.ndarray, sig: np.ndarray, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many small regions at once."""
    step = 1
    at = np.arange(len(region))
    while len(at):
        at = at[at + step < len(region)]
        at = at[region[at] == region[at + step]]
        for part in np.array_split(at, max(1, len(at) // 200_000)):
            same = (sig[part] == sig[part + step]).sum(axis=1) >= agree
            yield cls[part[same]], cls[part[same] + step]
        step += 1


def _hits(sig: np.ndarray) -> tuple[float, float]:
    """(ORDERS in which a random pair of the region's classes are neighbours, on average; share of pairs that agree)."""
    n = len(sig)
    at = mix(np.arange(2 * SAMPLE, dtype=np.uint64) + np.uint64(n)) % np.uint64(n)
    same = sig[at[:SAMPLE].astype(np.int64)] == sig[at[SAMPLE:].astype(np.int64)]
    per_part = same.reshape(SAMPLE, PARTS, SIG // PARTS).sum(axis=2)
    ways = np.array([math.comb(k, DEEPER) for k in range(SIG // PARTS + 1)])
    return float(ways[per_part].sum(axis=1).mean()), float((same.sum(axis=1) >= AGREE).mean())


def _deeper_pairs(part: np.ndarray, sig: np.ndarray, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a region's entries by their neighbours in the further orders."""
    for cols in ORDERS:
        prefix = sig[:, cols[0]].astype(np.int64)
        for c in cols[1:]:
            prefix = prefix << 8 | sig[:, c]
        order = np.argsort(prefix, kind="stable")
        for a, b in _close_pairs(prefix[order], part["cls"][order], sig[order], agree):
            yield np.minimum(a, b), np.maximum(a, b)


def _deepen(n: int, sig: np.ndarray) -> bool:
    """Whether the further orders cost less than comparing the region as a whole: comparisons of single pairs are
    some 20 times dearer than in tiles, and a sort is about a hundred per class and order."""
    return n > SAMPLED and len(ORDERS) * n * 100 + _hits(sig)[0] * n * n * 10 < n * n / 2


def candidates(data: np.ndarray, dense: int = DENSE, agree: int = AGREE, block: int | None = None, over: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (smaller class, larger class) of the regions in one bucket's entries: all pairs of a region
    with ``agree`` equal bytes, whatever its size. A pair met in several regions comes several times. Regions of
    more than ``block`` classes that are not worth further orders are put into ``over`` instead."""
    data = data[np.lexsort((data["cls"], data["key"]))]
    # a class met in several tasks is there several times with equal bytes
    data = data[np.r_[True, (data["key"][1:] != data["key"][:-1]) | (data["cls"][1:] != data["cls"][:-1])]]
    key = data["key"]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[starts, len(key)])
    size = np.repeat(n, n)
    small = data[(size > 1) & (size <= dense)]
    yield from _close_pairs(small["key"], small["cls"], _bytes(small), agree)
    for first, many in zip(starts[n > dense].tolist(), n[n > dense].tolist()):
        part = data[first : first + many]
        if agree >= AGREE and _deepen(many, sig := _bytes(part)):
            yield from _deeper_pairs(part, sig, agree)
        elif block is not None and many > block:
            over.append(part)
        else:
            yield from _tile_pairs(part, None, agree)


def region_pairs(data: np.ndarray, dense: int = DENSE, agree: int = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct candidate pairs of one bucket's entries."""
    none = np.empty(0, np.int64)
    parts = [(none, none), *candidates(data, dense, agree)]
    a, b = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    return a[new], b[new]


FOUND = "a bigint, b bigint, region bigint, block int, blocks int, data binary"


def _pairs(block: int, dense: int):
    """Per bucket: its pairs, and the regions of more than ``block`` classes in pieces of blocks."""

    def run(_: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        over: list[np.ndarray] = []
        for a, b in candidates(np.frombuffer(b"".join(held), ENTRY), dense, AGREE, block, over):
            if len(a):
                none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], ["a", "b", "region", "block", "blocks", "data"])
        for part in over:
            region, blocks = int(part["key"][:1].view("<i8")[0]), -(-len(part) // block)
            for i in range(blocks):
                own = part[i * block : (i + 1) * block]
                cut = [own[j : j + PIECE].tobytes() for j in range(0, len(own), PIECE)]
                none = pa.nulls(len(cut), pa.int64())
                same = [pa.array([x] * len(cut), t) for x, t in ((region, pa.int64()), (i, pa.int32()), (blocks, pa.int32()))]
                yield pa.RecordBatch.from_arrays([none, none, *same, pa.array(cut, pa.binary())], ["a", "b", "region", "block", "blocks", "data"])

    return run


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the blocks ``lo`` and ``hi`` of a region, from rows sorted by region, lo and hi."""

    def compare(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        left, *right = (np.frombuffer(b"".join(held[i]), ENTRY) for i in sorted(held))
        for a, b in _tile_pairs(left, right[0] if right else None, AGREE):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    now, held = None, {}
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for i, (region, lo, hi, block) in enumerate(keys):
            if (region, lo, hi) != now:
                if held:
                    yield from compare(held)
                now, held = (region, lo, hi), {}
            held.setdefault(block, []).append(batch.column(4)[i].as_py())
    if held:
        yield from compare(held)


def _all_found(stage: DataFrame, partitions: int) -> DataFrame:
    """Pairs a, b of the buckets and of the regions in blocks."""
    pairs = stage.where("data IS NULL").select("a", "b")
    pieces = stage.where("data IS NOT NULL")
    size = pieces.agg(F.sum(F.length("data").cast("bigint") * F.col("blocks"))).first()[0]
    if size:
        both = pieces.select("region", "block", "data", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        both = both.select("region", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "data")
        most = max(partitions, min(MOST_PARTITIONS, size // BLOCK_BYTES))
        sorted_ = both.repartition(most, "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")
        pairs = pairs.unionByName(sorted_.mapInArrow(_cross, "a bigint, b bigint"))
    return pairs.distinct()


def _similarity(kind: Kind):
    """Similarity of the pairs of each cell; rows ``cell, a, b, text`` sorted by cell, texts (b null) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, sets, room = None, {}, {}, 0

        def shingles(c: int):
            nonlocal room
            if c not in sets:
                sets[c] = seq_shingles(texts[c]) if kind.name == "seq" else text_shingles(texts[c])
                room += len(texts[c])
                while room > 4 * CHUNK and len(sets) > 2:
                    room -= len(texts[first := next(iter(sets))])
                    del sets[first]
            return sets[c]

        for batch in batches:
            out = []
            cells, a_, b_ = (batch.column(i).to_pylist() for i in range(3))
            for i, (cell, a, b) in enumerate(zip(cells, a_, b_)):
                if cell != now:
                    now, texts, sets, room = cell, {}, {}, 0
                if b is None:
                    texts[a] = batch.column(3)[i].as_py()
                    continue
                p, q = shingles(a), shingles(b)
                both = len(np.intersect1d(p, q, assume_unique=True)) if kind.name == "seq" else len(p & q)
                union = len(p) + len(q) - both
                out.append((a, b, both / union if union else 0.0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return run


def _cells(found: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b, cell``: pairs of classes of the same two homes (the least neighbour) and family blocks share a cell."""
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("home"))
    home = scratch.write(home, "homes")
    blocks = home.groupBy("home").agg(F.ceil(F.count("*") / FAMILY).alias("blocks"))
    place = home.join(blocks, "home").select("cls", F.xxhash64("home", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("place"))
    x, y = place.toDF("a", "x"), place.toDF("b", "y")
    return scratch.write(found.join(x, "a").join(y, "b").select("a", "b", F.xxhash64("x", "y").alias("cell")), "cells")


def _classes(df: DataFrame, key: str, text: Column | str, kind: Kind, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows ``id, text, cls``; members ``id, cls, in_pairs``; ``cls, id`` of each class' first record)."""
    rows = df.select(F.col(key).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    normal = F.expr(kind.normal)
    rows = rows.withColumn("cls", F.xxhash64(normal)).withColumn("other", F.xxhash64(F.lit(1), normal))
    members = scratch.write(rows.select("id", "cls", "other", F.expr(kind.has_shingle).alias("in_pairs")), "members")
    first = scratch.write(members.groupBy("cls").agg(F.min("id").alias("id"), F.min("other").alias("lo"), F.max("other").alias("hi")), "first")
    clash = first.where("lo <> hi")
    if clash.limit(1).count():
        # texts that differ under one hash: all but those of the least other hash are named anew

        def renamed(df: DataFrame) -> DataFrame:
            j = df.join(clash.select("cls", "lo"), "cls", "left")
            return j.withColumn("cls", F.when(F.col("lo").isNull() | (F.col("lo") == F.col("other")), F.col("cls")).otherwise(F.xxhash64("cls", "other"))).drop("lo")

        rows, members = renamed(rows), scratch.write(renamed(members), "members")
        first = scratch.write(members.groupBy("cls").agg(F.min("id").alias("id")), "first")
    return rows.select("id", "cls", "text"), members.select("id", "cls", "in_pairs"), first.select("cls", "id")


def near_duplicates(df: DataFrame, key: str, text: Column | str, kind: Kind, threshold: float = 0.6, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, members): links ``a, b, similarity`` between classes of equal text, and ``id, cls, in_pairs`` of
    every record; ``in_pairs`` is false for texts without a shingle."""
    scratch = Scratch(df.sparkSession)
    rows, members, first = _classes(df, key, text, kind, scratch)
    partitions, buckets = layout(rows)
    signed = _signed(rows, kind, buckets)
    stage = scratch.write(per_bucket(signed, _pairs(block, min(DENSE, block)), FOUND, partitions), "regions")
    found = scratch.write(_all_found(stage, partitions), "pairs")
    scratch.drop(stage)

    cells = _cells(found, scratch)
    wanted = cells.select("cell", F.col("a").alias("cls")).union(cells.select("cell", F.col("b").alias("cls"))).distinct()
    named = scratch.write(wanted.select("cls").distinct().join(first, "cls"), "named")
    # the classes' first records are picked from the source; only their texts are shuffled
    small = named.count() <= BROADCAST_CLASSES
    texts = rows.select("id", "text").join(F.broadcast(named) if small else named, "id").select("cls", "text")
    none = F.lit(None).cast("bigint")
    read = wanted.join(texts, "cls").select("cell", F.col("cls").alias("a"), none.alias("b"), "text")
    both = read.unionByName(cells.select("cell", "a", "b", F.lit(None).cast("string").alias("text")))
    sorted_ = both.repartition(partitions, "cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first(), "a")
    links = sorted_.mapInArrow(_similarity(kind), "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold)
    links = scratch.write(links, "links")
    scratch.drop(found, cells, named, first)
    return links, members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of records ``id_a < id_b``, copies expanded: as many rows as the problem's definition has."""
    m = members.where("in_pairs").select("id", "cls")
    x, y = m.select(F.col("id").alias("p"), F.col("cls").alias("a")), m.select(F.col("id").alias("q"), F.col("cls").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    within = x.join(y.withColumnRenamed("b", "a"), "a").where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    return across.unionByName(within).where("id_a < id_b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``cls, component`` of every linked class: the least class of its connected component.

    Alternating large-star and small-star steps on edge tables in the shared folder; every step is a min per
    node (partially aggregated) and a join, so no task gathers a node's neighbours.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined_ = large.join(least, "u")
        small = joined_.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined_.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.write(small, "edges")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(edges)
        edges = new
        if last == state:
            break
        last = state
    else:
        raise RuntimeError(f"components did not come to rest in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("cls"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("cls"), F.col("v").alias("component"))).distinct()


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``id, class_id, group_id, n_links``; ids of classes and groups are least record ids."""
    scratch = Scratch(links.sparkSession)
    comp = components(links, scratch)
    label = members.groupBy("cls").agg(F.min("id").alias("class_id"))
    n = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    classes = scratch.write(label.join(comp, "cls", "left").join(n, "cls", "left").select("cls", "class_id", F.coalesce("component", "cls").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    lead = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return members.select("id", "cls").join(classes.join(lead, "component").drop("component"), "cls").select("id", "class_id", "group_id", "n_links")
