"""Distinct counts over huge identifier sets by k-minimum-values (KMV) sketches.

A sketch of a group is the sorted array of its k smallest distinct 64-bit hash values (little-endian
uint64 in a BINARY column). Sketches merge by keeping the k smallest of their union, so partial results
may be stored and merged later, in any order. With fewer than k values the count is exact; otherwise the
estimate is (k-1)/U with U the k-th smallest hash as a share of 2**64, relative standard error
1/sqrt(k-2), and the reported bounds are +-1.96 standard errors.

Defined cases: null identifiers are not counted (a group of nulls only has 0); null and empty group
values are groups of their own; a null timestamp gives the null day; an empty table gives no rows; repeated
rows change only ``n_rows``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1024
#: Rows gathered in a task before a partial result is emitted (bounds a task's memory).
FLUSH_ROWS = 1_000_000
#: Saturated partial sketches of a group are first merged in this many sub-groups.
SALTS = 16
Z = 1.96


def mix64(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser, the hash the sketches keep."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _k_smallest(gid: np.ndarray, h: np.ndarray, k: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distinct values per group, sorted by group; and the bounds of each group."""
    order = np.lexsort((h, gid))
    gid, h = gid[order], h[order]
    if len(h):
        new = np.empty(len(h), bool)
        new[0] = True
        np.logical_or(gid[1:] != gid[:-1], h[1:] != h[:-1], out=new[1:])
        gid, h = gid[new], h[new]
    start = np.searchsorted(gid, np.arange(groups))
    keep = np.arange(len(gid)) - start[gid] < k
    gid, h = gid[keep], h[keep]
    return h, np.searchsorted(gid, np.arange(groups + 1))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of one uint64 array as a BINARY column, without a Python loop."""
    offsets = (bounds * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All uint64 values of a BINARY column and their number per row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.to_pylist()
    counts = np.fromiter((len(p) // 8 for p in parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), "<u8"), counts


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = column.combine_chunks().dictionary_encode(null_encoding="encode")
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def grouping_sets(dims: list[str]) -> list[tuple[str, ...]]:
    """Every combination of the dimensions, all of them first, the grand total last."""
    return [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def kmv_sketches(df: DataFrame, identifier: Column | str, day: Column | str, groups: list[str], k: int = K) -> DataFrame:
    """One sketch per combination of (day, *groups): ``grouping, day, *groups, n_rows, sketch``.

    Partial sketches are made inside each scan task for every grouping set, so the shuffle carries at most
    k values per group and task; saturated partials of a hot group are merged in salted sub-groups first.
    """
    if k < 3:
        raise ValueError("k must be at least 3")
    dims = ["day", *groups]
    source = df.select(
        (F.col(identifier) if isinstance(identifier, str) else identifier).cast("bigint").alias("_id"),
        F.to_date(F.col(day) if isinstance(day, str) else day).alias("day"),
        *[F.col(g).cast("string").alias(g) for g in groups],
    )
    sets = grouping_sets(dims)
    fields = ", ".join(f"`{g}` string" for g in groups)
    schema = f"grouping string, day date, {fields}{', ' if fields else ''}n_rows bigint, sketch binary, salt int"
    names = ["grouping", *dims, "n_rows", "sketch", "salt"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SALTS
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            valid = t["_id"].is_valid().to_numpy()
            h = mix64(np.asarray(t["_id"].fill_null(0).to_numpy()).view(np.uint64))
            coded = {d: _codes(t[d]) for d in dims}
            for cols in sets:
                code = np.zeros(t.num_rows, np.int64)
                for c in cols:
                    code = code * (len(coded[c][1]) + 1) + coded[c][0]
                present, first, gid, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
                values, bounds = _k_smallest(gid[valid], h[valid], k, len(present))
                size = np.diff(bounds)
                data = {"grouping": pa.array([",".join(cols) or "all"] * len(present))}
                for d in dims:
                    taken = coded[d][1].take(pa.array(coded[d][0][first])) if d in cols else pa.nulls(len(present), t.schema.field(d).type)
                    data[d] = taken
                data |= {"n_rows": pa.array(n.astype(np.int64)), "sketch": _binary(values, bounds), "salt": pa.array(np.where(size >= k, salt, 0).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([data[x] for x in names], names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    parts = source.mapInArrow(partial, schema)
    return merge_sketches(merge_sketches(parts, ["grouping", *dims, "salt"], k), ["grouping", *dims], k)


def merge_sketches(df: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merge partial sketches with equal keys (null keys are equal): ``*keys, n_rows, sketch``.

    Rows arrive sorted by key and are merged as a stream: a task holds one Arrow batch, never a group.
    """
    kept = df.select(*keys, "n_rows", "sketch")
    schema = kept.schema
    names = [*keys, "n_rows", "sketch"]

    def fold(t: pa.Table) -> pa.Table:
        values, counts = _flat(t["sketch"])
        code = np.zeros(t.num_rows, np.int64)
        for key in keys:
            c, d = _codes(t[key])
            code = np.unique(code * (len(d) + 1) + c, return_inverse=True)[1]
        # rows are sorted: number the groups in order of appearance
        new = np.r_[True, code[1:] != code[:-1]]
        gid = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        merged, bounds = _k_smallest(np.repeat(gid, counts), values, k, len(first))
        n = np.bincount(gid, weights=t["n_rows"].to_numpy().astype(np.float64), minlength=len(first)).astype(np.int64)
        cols = [t[key].take(pa.array(first)) for key in keys] + [pa.array(n), _binary(merged, bounds)]
        return pa.table(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(names)
            if rest is not None:
                t = pa.concat_tables([rest.cast(t.schema), t])
            t = fold(t)
            yield from t.slice(0, t.num_rows - 1).combine_chunks().to_batches()
            rest = t.slice(t.num_rows - 1)
        if rest is not None:
            yield from rest.combine_chunks().to_batches()

    return kept.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def with_estimates(df: DataFrame, k: int = K) -> DataFrame:
    """Replace ``sketch`` by ``n_distinct, lower_bound, upper_bound, is_exact``."""
    # the k-th value: the last eight bytes, least significant first
    digits = F.hex(F.substring("sketch", -8, 8))
    kth = F.conv(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]), 16, 10).cast("double")
    s = df.withColumn("_s", F.struct((F.octet_length("sketch") / 8).cast("int").alias("n"), kth.alias("kth")))
    est = F.lit(float(k - 1)) * F.lit(2.0**64) / F.col("_s.kth")
    exact = F.col("_s.n") < k
    rel = Z / float(np.sqrt(k - 2))

    def value(e: Column) -> Column:
        return F.when(exact, F.col("_s.n").cast("bigint")).otherwise(F.round(e).cast("bigint"))

    return s.select(
        *[c for c in df.columns if c != "sketch"],
        value(est).alias("n_distinct"),
        value(F.greatest(F.lit(float(k)), est * F.lit(1.0 - rel))).alias("lower_bound"),
        value(est * F.lit(1.0 + rel)).alias("upper_bound"),
        exact.alias("is_exact"),
    )


def set_operations(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Union, intersection and differences of two sketch columns, each with bounds.

    Both sketches are cut at the smaller of their thresholds; the hashes below it are a uniform sample of
    the union, so the estimate of any of the four sets is its count in the sample over the threshold. Null
    sketches count as empty sets.
    """
    fields = [f"{s}{x}" for s in ("union", "intersection", "a_not_b", "b_not_a") for x in ("", "_lower", "_upper")]

    @F.pandas_udf("struct<" + ", ".join(f"{f}: bigint" for f in fields) + ">")
    def compute(left, right):
        import pandas as pd

        rows = []
        for x, y in zip(left, right):
            p, q = (np.frombuffer(v or b"", "<u8") for v in (x, y))
            full = [v[-1] for v in (p, q) if len(v) >= k]
            theta = 1.0
            if full:
                cut = min(full)
                theta = float(cut) / 2.0**64
                p, q = p[p < cut], q[q < cut]
            both = len(np.intersect1d(p, q, assume_unique=True))
            row = []
            for n in (len(p) + len(q) - both, both, len(p) - both, len(q) - both):
                se = np.sqrt(n * (1 - theta)) / theta if n else (3.0 * (1 - theta) / theta) / Z
                row += [round(n / theta), max(n, round(n / theta - Z * se)), round(n / theta + Z * se)]
            rows.append(row)
        return pd.DataFrame(rows, columns=fields)

    out = pairs.withColumn("_o", compute(F.col(a), F.col(b)))
    return out.select(*[c for c in pairs.columns if c not in (a, b)], *[F.col(f"_o.{f}").alias(f) for f in fields])
