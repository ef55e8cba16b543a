"""Shuffling numpy records: many fixed-size records per row, as one binary value per hash bucket.

A mapper turns each chunk of its input into one row per bucket; a reducer sees the buckets of its partition one
after another and holds one of them at a time. There are ``PER_PARTITION`` buckets per ``BYTES`` of the source's
files, and a partition holds ``PER_PARTITION`` of them, at least as many partitions as the session's
``spark.sql.shuffle.partitions``. Beyond ``MOST_PARTITIONS`` a partition holds more buckets, so a bucket's size
does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.session import reduce_partitions

PER_PARTITION = 8
BYTES = 32 << 20
MOST_PARTITIONS = 50_000
UNKNOWN = 1 << 50
SCHEMA = "bucket int, data binary"


class Layout(NamedTuple):
    partitions: int
    buckets: int


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by the planner, which reads no data.

    The planner's guess for a projection prices every string at 20 bytes, so its leaves are asked. Leaves of
    unknown size (rows in memory) count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def layout(df: DataFrame) -> Layout:
    """Reduce partitions and buckets for a shuffle of ``df``."""
    least, wanted = reduce_partitions(df.sparkSession), -(-source_bytes(df) // BYTES)
    partitions = max(least, min(MOST_PARTITIONS, wanted))
    return Layout(partitions, PER_PARTITION * max(partitions, wanted))


def by_bucket(keys: np.ndarray, records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket with the records whose key (uint64, well mixed) falls in it."""
    at = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    data = np.ascontiguousarray(records[order]).view(np.uint8).reshape(-1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    offsets = (np.r_[first, len(at)] * records.dtype.itemsize).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), blob], ["bucket", "data"])


def per_bucket(df: DataFrame, work: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str, partitions: int) -> DataFrame:
    """Run ``work(bucket, byte strings)`` on every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            ids, data = b.column(0).to_numpy(), b.column(1)
            for i, bucket in enumerate(ids.tolist()):
                if bucket != now:
                    if held:
                        yield from work(now, held)
                    now, held = bucket, []
                held.append(data[i].as_py())
        if held:
            yield from work(now, held)

    # buckets are dealt out evenly, not by another hash
    return df.repartitionById(partitions, F.pmod("bucket", F.lit(partitions)).cast("int")).sortWithinPartitions("bucket").mapInArrow(run, schema)
