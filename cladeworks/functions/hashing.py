"""The 64-bit finaliser of MurmurHash3 and filters on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_LOW = 1 << 64


def fmix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def with_hash(df: DataFrame, column: str, name: str = "hash") -> DataFrame:
    """Append the hash of a BIGINT column as BIGINT (the same 64 bits); null stays null."""
    schema = StructType([*df.schema.fields, StructField(name, LongType())])

    def run(batches):
        for b in batches:
            x = b.column(column).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            h = pa.array(fmix64(x).view(np.int64), mask=np.asarray(b.column(column).is_null()))
            yield pa.RecordBatch.from_arrays([*b.columns, h], schema=pa.schema([*b.schema, pa.field(name, pa.int64())]))

    return df.mapInArrow(run, schema)


def unsigned_at_least(h: Column | str, threshold: int) -> Column:
    """h >= threshold with both read as unsigned 64-bit numbers."""
    h = F.col(h) if isinstance(h, str) else h
    sign = -(1 << 63)
    t = ((threshold % _LOW) ^ (1 << 63)) % _LOW
    t = t - _LOW if t >= 1 << 63 else t
    return h.bitwiseXOR(F.lit(sign).cast("bigint")) >= F.lit(t).cast("bigint")


def clear_hash_threshold(estimated: int, capacity: int) -> int:
    """Least hash kept so that about ``capacity`` of ``estimated`` keys remain."""
    return 0 if estimated <= capacity else min(_LOW - 1, int((1.0 - capacity / estimated) * _LOW))
