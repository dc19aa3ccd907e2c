"""Fixed-size records that numpy makes, dealt by Spark into buckets and met there, as packed arrays instead of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Records that are packed at once, and about how many one bucket of them holds.
STEP_RECORDS, BUCKET_RECORDS = 1 << 20, 1 << 17
#: Odd multipliers of the hash functions.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """One of the hash functions of 64-bit numbers, each of which tells all numbers apart."""
    h = h * MIX[k]
    h ^= h >> np.uint64(32)
    h *= MIX[k - 1]
    h ^= h >> np.uint64(29)
    return h


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data`` cut at these places into binary values."""
    offsets = (ends * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def cut(r: np.ndarray, rows: np.ndarray, key: np.ndarray, buckets: int) -> tuple[np.ndarray, pa.Array]:
    """These rows by the bucket of their keys, and their records as one binary value a bucket."""
    bucket = (mixed(key.astype(np.uint64), 3) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return rows[order], binary(r[rows[order]], np.searchsorted(bucket[order], np.arange(buckets + 1)))


def dealt(rows: DataFrame, records: Callable[[pa.RecordBatch], np.ndarray], key: str, buckets: int) -> DataFrame:
    """(bucket, records): the records of ``rows``, packed by the bucket of their ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(records(b))
            n += len(held[-1])
            if n >= STEP_RECORDS:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield packed(np.concatenate(held))

    def packed(found: np.ndarray) -> pa.RecordBatch:
        _, data = cut(found, np.arange(len(found)), found[key], buckets)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), data], names=["bucket", "records"])

    return rows.mapInArrow(run, "bucket int, records binary")


def met(dealt: DataFrame, kind: np.dtype, meet: Callable[[np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What ``meet`` makes of the records of each bucket."""

    def run(batch: pa.Table) -> pa.Table:
        return meet(np.frombuffer(b"".join(batch["records"].to_pylist()), dtype=kind))

    return dealt.groupBy("bucket").applyInArrow(run, schema)
