"""Vectors as rows of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, vec binary) of the rows that can be compared; vectors keep their own precision, 4 or 8 bytes a number.

    Rows without a key, and vectors that are null, empty, zero or hold null or non-finite numbers, are left out.
    """
    single = "float" in df.schema[vector].dataType.simpleString()
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = np.asarray(lists.offsets)
            numbers = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            valid = ~np.asarray(lists.is_null()) & ~np.asarray(ids.is_null())
            size = np.diff(offsets)
            keep = [
                i for i in np.flatnonzero(valid & (size > 0))
                if np.isfinite(v := numbers[offsets[i]: offsets[i + 1]]).all() and v.any()
            ]
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(keep, pa.int64())).cast(pa.int64()), pa.array(size[keep], pa.int32()),
                pa.array([numbers[offsets[i]: offsets[i + 1]].tobytes() for i in keep], pa.binary()),
            ], names=["id", "dim", "vec"])

    return df.select(F.col(key), F.col(vector)).mapInArrow(run, "id bigint, dim int, vec binary")


def matrix(raw: list[bytes] | pa.Array, dim: int) -> np.ndarray:
    """Rows of bytes as a matrix in double precision."""
    raw = raw.to_pylist() if isinstance(raw, (pa.Array, pa.ChunkedArray)) else raw
    if not raw:
        return np.zeros((0, dim))
    kind = np.float32 if len(raw[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), dim).astype(np.float64)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest number first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
