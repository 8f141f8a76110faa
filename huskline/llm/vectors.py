"""What operators 8 and 10 share: usable vectors, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one block: bounds what a task compares at once.
BLOCK = 2048


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rows_of(table: DataFrame) -> DataFrame:
    """vec_id and embedding of usable rows, each once."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if len(flat) == len(column) * width and (sizes == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(column), width), kind)
    for i, (start, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        out[i, :n] = flat[start : start + n]
    return out


def listed(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(1, rows.shape[1])).astype(np.int32), rows.ravel())


def bounded_sample(vectors: DataFrame, bound: int, total: int) -> DataFrame:
    """About `bound` of `total` rows, chosen by the hash of the vector."""
    share = min(1.0, bound / max(1, total))
    return vectors if share == 1 else vectors.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < int(share * 1_000_000))
