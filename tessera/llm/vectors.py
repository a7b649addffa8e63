"""What the two vector operators share: clean vectors and packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim)


def by_dim(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches split by the length of their vectors."""
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            yield d, b.filter(pa.array(sizes == d))
