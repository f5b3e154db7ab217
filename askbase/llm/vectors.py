"""Vector columns in tasks: which rows take part, and their values as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def usual_length(df: DataFrame, col: str = "embedding") -> int:
    """The most frequent vector length (the longer one of equals), 0 without vectors."""
    n = F.size(col)
    top = df.filter(F.col(col).isNotNull() & (n > 0)).groupBy(n.alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    top = top.orderBy(F.desc("rows"), F.desc("d")).first()
    return top["d"] if top else 0


def is_double(df: DataFrame, col: str = "embedding") -> bool:
    return df.schema[col].dataType.elementType.typeName() != "float"


def finite_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float64 values of the vectors that have ``dims`` entries, none null or non-finite."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    at = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), dims)
    good = np.isfinite(x).all(axis=1)      # a null entry reads as NaN
    return at[good], x[good]
