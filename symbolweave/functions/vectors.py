"""Vector expressions on ``array<float>`` columns, and packed float32 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(vector: Column | str) -> Column:
    squares = lambda total, x: total + x.cast("double") * x.cast("double")
    return F.sqrt(F.aggregate(vector, F.lit(0.0), squares))


def dot(left: Column, right: Column) -> Column:
    """Sum of products over the length both have."""
    shared = F.least(F.size(left), F.size(right))
    products = F.zip_with(
        F.slice(left, F.lit(1), shared),
        F.slice(right, F.lit(1), shared),
        lambda x, y: x.cast("double") * y.cast("double"),
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length.

    The product runs over the shared length, the norms over each whole vector.
    """
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(left, right) / lengths)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_floats(packed: pa.Array) -> pa.Array:
    """Packed native float32 bytes to a vector."""
    rows = [None if b is None else np.frombuffer(b, np.float32) for b in packed.to_pylist()]
    return pa.array(rows, pa.list_(pa.float32()))


@F.arrow_udf(T.BinaryType())
def pack_floats(vectors: pa.Array) -> pa.Array:
    """A vector to packed native float32 bytes."""
    rows = [None if v is None else np.asarray(v, np.float32).tobytes() for v in vectors.to_pylist()]
    return pa.array(rows, pa.binary())
