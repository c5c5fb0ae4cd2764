"""Array-column vector math (JVM higher-order functions, no UDFs), and Arrow lists of matrix rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector as array<double>; a zero vector is left as is.

    The length is bound as the one element of an array: inside a lambda it would
    be computed again for every number of the vector.
    """
    def scaled(n: Column) -> Column:
        return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(
            F.transform(v, lambda x: x.cast("double")))
    return F.element_at(F.transform(F.array(l2_norm(v)), scaled), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def list_array(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow list column."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(rows.ravel()))
