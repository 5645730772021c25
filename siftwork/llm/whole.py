"""Vectors as whole numbers, and exact squared distances between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
#: Components beyond this count as this, so that squared distances of 64 of them fit a long.
LIMIT = 1 << 27


def finite(v: Column) -> Column:
    """Whether an array is there and has neither nulls nor non-finite numbers."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows whose vector has only finite numbers; q is floor(scale * x) of every component x as double, within LIMIT."""
    v, most = F.col("v"), F.lit(float(LIMIT))
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    q = F.transform(v, lambda x: F.floor(F.greatest(-most, F.least(most, x * F.lit(float(scale))))).cast("int"))
    return read.where(finite(v)).select("vec_id", "label", q.alias("q"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow column of lists of `width` whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, exact: in double precision where all sums stay below 2**53, else in longs."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * most * most * max(1, a.shape[1]) < 1 << 53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return d.astype(np.int64)
