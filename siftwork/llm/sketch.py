"""A bitmap of bounded size over hashed keys, to pass over most rows that a later exact join would drop.

It never drops a row that the join keeps. Its size doesn't depend on the data: with more keys it only lets more rows pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits; the bitmap that goes to the executors has an eighth as many bytes (4 MB).
BITS = 1 << 25
SLOT = 32_768  # bits to a row of Spark's bitmap functions; fixed by Spark


def place(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def bitmap(keys: DataFrame, at: Column) -> np.ndarray:
    """Bits, packed in bytes, at the places `at` of the rows."""
    at = keys.select((at + 1).alias("at"))  # bucket 1 starts at position 1
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(BITS // 8 + 1, dtype=np.uint8)
    for r in rows:
        start = (r["slot"] - 1) * SLOT // 8
        out[start : start + SLOT // 8] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: len(out) - start]
    return out


def inside(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
