"""A bitmap of a fixed size over hashes: what it lacks is not in the set, what it has may be."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits; two megabytes, whatever the input.
BITS = 1 << 24


def bit(hash_: Column) -> Column:
    return F.pmod(hash_, F.lit(BITS))


def collect(bits: DataFrame) -> np.ndarray:
    """The bitmap of the places in (bit long); at most BITS / 8 rows reach the driver, a part at a time."""
    out = np.zeros(BITS // 8, np.uint8)
    for r in bits.groupBy(F.expr("bit div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 AS int)))").alias("on")).toLocalIterator():
        out[r.byte] = r.on
    return out


def has(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
