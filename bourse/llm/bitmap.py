"""A bitmap of fixed size as a first filter before a join.

``build`` hashes a long column into ``BITS`` bits with Spark's bitmap
aggregates (partly summed before the shuffle) and brings the 2 MB to the
driver, whatever the input; tasks drop rows whose bit is not set before they
are shuffled. Rows that pass by chance go out at the exact join that follows,
so the filter only changes the work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24
_PART = 1 << 15


def build(df: DataFrame, value: Column) -> np.ndarray:
    """Packed bitmap of the values."""
    bit = df.select((F.pmod(value, F.lit(BITS)) + 1).alias("x"))
    parts = (bit.groupBy(F.bitmap_bucket_number("x").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect())
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        at = (r["part"] - 1) * (_PART // 8)
        out[at:at + _PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def test(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where the bit of an int64 value is set."""
    x = values % BITS                     # numpy's sign follows the divisor, as pmod's does
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0
