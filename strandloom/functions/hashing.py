"""A 64-bit invertible integer mix, with wrapping arithmetic, for columns and for arrays.

Spark's ANSI mode rejects overflow, so sums are made of 32-bit halves.  The mix is a published public-domain one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 56
#: The rounds of the mix. add: x plus x shifted left by each; xor: x with x shifted right.
ROUNDS = (("xor", 24), ("add", 3, 8), ("xor", 14), ("add", 2, 4), ("xor", 28), ("add", 31))
_LOW = 0xFFFFFFFF


def wrapping_add(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def with_mix(df: DataFrame, column: str) -> DataFrame:
    """df with the column replaced by its mix; a projection for each step keeps the expressions small."""
    x = F.col(column)
    df = df.withColumn(column, wrapping_add(F.bitwise_not(x), F.shiftleft(x, 21)))
    for kind, *shifts in ROUNDS:
        if kind == "xor":
            df = df.withColumn(column, x.bitwiseXOR(F.shiftrightunsigned(x, shifts[0])))
            continue
        total = x
        for s in shifts:
            total = wrapping_add(total, F.shiftleft(x, s))
        df = df.withColumn(column, total)
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """The same for arrays of unsigned 64-bit integers."""
    x = ~x + (x << np.uint64(21))
    for kind, *shifts in ROUNDS:
        if kind == "xor":
            x = x ^ (x >> np.uint64(shifts[0]))
        else:
            x = x + sum((x << np.uint64(s) for s in shifts[1:]), x << np.uint64(shifts[0]))
    return x
