"""Whole-number functions without floating-point logarithms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    """Bits that a number >= 0 needs; none for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def int_log(base: int, x: Column) -> Column:
    """Floor of the logarithm of x >= 1, by comparison with the powers of the base."""
    powers = []
    p = base
    while p < 1 << 62:
        powers.append(p)
        p *= base
    return sum((F.when(x >= F.lit(q), 1).otherwise(0) for q in powers[1:]), F.when(x >= F.lit(powers[0]), 1).otherwise(0))
