"""Integer mixing that any SQL engine reproduces, used wherever a draw must be repeatable.

Every product stays under 2**63.  Two squaring rounds break the linearity a plain
congruential form would have (with it, bootstrap draws would be shifts of each other).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2**31 - 1


def mix(a: Column, b: Column, seed: int) -> Column:
    """Hash of two non-negative integers into [0, MODULUS)."""
    a = F.pmod(a.cast("bigint"), F.lit(MODULUS))
    b = F.pmod(b.cast("bigint"), F.lit(MODULUS))
    m = F.lit(MODULUS).cast("bigint")
    first = (a * 40503 + b * 69621 + F.lit(seed * 7919 + 12345)) % m
    second = (first * first + b * 104729 + a * 31 + 1) % m
    return (second * second + second * 48271 + first) % m
