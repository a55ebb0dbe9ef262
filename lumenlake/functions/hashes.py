"""64-bit image hashes as 16 hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def halves(h: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits as longs (the whole value does not fit a signed long)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")


def whole(h: Column) -> Column:
    """All 64 bits as a long, the highest one as its sign."""
    up, low = halves(h)
    return F.shiftleft(up, 32).bitwiseOR(low)


def hex_of(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hash_distance(a: Column, b: Column) -> Column:
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def aspect_difference(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """1 - the smaller of the two aspect ratios over the larger."""
    one, two = w1 / h1, w2 / h2
    return 1 - F.least(one, two) / F.greatest(one, two)
