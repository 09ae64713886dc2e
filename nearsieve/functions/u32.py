"""Unsigned 32-bit arithmetic on longs, without overflow under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearsieve.config import MASK


def mask(a: Column) -> Column:
    return a.bitwiseAND(F.lit(MASK))


def mul(a: Column, b: Column | int) -> Column:
    """a * b mod 2^32; both operands in [0, 2^32), intermediates below 2^49."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(65535)), 16)
    return mask(high + a * b.bitwiseAND(F.lit(65535)))


def fold(a: Column, shift: int = 13) -> Column:
    return a.bitwiseXOR(F.shiftright(a, shift))


def top_bits(a: Column, left: int, bits: int) -> Column:
    """The ``bits`` highest bits of a << left."""
    return F.shiftright(mask(F.shiftleft(a, left)), 32 - bits)
