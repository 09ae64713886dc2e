"""Scalar expressions over numbers, arrays and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    """floor(log2 x) + 1 for x >= 2, else 0."""
    return F.when(x < 2, 0).otherwise(F.length(F.bin(x))).cast("int")


def next_power_of_two(x: Column) -> Column:
    """Least power of two that is at least x; 0 below 0, 1 for 0."""
    up = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1)))
    return F.when(x < 0, 0).when(x <= 1, 1).otherwise(up).cast("long")


def dense_dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(dot: Column, norm2_a: Column, norm2_b: Column) -> Column:
    """0 where a norm is 0."""
    return F.when(norm2_a * norm2_b <= 0, 0.0).otherwise(dot / F.sqrt(norm2_a * norm2_b))


def dense_cosine(a: Column, b: Column) -> Column:
    return cosine(dense_dot(a, b), dense_dot(a, a), dense_dot(b, b))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / union)


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n code points; none for shorter texts and nulls."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def runs(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))

    return F.when(F.length(text) >= n, bound(chars, runs)).otherwise(F.array().cast("array<string>"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hash(gram: Column) -> Column:
    """A positive index below 2^32 from the first 32 bits of the MD5."""
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("long") % 4294967295 + 1


def pad_suffix(number: Column, width: int = 2) -> Column:
    """A number as at least ``width`` digits, as in names of partition files."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
