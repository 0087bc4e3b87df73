"""Big-endian words and bit fields of binary columns, as JVM-side expressions.

Positions count bytes from 0. Words are BIGINT, so no shift meets a sign bit.
Bytes beyond the end of a value read as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def be(data: Column, at: Column | int, n: int) -> Column:
    """n bytes (7 at most) from position `at` as an unsigned big-endian number."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("bigint"))


def bits(word: Column, width: int, first: int, count: int) -> Column:
    """`count` bits of a `width`-bit word, from bit `first` counted from the most significant one."""
    return F.shiftright(word, width - first - count).bitwiseAND(F.lit((1 << count) - 1).cast("bigint"))


def to_be(value: Column, n: int) -> Column:
    """A number below 256**n as n big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * n, "0"))


def only_if(condition: Column, value: Column) -> Column:
    """value, null unless the condition holds. The value is worked out in any case: what it names several times is then compiled to be worked out once, which Spark does neither in a branch nor in a lambda."""
    return F.get(F.array(value), F.when(condition, 0))


def flag(word: Column, mask: int) -> Column:
    return word.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def pack(*fields: tuple[Column, int]) -> Column:
    """(value, shift) pairs joined to one word."""
    shifted = [F.shiftleft(v.cast("bigint"), s) for v, s in fields]
    return reduce(lambda a, b: a.bitwiseOR(b), shifted)


def clock33(data: Column, at: Column | int) -> Column:
    """33-bit clock value of 5 bytes: 3, 15 and 15 bits, each followed by a marker bit."""
    at = F.lit(at) if isinstance(at, int) else at
    high, middle, low = be(data, at, 1), be(data, at + 1, 2), be(data, at + 3, 2)
    return pack((bits(high, 8, 4, 3), 30), (F.shiftright(middle, 1), 15), (F.shiftright(low, 1), 0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))
