"""Bit strings as columns: fixed-width and exp-Golomb codes, trailing bits, big-endian bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u(value: Column, bits: Column | int) -> Column:
    """The low `bits` bits of value."""
    width = bits if isinstance(bits, Column) else F.lit(bits)
    return F.right(F.lpad(F.bin(value.cast("long")), 64, "0"), width)


def ue(value: Column) -> Column:
    """Exp-Golomb code: as many zeros as the binary digits of value + 1 but one, then these digits."""
    digits = F.bin(value.cast("long") + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(digits) - 1), digits)


def ue_length(value: Column) -> Column:
    return 2 * F.length(F.bin(value.cast("long") + 1)) - 1


def trailing(bits: Column) -> Column:
    """A stop bit, then zeros up to the next byte."""
    one = F.concat(bits, F.lit("1"))
    return F.concat(one, F.repeat(F.lit("0"), F.pmod(-F.length(one), F.lit(8))))


def aligned(bits: Column) -> Column:
    """Trailing bits unless the string ends at a byte already."""
    return F.when(F.length(bits) % 8 == 0, bits).otherwise(trailing(bits))


def to_hex(bits: Column) -> Column:
    """Hex digits of a bit string whose length is a multiple of four."""
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(bits) / 4).cast("int") - 1), lambda i: F.lower(F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16))), "")


def big_endian(value: Column, size: int) -> Column:
    """The value's last `size` bytes, most significant first."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 2 * max(size, 8), "0"), F.lit(2 * size)))


def from_big_endian(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("long")
