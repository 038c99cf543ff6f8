"""Half-precision numbers (binary16) in smallint columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(x: Column) -> Column:
    """The bits of the nearest half (ties to even) of a double: from 65,520 on infinite, below 2**-14 in steps of 2**-24; null stays null."""
    size = F.abs(x.cast("double"))
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-14))))
    power = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= size, 1).when(F.pow(F.lit(2.0), guess) > size, -1).otherwise(0)
    power = F.least(F.greatest(power, F.lit(-14)), F.lit(16))  # the logarithm may be off by one next to a power of two
    steps = F.rint(size * F.pow(F.lit(2.0), 10 - power))
    bits = F.when(F.isnan(size), 0x7E00).when(size >= 65520, 0x7C00).otherwise((power + 15) * 1024 + steps - 1024)
    bits = bits.cast("int")
    return F.when(x.isNotNull(), F.when(x < 0, bits - 32768).otherwise(bits)).cast("smallint")


def whole(bits: Column) -> Column:
    """The double of a half's bits."""
    plain = F.when(bits < 0, bits.cast("int") + 32768).otherwise(bits.cast("int"))
    power, rest = F.shiftright(plain, 10), plain % 1024
    size = F.when(power == 0, rest * F.lit(2.0**-24)).when((power == 31) & (rest > 0), float("nan")).when(power == 31, float("inf")).otherwise((1024 + rest) * F.pow(F.lit(2.0), power - 25))
    return F.when(bits < 0, -size).otherwise(size)
