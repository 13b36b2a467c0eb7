"""32-bit hashes as column expressions on 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published mixer and of FNV-1a.
_MIX = (0x7FEB352D, 0x846CA68B)
_FNV_BASIS, _FNV_PRIME = 0x811C9DC5, 0x01000193
_LOW = (1 << 32) - 1


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2**32. Of c the signed form is taken, so that the product of two
    32-bit numbers stays within 64 bits, and ``x`` stands in the expression once."""
    signed = c - (1 << 32) if c >> 31 else c
    return (x * F.lit(signed).cast("long")).bitwiseAND(F.lit(_LOW))


def mix32(x: Column) -> Column:
    x = x.cast("long").bitwiseAND(F.lit(_LOW))
    for shift, c in ((16, _MIX[0]), (15, _MIX[1])):
        x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, shift)), c)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def hash32(seed: int, a: Column, b: Column) -> Column:
    """Two rounds of the mixer over a seed and two integers."""
    # the first round goes through an array of one, so that the second names it once
    first = F.transform(F.array(F.lit(seed).cast("long").bitwiseXOR(a.cast("long"))), mix32)
    return F.transform(F.transform(first, lambda x: x.bitwiseXOR(b.cast("long"))), mix32)[0]


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    hexed = F.hex(F.encode(text, "utf-8"))
    places = F.sequence(F.lit(0), F.floor(F.length(hexed) / 2).cast("int") - 1)
    byte = lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    hashed = F.aggregate(places, F.lit(_FNV_BASIS).cast("long"), lambda h, i: _times(h.bitwiseXOR(byte(i)), _FNV_PRIME))
    return F.when(F.length(hexed) == 0, F.lit(_FNV_BASIS).cast("long")).otherwise(hashed)
