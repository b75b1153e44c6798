"""The order-sensitive 64-bit fingerprint of an extent map, with wrapping arithmetic under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: its start as a signed long, and the part of its prime 2^40 + 435 that multiplies low words.
START = -3750763034362895579
PRIME_LOW = 435

#: What a kind counts as in the fingerprint.
KIND_CODE = {"data": 1, "zero": 2, "hole": 3}


def _step(h: Column, byte: Column) -> Column:
    """(h xor byte) * (2^40 + 435) modulo 2^64, by 32-bit halves."""
    x = h.bitwiseXOR(byte)
    low = x.bitwiseAND(F.lit(0xFFFFFFFF)) * PRIME_LOW
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(x, 32) * PRIME_LOW + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
    return F.shiftleft(high.bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def extent_fingerprint(extents: Column) -> Column:
    """From an array of (start, length, code) in order: 16 hexadecimal digits over their little-endian bytes."""
    pieces = F.flatten(
        F.transform(
            extents,
            lambda e: F.concat(
                *[F.array(*[F.shiftrightunsigned(e[c], 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(8)]) for c in ("start", "length", "code")],
            ),
        )
    )
    return F.lpad(F.lower(F.hex(F.aggregate(pieces, F.lit(START).cast("long"), _step))), 16, "0")
