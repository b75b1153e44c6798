"""Little-endian fields, flags, rounding and text checks on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTOR = 512


def u8(raw: Column, at: int) -> Column:
    """The byte at an offset (from 0) as a number."""
    return F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("long")


def little_endian(raw: Column, at: int, size: int) -> Column:
    """``size`` bytes from an offset as an unsigned number; null if the column is too short.

    Eight bytes with the top bit set come out negative, as the same 64 bits.
    """
    parts = [F.shiftleft(u8(raw, at + i), 8 * i) for i in range(size)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == F.lit(mask)


def ceil_div(a: Column, b: Column | int) -> Column:
    """Rounded up, for non-negative longs, without a detour over doubles."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - a % b) / b).cast("long") + (a % b > 0).cast("long")


def round_up(a: Column, step: int = SECTOR) -> Column:
    """The next multiple, exact for every non-negative long that has one."""
    return a + F.pmod(-a, F.lit(step))


def is_multiple(a: Column, step: Column | int) -> Column:
    return a % step == 0


def is_power_of_two(a: Column) -> Column:
    return (a > 0) & (a.bitwiseAND(a - 1) == 0)


def less(a: Column, b: Column) -> Column:
    """Subtraction that stops at 0."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def finite_positive(x: Column) -> Column:
    return (x > 0) & ~F.isnan(x) & (x < F.lit(float("inf")))


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def strict_hex(text: Column, size: int) -> Column:
    """Exactly ``size`` bytes of lower-case hexadecimal."""
    return text.rlike(f"^[0-9a-f]{{{2 * size}}}$")


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1F\x7F-\x9F]")


def same_ascii(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def xml_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def strict_utc(text: Column) -> Column:
    """Whether the text is a real UTC time ``YYYY-MM-DDTHH:MM:SS[.fraction]Z``; a second of 60 is a leap second."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z$")
    second = F.substring(text, 18, 2)
    plain = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 6), F.when(second == "60", "59").otherwise(second))
    return shape & F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
