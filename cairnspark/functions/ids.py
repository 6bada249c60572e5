"""Identifiers and the XOR metric, as column expressions over 32-byte binaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 8  # of 32 bits


def sha256_id(v: Column) -> Column:
    """Identity of content under the built-in profile."""
    return F.unhex(F.sha2(v, 256))


def to_hex(v: Column) -> Column:
    return F.lower(F.hex(v))


def from_hex(v: Column) -> Column:
    """Null unless 64 hexadecimal digits."""
    return F.when(v.rlike("^[0-9a-fA-F]{64}$"), F.unhex(v))


def short(v: Column) -> Column:
    """The display form: the first 16 digits."""
    return F.substring(to_hex(v), 1, 16)


def words(v: Column) -> Column:
    """The id as eight unsigned 32-bit numbers; arrays of them order as the bytes do."""
    digits = F.hex(v)
    return F.array(*[F.conv(F.substr(digits, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint") for i in range(WORDS)])


def distance(a: Column, b: Column) -> Column:
    """XOR of two ids given as words."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def leading_zeros(d: Column) -> Column:
    """Of a distance in bits; 256 if it is zero."""
    first = [F.when(F.get(d, F.lit(i)) != 0, F.lit(32 * i + 32) - F.length(F.bin(F.get(d, F.lit(i))))) for i in range(WORDS)]
    return F.coalesce(*first, F.lit(256)).cast("int")


def bucket_index(a: Column, b: Column) -> Column:
    """255 less the leading zeros of the distance; null for equal ids."""
    z = leading_zeros(distance(a, b))
    return F.when(z < 256, 255 - z)


def next_revision(r: Column) -> Column:
    """One more, saturating."""
    top = F.lit(2**63 - 1)
    return F.when(r == top, top).otherwise(r + 1)
