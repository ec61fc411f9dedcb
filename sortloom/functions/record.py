"""The record: 100 bytes, of which the first 10 are the key, ordered as unsigned bytes; and scalar functions on it.

All are native expressions. Binary columns compare, sort and aggregate bytewise and unsigned, so a key needs no decoding.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_BYTES, KEY_BYTES = 100, 10
VALUE_BYTES = RECORD_BYTES - KEY_BYTES
#: Partitions are told apart by so many leading bytes of the key.
PREFIX_BYTES = 3
PREFIXES = 1 << (8 * PREFIX_BYTES)
MASK128 = (1 << 128) - 1


def key_of(record: Column) -> Column:
    return F.substring(record, 1, KEY_BYTES)


def value_of(record: Column) -> Column:
    return F.substring(record, KEY_BYTES + 1, VALUE_BYTES)


def prefix24(key: Column) -> Column:
    """The first three bytes as a number (bigint)."""
    return F.conv(F.hex(F.substring(key, 1, PREFIX_BYTES)), 16, 10).cast("bigint")


def hex_of(data: Column) -> Column:
    """Lower-case hexadecimal digits."""
    return F.lower(F.hex(data))


def crc(record: Column) -> Column:
    """CRC-32 (IEEE, reflected) as an unsigned number in a bigint."""
    return F.crc32(record)


def crc_sum(record: Column) -> Column:
    """Sum of CRCs, exact for 2e28 records: decimal(38,0) and not bigint, which overflows after some 4e9."""
    return F.sum(crc(record).cast("decimal(28,0)"))


def u128_hex(number: Column) -> Column:
    """decimal(38,0) as lower-case hexadecimal digits without leading zeros. conv() is 64 bits wide, so in two halves."""
    n = number.cast("decimal(38,0)")
    two64 = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    low = (n % two64).cast("decimal(20,0)")
    # Without the remainder the quotient is whole, so that decimal division doesn't round.
    high = ((n - low.cast("decimal(38,0)")) / two64).cast("decimal(20,0)")
    as_hex = lambda c: F.lower(F.conv(c.cast("string"), 10, 16))
    return F.when(high > 0, F.concat(as_hex(high), F.lpad(as_hex(low), 16, "0"))).otherwise(as_hex(low))


def u128_of_decimal(digits: Column) -> Column:
    """A string of decimal digits as a number; anything else is an error."""
    return F.when(F.rlike(digits, F.lit("^[0-9]+$")), digits).otherwise(F.raise_error(F.lit("not a decimal number"))).cast("decimal(38,0)")


def u128_of_hex(digits: Column) -> Column:
    """A string of up to 32 hexadecimal digits (below 1e38) as decimal(38,0)."""
    padded = F.lpad(digits, 32, "0")
    half = lambda at: F.conv(F.substring(padded, at, 16), 16, 10).cast("decimal(20,0)")
    return (half(1).cast("decimal(38,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + half(17)).cast("decimal(38,0)")


def byte_at(data: Column, index: int) -> Column:
    """The byte at a place from 0, most significant first, as an int; beyond the end 0."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(data, index + 1, 1)), F.lit("")), 16, 10).cast("int"), F.lit(0))


def hex_digit(data: Column, index: int) -> Column:
    """The upper-case hexadecimal digit at a place from 0; beyond the end '0'."""
    return F.coalesce(F.nullif(F.substring(F.hex(data), index + 1, 1), F.lit("")), F.lit("0"))


def key_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes of the keys."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def key_hash43(key: Column) -> Column:
    """h = 43 * h + signed byte over the key's ten bytes, in 32-bit arithmetic that wraps."""

    def step(h: Column, b: Column) -> Column:
        return F.pmod(h * 43 + b - F.when(b > 127, 256).otherwise(0), F.lit(1 << 32))

    # The bytes are taken apart outside the lambda: inside, a name could mean another column's alias.
    each = F.array(*[F.conv(F.hex(F.substring(key, i + 1, 1)), 16, 10).cast("bigint") for i in range(KEY_BYTES)])
    h = F.aggregate(each, F.lit(0).cast("bigint"), step)
    return (h - F.when(h >= 1 << 31, 1 << 32).otherwise(0)).cast("int")


def normalized_key(key: Column, length: int) -> Column:
    """The key's first `length` bytes, or all ten and zeros after them."""
    return F.rpad(F.substring(key, 1, min(length, KEY_BYTES)), length, F.lit(b"\x00"))


# ---- unsigned numbers of 128 bits that wrap: eight limbs of 16 bits, lowest first ----------------------------

LIMBS, LIMB = 8, 16


def wide_of_hex(digits: Column) -> Column:
    """array<bigint> of limbs, from up to 32 hexadecimal digits."""
    padded = F.lpad(digits, 32, "0")
    return F.array(*[F.conv(F.substring(padded, 29 - 4 * i, 4), 16, 10).cast("bigint") for i in range(LIMBS)])


def wide_hex(x: Column) -> Column:
    """Lower-case hexadecimal digits without leading zeros; 0 is "0"."""
    digits = F.concat(*[F.lpad(F.lower(F.hex(F.get(x, F.lit(i)))), 4, "0") for i in reversed(range(LIMBS))])
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))


def _carried(sums: Column) -> Column:
    """Limbs below 2**16 from sums that are larger; what goes beyond 128 bits is dropped."""
    step = lambda acc, v: F.struct(F.shiftright(acc["carry"] + v, LIMB).alias("carry"), F.concat(acc["out"], F.array((acc["carry"] + v).bitwiseAND((1 << LIMB) - 1))).alias("out"))
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(sums, start, step, lambda acc: acc["out"])


def wide_add(x: Column, y: Column) -> Column:
    return _carried(F.zip_with(x, y, lambda a, b: a + b))


def wide_multiply(x: Column, y: Column) -> Column:
    """The low 128 bits of the product: products of limbs have 32 bits, sums of eight of them 35."""
    at = lambda c, i: F.get(c, F.lit(i))
    return _carried(F.array(*[sum((at(x, i) * at(y, k - i) for i in range(1, k + 1)), at(x, 0) * at(y, k)) for k in range(LIMBS)]))


def wide_shift_left(x: Column, n: Column) -> Column:
    """x times 2**n; nothing is left for n of 128 or more, or below 0."""
    whole, part = F.shiftright(n, 4), n.bitwiseAND(LIMB - 1)
    moved = F.transform(F.sequence(F.lit(0), F.lit(LIMBS - 1)), lambda i: F.when(i >= whole, F.coalesce(F.get(x, (i - whole).cast("int")), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
    scaled = F.transform(moved, lambda v: (v * F.pow(F.lit(2.0), part)).cast("bigint"))  # below 2**31: exact
    return F.when((n >= 0) & (n < LIMBS * LIMB), _carried(scaled)).otherwise(F.array(*[F.lit(0).cast("bigint")] * LIMBS))


def wide_half(x: Column, high: bool) -> Column:
    """The high or low 64 bits, as 16 hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(x, F.lit(i)))), 4, "0") for i in (range(7, 3, -1) if high else range(3, -1, -1))])


def same_key(a: Column, b: Column) -> Column:
    """Records are equal if their keys are: values don't count."""
    return key_of(a) == key_of(b)
