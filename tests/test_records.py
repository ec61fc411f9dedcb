"""Scalar functions, partitions and the generator against plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortloom.functions import record as R
from sortloom.operators import partition as P
from sortloom.sources import gensort as G

#: n: key, CRC-32 of the binary record; key, CRC-32 of the ASCII record.
VECTORS = {
    0: ("4a696d47726179524950", 0x97503E23, "AsfAGHM5om", 0x3FCAEA0A),
    1: ("95e0e48262b3edfe0447", 0xA5E95DCE, "~sHd0jDv6X", 0xFF8F8052),
    2: ("45979353dbed5329365c", 0xC2F18395, "uI^EYm8s=|", 0x0727031A),
    500: ("adb0a4c39ab062df7d86", 0x0975ACE4, "$fad_X2SF3", 0xF57F5529),
    2000: ("5c71db9cae17c15fe6d3", 0xF13289A6, "4~i4hw_(#G", 0x0BCF17C1),
    10**12 - 1: ("ca00cc80eaf54f558408", 0x469F867E, "roQlF~x%FK", 0x9497AE09),
    2**64 + 5: ("ec980a6cdde7e4294b7a", 0xA7BC3AD5, 'w7N"b~9iD-', 0xA895B577),
}


@pytest.mark.parametrize("n", VECTORS)
def test_generator_vectors(n):
    binary, ascii_form = G.records(n, 1)[0].tobytes(), G.records(n, 1, True)[0].tobytes()
    assert (binary[:10].hex(), zlib.crc32(binary), ascii_form[:10].decode(), zlib.crc32(ascii_form)) == VECTORS[n]


def test_first_record_byte_by_byte():
    want = bytes.fromhex("4a696d47726179524950" + "0011") + b"0" * 32 + bytes.fromhex("8899aabb") + b"222200002222000022220000222200002222000000001111" + bytes.fromhex("ccddeeff")
    assert G.records(0, 1)[0].tobytes() == want


def test_steps_compose():
    for n in (0, 1, 2, 63, 1000, 2**70):
        a, c = G.steps(n)
        assert G.steps(n + 1)[1] == (G.A * c + G.C) & R.MASK128 and a % 2 == 1
    assert (np.concatenate([G.records(7, 5), G.records(12, 3)]) == G.records(7, 8)).all()


@pytest.mark.parametrize(("count", "binary", "ascii_sum"), [(1, "97503e23", "3fcaea0a"), (10, "5b2d1434d", "469302dca"), (1000, "1f9ffe645ec", "1f5dfb3631a"), (100_000, "c327a1c42c28", "c34e19c81885")])
def test_checksums_whatever_the_partitions(spark, count, binary, ascii_sum):
    for parts in (1, 3, 8):
        for form, want in ((False, binary), (True, ascii_sum)):
            rows = G.generate(spark, count, ascii_form=form, partitions=parts)
            assert rows.agg(R.u128_hex(R.crc_sum(F.col("record")))).first()[0] == want


def test_generator_options(spark):
    rows = G.generate(spark, 5, start=2**64 + 3, partitions=2).select(F.col("n").cast("string"), F.hex(R.key_of(F.col("record")))).collect()
    assert rows[2][0] == str(2**64 + 5) and rows[2][1].lower() == VECTORS[2**64 + 5][0]
    assert G.generate(spark, 0).count() == 0


def brute_partition(k, n):
    return sum(int(i / n * 2**24) <= k for i in range(1, n))


def test_partition_formula_equals_split_points(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 8, 100, 1000, 1024):
        points = [r["prefix"] for r in P.split_points(spark, n).collect()]
        assert points == [i * 2**24 // n for i in range(1, n)]
        prefixes = sorted({0, 2**24 - 1, *points[:50], *(x - 1 for x in points[:50]), *(rng.randrange(2**24) for _ in range(50))} - {-1})
        rows = spark.createDataFrame([(x,) for x in prefixes], "k long").select("k", P.partition_of_prefix(F.col("k"), n).alias("p")).collect()
        assert [r["p"] for r in rows] == [brute_partition(r["k"], n) for r in rows]
    for bad in (0, 2**24 + 1):
        with pytest.raises(ValueError):
            P.checked_count(bad)


def test_partition_vectors(spark):
    want = [(0x000000, 8, 0), (0x1FFFFF, 8, 0), (0x200000, 8, 1), (0xFFFFFF, 8, 7), (0xFFC000, 1024, 1023), (0xFFBFFF, 1024, 1022), (0x555554, 3, 0), (0x555555, 3, 1)]
    for k, n, p in want:
        assert spark.range(1).select(P.partition_of(F.unhex(F.lit(f"{k:06x}00000000000000")), n)).first()[0] == p


def test_histograms_of_generated_records(spark):
    rows = G.generate(spark, 1000).select(R.key_of(F.col("record")).alias("key"))
    of = lambda n: [r["records"] for r in P.histogram(rows, n).orderBy("p").collect()]
    assert of(8) == [135, 138, 129, 127, 121, 100, 121, 129]
    assert of(16) == [64, 71, 73, 65, 67, 62, 67, 60, 62, 59, 54, 46, 64, 57, 60, 69]


def test_rows_stand_in_the_partition_of_their_number(spark):
    rows = P.equal_width(G.generate(spark, 3000).select(R.key_of(F.col("record")).alias("key")), 8)
    assert rows.where(F.spark_partition_id() != F.col("p")).count() == 0 and rows.rdd.getNumPartitions() == 8
    nulls = spark.createDataFrame([(None,)], "key binary")
    with pytest.raises(Exception, match="without a key"):
        P.equal_width(nulls, 4).collect()


def test_scalar_functions(spark):
    key = bytes.fromhex("4a696d47726179524950")
    one = lambda c: spark.createDataFrame([(bytearray(key),)], "key binary").select(c.alias("x")).first()[0]
    k = F.col("key")
    assert one(R.key_hash43(k)) == -200532572 and one(R.key_hash43(F.unhex(F.lit("ff" * 10)))) == -545799964
    assert bytes(one(R.normalized_key(k, 4))) == key[:4] and bytes(one(R.normalized_key(k, 16))) == key + bytes(6)
    assert (one(R.byte_at(k, 0)), one(R.byte_at(k, 99)), one(R.hex_digit(k, 1)), one(R.hex_digit(k, 99))) == (0x4A, 0, "A", "0")
    assert one(R.key_compare(k, F.unhex(F.lit("80" + "00" * 9)))) == -1 and one(R.key_compare(k, k)) == 0
    assert one(R.prefix24(k)) == 0x4A696D and one(R.hex_of(k)) == key.hex()


@pytest.mark.parametrize("x", [0, 1, 255, 2**63, 2**64 - 1, 2**64, 2**64 + 1, 0x746A51007040EA07ED, 10**37])
def test_numbers_of_128_bits(spark, x):
    row = spark.range(1).select(R.u128_of_decimal(F.lit(str(x))).alias("x")).select("x", R.u128_hex(F.col("x")).alias("h"))
    row = row.select("x", "h", R.u128_of_hex(F.col("h")).alias("y")).first()
    assert row["h"] == format(x, "x") and int(row["x"]) == int(row["y"]) == x


def test_bad_records_and_numbers_fail(spark):
    with pytest.raises(Exception, match="not a decimal"):
        spark.range(1).select(R.u128_of_decimal(F.lit("12x"))).collect()


@pytest.mark.parametrize(("x", "y", "n"), [(0, 0, 0), (1, 2**128 - 1, 1), (2**64 - 1, 2**64 + 1, 64), (0x2360ED051FC65DA44385DF649FCCF645, 0x4A696D47726179524950202020202001, 127), (2**127 + 12345, 3, 128), (7, 2**65, 15), (2**128 - 1, 2**128 - 1, 16), (5, 6, -1)])
def test_wide_numbers_wrap(spark, x, y, n):
    a, b = (R.wide_of_hex(F.lit(format(v, "x"))) for v in (x, y))
    row = spark.range(1).select(R.wide_hex(a), R.wide_hex(R.wide_add(a, b)), R.wide_hex(R.wide_multiply(a, b)), R.wide_hex(R.wide_shift_left(a, F.lit(n))), R.wide_half(a, True), R.wide_half(a, False)).first()
    left = x << n & R.MASK128 if 0 <= n < 128 else 0
    assert list(row) == [format(x, "x"), format((x + y) & R.MASK128, "x"), format(x * y & R.MASK128, "x"), format(left, "x"), format(x >> 64, "016x"), format(x & 2**64 - 1, "016x")]


def test_records_are_equal_by_their_keys(spark):
    row = lambda a, b: spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary").select(R.same_key(F.col("a"), F.col("b"))).first()[0]
    assert row(b"0123456789xyz", b"0123456789abc") and not row(b"0123456788", b"0123456789")
