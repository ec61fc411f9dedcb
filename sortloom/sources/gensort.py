"""Generated records: record n depends on n alone, so any split of a range makes the same records.

A linear congruential generator of 128 bits, x' = A x + C modulo 2**128 from x = 0, gives record n its random
number, the state after n + 1 steps. n steps at once are one multiplication and one addition, whose factors come by
squaring; a block of records is made from its first state with the factors of 0, 1, 2, ... steps, all at once in
numpy. The rows leave as Arrow batches over one buffer: no Python object for a record.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sortloom.functions.record import MASK128, RECORD_BYTES

#: Multiplier and increment of the generator.
A, C = 0x2360ED051FC65DA44385DF649FCCF645, 0x4A696D47726179524950202020202001
BLOCK = 1 << 14
SCHEMA = "n decimal(20,0), record binary"
U = np.uint64
LOW32 = U(0xFFFFFFFF)
DIGITS = np.frombuffer(b"0123456789ABCDEF", np.uint8)


def steps(n: int) -> tuple[int, int]:
    """(a, c) with x -> a x + c the same as n steps of the generator, by squaring."""
    a, c, fa, fc = 1, 0, A, C
    while n:
        if n & 1:
            a, c = a * fa & MASK128, (c * fa + fc) & MASK128
        fa, fc = fa * fa & MASK128, (fc * fa + fc) & MASK128
        n >>= 1
    return a, c


def state_of(n: int) -> int:
    """The random number of record n."""
    return steps(n + 1)[1]


@cache
def _block_factors() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The factors of 0..BLOCK-1 steps, each as four columns of 32 bits, lowest first."""
    a, c, made = 1, 0, []
    for _ in range(BLOCK):
        made.append((a, c))
        a, c = a * A & MASK128, (c * A + C) & MASK128
    return tuple([np.array([m[k] >> 32 * i & 0xFFFFFFFF for m in made], U) for i in range(4)] for k in (0, 1))  # type: ignore[return-value]


def states(n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64 bits of the random numbers of records n .. n + count - 1, count <= BLOCK."""
    x = state_of(n)
    parts = [U(x >> 32 * i & 0xFFFFFFFF) for i in range(4)]
    fa, fc = _block_factors()
    out, carry = [], np.zeros(count, U)
    for j in range(4):
        # Sums of up to five 64-bit products would overflow: add low and high halves apart.
        low, high = fc[j][:count] + (carry & LOW32), carry >> U(32)
        for i in range(j + 1):
            product = fa[j - i][:count] * parts[i]
            low, high = low + (product & LOW32), high + (product >> U(32))
        out.append(low & LOW32)
        carry = high + (low >> U(32))
    return out[3] << U(32) | out[2], out[1] << U(32) | out[0]


def _bytes(x: np.ndarray, n: int) -> np.ndarray:
    """The n highest bytes of 64-bit numbers, most significant first."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _hex(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The 32 upper-case hexadecimal digits, in ASCII, of 128-bit numbers."""
    raw = np.concatenate([_bytes(high, 8), _bytes(low, 8)], axis=1)
    out = np.empty((len(high), 32), np.uint8)
    out[:, ::2], out[:, 1::2] = DIGITS[raw >> 4], DIGITS[raw & 15]
    return out


def records(n: int, count: int, ascii_form: bool = False) -> np.ndarray:
    """Records n .. n + count - 1 as rows of bytes, count <= BLOCK."""
    high, low = states(n, count)
    out = np.empty((count, RECORD_BYTES), np.uint8)
    at = n + np.arange(count, dtype=object) if n + count > 1 << 63 else n + np.arange(count)
    number = _hex(np.array([int(x) >> 64 for x in at], U) if at.dtype == object else np.zeros(count, U), np.array([int(x) & (1 << 64) - 1 for x in at], U) if at.dtype == object else at.astype(U))
    random = _hex(high, low)
    out[:, 12:44] = number
    if ascii_form:
        for first, digits, value in ((0, 8, high.copy()), (8, 2, low.copy())):
            for k in range(digits):
                out[:, first + k] = (value % U(95)).astype(np.uint8) + 32
                value //= U(95)
        out[:, 10:12] = out[:, 44:46] = 32
        out[:, 46:98] = np.repeat(random[:, 19:32], 4, axis=1)
        out[:, 98:] = (13, 10)
    else:
        out[:, :8], out[:, 8:10] = _bytes(high, 8), _bytes(low, 2)
        out[:, 10:12] = (0x00, 0x11)
        out[:, 44:48] = (0x88, 0x99, 0xAA, 0xBB)
        out[:, 48:96] = np.repeat(random[:, 20:32], 4, axis=1)
        out[:, 96:] = (0xCC, 0xDD, 0xEE, 0xFF)
    return out


def as_binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column over the same memory."""
    offsets = np.arange(0, (len(rows) + 1) * rows.shape[1], rows.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def batches(first: int, after: int, ascii_form: bool) -> Iterator[pa.RecordBatch]:
    """Records first .. after - 1."""
    for n in range(first, after, BLOCK):
        count = min(BLOCK, after - n)
        if n + count < 1 << 63:
            numbers = pa.array(np.arange(n, n + count)).cast(pa.decimal128(20, 0))
        else:
            import decimal

            numbers = pa.array([decimal.Decimal(n + i) for i in range(count)], pa.decimal128(20, 0))
        yield pa.RecordBatch.from_arrays([numbers, as_binary(records(n, count, ascii_form))], names=["n", "record"])


class Range(InputPartition):
    def __init__(self, first: int, after: int):
        self.first, self.after = first, after


class GensortReader(DataSourceReader):
    def __init__(self, options):
        self.start, self.count = int(options.get("start", 0)), int(options.get("count", 0))
        self.ascii_form = str(options.get("ascii", "false")).lower() == "true"
        self.parts = max(1, int(options.get("numpartitions", options.get("numPartitions", 0))) or -(-self.count // 10_000_000))
        if self.start < 0 or self.count < 0:
            raise ValueError("start and count must not be negative")

    def partitions(self):
        cuts = [self.start + self.count * i // self.parts for i in range(self.parts + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition):
        yield from batches(partition.first, partition.after, self.ascii_form)


class GensortSource(DataSource):
    """spark.read.format("gensort").option("count", N): options start, count, ascii, numPartitions."""

    @classmethod
    def name(cls):
        return "gensort"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GensortReader(self.options)


def generate(spark: SparkSession, count: int, start: int = 0, ascii_form: bool = False, partitions: int | None = None) -> DataFrame:
    """n, record of records start .. start + count - 1."""
    spark.dataSource.register(GensortSource)
    reader = spark.read.format("gensort").option("start", start).option("count", count).option("ascii", str(ascii_form).lower())
    return (reader.option("numPartitions", partitions) if partitions else reader).load()
