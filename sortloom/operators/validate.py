"""Validation in the pass that sorts: counts, duplicates, disorder, first and last key and an additive checksum.

Order is checked where rows stand, batch by batch as they come out of the sort: neither a window, which would sort
them again, nor a new sort by key, which would find every result in order. Summaries of partitions merge in the order of partitions: the last
key of one is held against the first key of the next; empty partitions are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortloom.functions.record import KEY_BYTES, crc, hex_of, key_of, u128_hex


def boundaries(summaries: DataFrame) -> DataFrame:
    """p, previous_last, first_key and whether the keys repeat or go down from the partition before to this one."""
    before = F.lag("last_key").over(Window.orderBy("p"))
    rows = summaries.withColumn("previous_last", before)
    return rows.select("p", "previous_last", "first_key", F.coalesce(F.col("previous_last") == F.col("first_key"), F.lit(False)).alias("repeats"), F.coalesce(F.col("previous_last") > F.col("first_key"), F.lit(False)).alias("descends"))


def merged(summaries: DataFrame) -> DataFrame:
    """One row for all partitions; a summary has one row a partition, so this is a small step whatever the input."""
    before = F.lag("last_key").over(Window.orderBy("p"))
    rows = summaries.withColumn("previous_last", before)
    return rows.agg(
        F.min_by("first_key", "p").alias("first_key"),
        F.max_by("last_key", "p").alias("last_key"),
        F.sum("checksum").alias("checksum"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"),
        F.coalesce(F.sum(F.col("duplicate_count") + F.coalesce(F.col("previous_last") == F.col("first_key"), F.lit(False)).cast("bigint")), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum(F.col("unordered_count") + F.coalesce(F.col("previous_last") > F.col("first_key"), F.lit(False)).cast("bigint")), F.lit(0)).alias("unordered_count"),
    )


def readable(summary: DataFrame) -> DataFrame:
    """Keys and the checksum as hexadecimal digits, ready to be shown."""
    keys = {c: hex_of(F.col(c)) for c in ("first_key", "last_key")}
    return summary.withColumns(keys | {"checksum": u128_hex(F.coalesce("checksum", F.lit(0)))})


class Running:
    """The summary of a stream of keys and CRCs: a batch is compared at once, its first key with the last one before."""

    def __init__(self):
        self.first = self.last = None
        self.count = self.duplicates = self.falls = self.total = 0

    def add(self, keys: np.ndarray, crcs: np.ndarray) -> None:
        """keys: rows of KEY_BYTES bytes."""
        if not len(keys):
            return
        joined = keys if self.last is None else np.concatenate([np.frombuffer(self.last, np.uint8)[None], keys])
        high, low = np.ascontiguousarray(joined[:, :8]).view(">u8")[:, 0], np.ascontiguousarray(joined[:, 8:]).view(">u2")[:, 0]
        same = high[1:] == high[:-1]
        self.duplicates += int((same & (low[1:] == low[:-1])).sum())
        self.falls += int(((high[1:] < high[:-1]) | (same & (low[1:] < low[:-1]))).sum())
        self.total += int(crcs.sum(dtype=np.uint64))  # a batch has far fewer than 2**32 rows
        self.count += len(keys)
        self.first, self.last = self.first or keys[0].tobytes(), keys[-1].tobytes()

    def row(self, p: int) -> dict:
        return {"p": p, "first_key": self.first, "last_key": self.last, "record_count": self.count, "duplicate_count": self.duplicates, "unordered_count": self.falls, "checksum": Decimal(self.total)}


SUMMARY = "p int, first_key binary, last_key binary, record_count long, duplicate_count long, unordered_count long, checksum decimal(38,0)"


def partition_summaries(records: DataFrame, record: str = "record", key: Column | None = None) -> DataFrame:
    """One row for each Spark partition that has records, p its number, of rows where they stand: nothing is shuffled or sorted.

    Only keys (the record's first bytes, or those of the expression given) and CRCs, made natively, go to the Python worker.
    """
    arrow = pa.schema([("p", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("record_count", pa.int64()), ("duplicate_count", pa.int64()), ("unordered_count", pa.int64()), ("checksum", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Running()
        for batch in batches:
            _, offsets, data = batch.column(0).buffers()
            if batch.num_rows:
                at = np.frombuffer(offsets, np.int32)[batch.column(0).offset :][: batch.num_rows + 1]
                if batch.column(0).null_count or (np.diff(at) != KEY_BYTES).any():
                    raise ValueError("a record is too short for a key")
                keys = np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, KEY_BYTES)
                seen.add(keys, batch.column(1).to_numpy(zero_copy_only=False))
        if seen.count:
            yield pa.RecordBatch.from_pylist([seen.row(TaskContext.get().partitionId())], schema=arrow)

    rows = records.select((key_of(F.col(record)) if key is None else key).alias("key"), crc(F.col(record)).alias("crc"))
    return rows.mapInArrow(run, SUMMARY)


def merged_rows(rows: list[dict]) -> dict:
    """merged() of summaries that are at hand already, one for each partition."""
    rows = sorted((r for r in rows if r["record_count"]), key=lambda r: r["p"])
    out = {"first_key": rows[0]["first_key"] if rows else None, "last_key": rows[-1]["last_key"] if rows else None}
    out |= {c: sum(int(r[c]) for r in rows) for c in ("checksum", "record_count", "duplicate_count", "unordered_count")}
    for a, b in zip(rows, rows[1:], strict=False):
        out["duplicate_count"] += a["last_key"] == b["first_key"]
        out["unordered_count"] += a["last_key"] > b["first_key"]
    return out


def summary_text(summary: DataFrame) -> DataFrame:
    """A readable summary as one column, line: what summary_line gives, on a frame."""
    named = [("first key", "first_key"), ("last key", "last_key"), ("checksum", "checksum"), *((c.replace("_", " "), c) for c in ("record_count", "duplicate_count", "unordered_count"))]
    return summary.select(F.concat_ws(", ", *[F.concat(F.lit(f"{text}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for text, c in named]).alias("line"))


def summary_line(row: dict) -> str:
    """A summary as a line of text."""
    key = lambda k: bytes(k).hex() if k is not None and not isinstance(k, str) else k
    total = row["checksum"]
    return f"first key: {key(row['first_key'])}, last key: {key(row['last_key'])}, checksum: {total if isinstance(total, str) else format(int(total or 0), 'x')}, record count: {row['record_count']}, duplicate count: {row['duplicate_count']}, unordered count: {row['unordered_count']}"
