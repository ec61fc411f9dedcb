"""Sorting: within each partition by unsigned key, and so, over equal-width partitions, as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortloom.operators.partition import equal_width

#: Bits of a row's number within its partition in the numbers that Spark gives rows where they stand.
ROW_BITS = 33


def sort_partitions(records: DataFrame, key: str | Column = "key", p: str = "p", ties: tuple[str, ...] = ()) -> DataFrame:
    """Each partition's records in ascending order of key."""
    return records.sortWithinPartitions(p, key, *ties)


def sort_records(records: DataFrame, n: int, key: str | Column = "key", ties: tuple[str, ...] = ()) -> DataFrame:
    """The whole sort: one shuffle into n ordered partitions, each sorted. Records with equal keys are in any order unless ties are named.

    A key given as an expression isn't shuffled beside what it is taken from.
    """
    return sort_partitions(equal_width(records, n, key), key, "p", ties)


def with_place(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The place, from 0, at which a row physically stands in its partition, whatever its key: no window, so no second sort."""
    return ordered.withColumn(name, F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1))


def ranked(ordered: DataFrame, rank: str = "rank") -> DataFrame:
    """Rank from 0 of each row in the order of partitions and of rows within them.

    The number of rows before each partition comes from a running sum over one row for each partition.
    """
    counts = ordered.groupBy("p").agg(F.count("*").alias("rows"))
    before = counts.select(F.col("p").alias("q"), (F.sum("rows").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return with_place(ordered, "within").join(F.broadcast(before), F.col("p") == F.col("q")).withColumn(rank, F.coalesce("before", F.lit(0)) + F.col("within")).drop("q", "before", "within")
