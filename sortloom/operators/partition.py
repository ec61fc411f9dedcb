"""Equal-width range partitions: the 24-bit prefixes of keys cut into N ranges of equal width.

Boundaries come from arithmetic, not from a sample, so no pass over the data comes first and any two
runs agree. Equal keys share a partition, and partitions in order hold ascending keys. Keys crowded
into few prefixes crowd into few partitions; for those, by_sample() trades fixed boundaries for even ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.functions.record import PREFIXES, prefix24


def checked_count(n: int) -> int:
    if not 1 <= n <= PREFIXES:
        raise ValueError(f"the number of partitions must be between 1 and {PREFIXES}")
    return n


def partition_of_prefix(prefix: Column, n: int) -> Column:
    """How many split points are at most the prefix: ceil((k + 1) * n / 2**24) - 1, in integers."""
    checked_count(n)
    scaled = (prefix.cast("bigint") + 1) * n + (PREFIXES - 1)
    return (F.shiftright(scaled, 24) - 1).cast("int")


def partition_of(key: Column, n: int) -> Column:
    return partition_of_prefix(prefix24(key), n)


def split_points(spark: SparkSession, n: int) -> DataFrame:
    """i, prefix: the lower boundary of partition i, for i = 1..n-1."""
    checked_count(n)
    return spark.range(1, n).select(F.col("id").alias("i"), F.expr(f"id * {PREFIXES} div {n}").alias("prefix"))


def equal_width(records: DataFrame, n: int, key: str | Column = "key", p: str = "p") -> DataFrame:
    """The records with their partition's number p, each in the partition of that number: one shuffle of the rows as they are.

    A key given as an expression isn't shuffled beside what it is taken from.
    """
    key = F.col(key) if isinstance(key, str) else key
    placed = records.withColumn(p, F.when(key.isNotNull(), partition_of(key, n)).otherwise(F.raise_error(F.lit("a record without a key"))))
    return placed.repartitionById(n, p)


def by_sample(records: DataFrame, n: int, key: str | Column = "key") -> DataFrame:
    """An extension for skewed keys: boundaries from a sample of the keys. Equal keys still share a partition."""
    return records.repartitionByRange(n, key)


def histogram(records: DataFrame, n: int, key: str = "key") -> DataFrame:
    """p, records for every partition, empty ones too."""
    counts = records.select(partition_of(F.col(key), n).alias("p")).groupBy("p").agg(F.count("*").alias("records"))
    every = records.sparkSession.range(n).select(F.col("id").cast("int").alias("p"))
    return every.join(counts, "p", "left").select("p", F.coalesce("records", F.lit(0)).alias("records"))
