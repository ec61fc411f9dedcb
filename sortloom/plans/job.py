"""The sort job: source, equal-width partitions, sort, validation in the same pass, sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.functions.record import crc, key_of
from sortloom.operators.partition import by_sample, equal_width
from sortloom.operators.validate import merged_rows, partition_summaries, summary_line
from sortloom.sources import fixedrec, gensort


@dataclass
class Job:
    """What to sort, into how many partitions, and where to.

    Exactly one of input_path and input_count is given; without output_path the records are discarded. sampled: boundaries
    from a sample of the keys, for keys that crowd into few prefixes, in place of equal widths.
    """

    partitions: int
    input_path: str | None = None
    input_count: int | None = None
    output_path: str | None = None
    sampled: bool = False
    reader: dict = field(default_factory=dict)
    writer: dict = field(default_factory=dict)

    def source(self, spark: SparkSession) -> DataFrame:
        if (self.input_path is None) == (self.input_count is None):
            raise ValueError("give either an input path or a number of records to generate")
        if self.input_path is not None:
            return fixedrec.read(spark, self.input_path, **self.reader)
        return gensort.generate(spark, self.input_count, partitions=self.reader.get("numPartitions")).select("record")

    def plan(self, spark: SparkSession) -> DataFrame:
        """record, p in order: one shuffle of the records, and no other.

        Within a partition the key alone orders the rows (p follows from it), so that the sort compares by the
        first eight bytes of the key and rarely looks at a row; keys are taken from the records behind the shuffle.
        """
        key = key_of(F.col("record"))
        placed = by_sample(self.source(spark), self.partitions, key) if self.sampled else equal_width(self.source(spark), self.partitions, key)
        return placed.sortWithinPartitions(key)

    def run(self, spark: SparkSession) -> dict:
        """Does it; the summary of what was written, made in the pass that writes."""
        rows = self.plan(spark)
        if self.output_path is None:
            return merged_rows([r.asDict() for r in partition_summaries(rows).collect()])  # a row for each partition
        fixedrec.write(rows.withColumn("crc", crc(F.col("record"))), self.output_path, **self.writer)
        return merged_rows(fixedrec.summaries(self.output_path))


def run_and_print(spark: SparkSession, job: Job) -> dict:
    summary = job.run(spark)
    print(summary_line(summary))
    return summary


def chunk_manifest(placed: DataFrame, chunk_bytes: int, record_bytes: int = 100, prefix: str = "") -> DataFrame:
    """p, chunk, object_name, records, bytes of the objects that a write in chunks makes of partitions p.

    Only counts are needed: chunks are cut from the number of rows in each partition, so no row is numbered or moved.
    """
    size = max(record_bytes, chunk_bytes // record_bytes * record_bytes) // record_bytes
    counts = placed.groupBy("p").agg(F.count("*").alias("n"))
    chunks = counts.select("p", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / size))).alias("chunk"))
    records = F.least(F.lit(size).cast("bigint"), F.col("n") - F.col("chunk") * size)
    name = F.concat(F.lit(prefix), F.col("p").cast("string"), F.lit("/"), F.col("chunk").cast("string"))
    return chunks.select("p", "chunk", name.alias("object_name"), records.alias("records"), (records * record_bytes).alias("bytes"))


def total_bytes(objects: DataFrame) -> DataFrame:
    """objects, bytes of a listing."""
    return objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("object_size"), F.lit(0)).alias("bytes"))
