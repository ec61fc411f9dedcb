"""Storage cost from metrics: how many byte-seconds the objects of a run took up, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: `<epoch seconds> <host>.<x>.<tm_id>.<job>.<operator>.<task>.<gauge>:<value>|<type>`
GAUGE_FIELDS = ("host", "x", "tm_id", "job_name", "op_name", "task_number", "gauge_name")
RECORD_BYTES = 100
MONTH_SECONDS = 30 * 86400


def parsed(lines: DataFrame, line: str = "line", order: str | None = None) -> DataFrame:
    """Gauge lines as columns. Lines that aren't such gauges are dropped."""
    pattern = r"^(\S+) ([^.\s]+)\.([^.]+)\.([^.]+)\.([^.]+)\.([^.]+)\.([^.]+)\.([^.:]+):(-?[0-9]+)\|(\S+)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    columns = [part(1).cast("double").alias("time"), *[part(i + 2).alias(f) for i, f in enumerate(GAUGE_FIELDS)], part(9).cast("bigint").alias("gauge_value"), part(10).alias("gauge_type")]
    return lines.where(F.rlike(line, F.lit(pattern))).select(*columns, *([order] if order else []))


def sink_records(gauges: DataFrame) -> DataFrame:
    """Only the gauges that count what sinks took in."""
    return gauges.where(F.startswith("op_name", F.lit("DataSink")) & (F.col("gauge_name") == "numRecordsIn"))


def last_writes(gauges: DataFrame, order: str) -> DataFrame:
    """task_number, time, bytes: of several values of a task at a time the last one in the log."""
    return gauges.groupBy("task_number", "time").agg((F.max_by("gauge_value", order) * RECORD_BYTES).alias("bytes"))


def byte_seconds(samples: DataFrame, total_bytes: int, start: float, stop: float) -> DataFrame:
    """One row: seen_bytes, output_byte_seconds, missing_byte_seconds, input_byte_seconds, byte_seconds.

    What a task has added since its last sample is charged from that sample (or the start) to the stop; bytes
    that no sample shows, and the whole input, are charged for the whole run.
    """
    w = Window.partitionBy("task_number").orderBy("time")
    grown = F.col("bytes") - F.lag("bytes", 1, 0).over(w)
    since = F.lit(float(stop)) - F.coalesce(F.lag("time").over(w), F.lit(float(start)))
    sums = samples.select(grown.alias("grown"), (grown * since).alias("charge")).agg(F.coalesce(F.sum("grown"), F.lit(0)).alias("seen_bytes"), F.coalesce(F.sum("charge"), F.lit(0.0)).alias("output_byte_seconds"))
    run = float(stop) - float(start)
    missing, whole = (F.lit(total_bytes) - F.col("seen_bytes")) * run, F.lit(total_bytes * run)
    return sums.select("seen_bytes", "output_byte_seconds", missing.alias("missing_byte_seconds"), whole.alias("input_byte_seconds"), (F.col("output_byte_seconds") + missing + whole).alias("byte_seconds"))


def month_cost(byte_seconds: Column, price: float) -> Column:
    """Byte-seconds at a price for a GiB-month of 30 days."""
    return byte_seconds * price / F.lit(float(1 << 30)) / F.lit(float(MONTH_SECONDS))


def cents_up(cost: Column) -> Column:
    """Rounded up to whole cents."""
    return F.ceil(cost * 100) / 100


def storage_cost(samples: DataFrame, total_bytes: int, start: float, stop: float, price: float) -> DataFrame:
    rows = byte_seconds(samples, total_bytes, start, stop)
    return rows.select("byte_seconds", cents_up(month_cost(F.col("byte_seconds"), price)).alias("cost"))
