"""Gauge lines as a stream: files that a metrics listener appends to a folder, or the lines of a socket."""

from __future__ import annotations

import socket
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.plans.cost import parsed, sink_records


def gauge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed gauges of the text files in a folder, as they come."""
    lines = spark.readStream.schema("value string").text(folder).withColumnRenamed("value", "line")
    return parsed(lines)


def records_written(gauges: DataFrame) -> DataFrame:
    """Per task the highest count that its sink has reported: counts only grow, so late lines do no harm."""
    return sink_records(gauges).groupBy("task_number").agg(F.max("gauge_value").alias("records"), F.max("time").alias("time"))


def listen(port: int, folder: str, stop_after: float | None = None, roll: int = 1000, host: str = "") -> int:
    """Writes gauges that arrive by UDP to files of `roll` lines in a folder, each line with the time before it; the number of lines.

    host: the address to listen at; all of this machine's, unless named.
    """
    out, lines, n, ends = Path(folder), [], 0, None if stop_after is None else time.time() + stop_after
    out.mkdir(parents=True, exist_ok=True)

    def flush() -> None:
        if lines:
            part = out / f".{n:012d}.part"
            part.write_text("".join(lines))
            part.rename(out / f"{n:012d}.log")  # whole files only become visible
            lines.clear()

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind((host, port))
        s.settimeout(0.2)
        while ends is None or time.time() < ends:
            try:
                payload = s.recv(65536)
            except TimeoutError:
                flush()
                continue
            lines += [f"{time.time():.6f} {x}\n" for x in payload.decode(errors="replace").splitlines() if x]
            n += 1
            if len(lines) >= roll:
                flush()
    flush()
    return n
