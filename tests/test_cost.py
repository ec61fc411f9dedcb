"""The cost query, and gauges as a stream."""

import socket
import threading
import time

from pyspark.sql import functions as F

from sortloom.plans import cost
from sortloom.streaming import gauges


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "n long, line string")


def line(t, task, value, op="DataSink (out)", gauge="numRecordsIn"):
    return f"{t} host1.x.tm1.sort.{op}.{task}.{gauge}:{value}|g"


def samples(spark, rows):
    return cost.last_writes(cost.sink_records(cost.parsed(lines(spark, rows), order="n")), "n")


def test_worked_example(spark):
    rows = [line(10, 1, 1), line(20, 1, 3), line(50, 2, 2), line(5, 3, 9, op="Map"), line(5, 1, 9, gauge="other"), "noise", ""]
    got = cost.byte_seconds(samples(spark, rows), 700, 0.0, 100.0).first()
    assert (got["seen_bytes"], got["output_byte_seconds"], got["byte_seconds"]) == (500, 48000.0, 138000.0)


def test_last_write_of_a_time_wins_and_no_samples(spark):
    got = samples(spark, [line(10, 1, 1), line(10, 1, 4)]).collect()
    assert [(r["task_number"], r["time"], r["bytes"]) for r in got] == [("1", 10.0, 400)]
    none = cost.byte_seconds(samples(spark, ["noise"]), 700, 0.0, 100.0).first()
    assert (none["seen_bytes"], none["byte_seconds"]) == (0, 140000.0)


def test_cost_rounds_up_to_cents(spark):
    cents = lambda x: spark.range(1).select(cost.cents_up(F.lit(x))).first()[0]
    assert cents(7.581) == 7.59 and cents(7.0) == 7.0
    month = spark.range(1).select(cost.month_cost(F.lit(float(2**30) * 30 * 86400), 0.024)).first()[0]
    assert abs(month - 0.024) < 1e-12


def test_stream_counts_each_task_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join([line(1, 1, 10), line(2, 1, 30), line(1, 2, 5), "noise"]) + "\n")
    query = gauges.records_written(gauges.gauge_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("written").start()
    try:
        query.processAllAvailable()
        (folder / "b.log").write_text(line(3, 2, 50) + "\n" + line(1, 1, 20) + "\n")
        query.processAllAvailable()
        assert sorted((r["task_number"], r["records"]) for r in spark.table("written").collect()) == [("1", 30), ("2", 50)]
    finally:
        query.stop()


def test_listener_writes_what_arrives(tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    done = []
    thread = threading.Thread(target=lambda: done.append(gauges.listen(port, str(tmp_path), stop_after=2.0)))
    thread.start()
    time.sleep(0.5)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(f"h.x.t.j.DataSink.{i}.numRecordsIn:{i}|g".encode(), ("127.0.0.1", port))
    thread.join()
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("*.log")))
    assert done == [3] and text.count("numRecordsIn") == 3
