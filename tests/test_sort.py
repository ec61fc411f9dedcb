"""Order, validation (with defects planted) and plans."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sortloom.functions import record as R
from sortloom.operators import sort as S
from sortloom.operators import validate as V
from sortloom.operators.partition import equal_width
from sortloom.plans import queries
from sortloom.plans.job import Job
from sortloom.sources import gensort as G


def keyed(rows):
    return rows.select(R.key_of(F.col("record")).alias("key"), "record")


def generated(spark, n):
    return keyed(G.generate(spark, n, partitions=3))


def summary(rows):
    return V.readable(V.merged(V.partition_summaries(rows))).first().asDict()


def test_sorted_records_have_the_known_digest(spark):
    rows = [bytes(r["record"]) for r in S.sort_records(generated(spark, 1000), 8).collect()]
    assert hashlib.sha256(b"".join(rows)).hexdigest() == "29f4ddc39cf4122053e56991184333800d08e15d471c81c9f370105e94144cdf"
    assert rows == sorted(rows, key=lambda r: r[:10])


def test_summary_of_a_hundred_thousand(spark):
    want = {"first_key": "000066fc34d9bc9d51e1", "last_key": "ffff52690a350ed9bc1c", "checksum": "c327a1c42c28", "record_count": 100000, "duplicate_count": 0, "unordered_count": 0}
    for n in (1, 8, 13):
        assert summary(S.sort_records(generated(spark, 100_000), n)) == want


def test_observed_in_the_same_pass_as_the_write(spark):
    seen = Job(8, input_count=100_000).run(spark)
    assert seen["record_count"] == 100_000 and seen["unordered_count"] == 0 and int(seen["checksum"]) == 0xC327A1C42C28
    assert V.summary_line(seen) == "first key: 000066fc34d9bc9d51e1, last key: ffff52690a350ed9bc1c, checksum: c327a1c42c28, record count: 100000, duplicate count: 0, unordered count: 0"


def test_disorder_is_found_where_rows_stand(spark):
    placed = equal_width(generated(spark, 1000), 8)
    good = summary(S.sort_partitions(placed))
    unsorted = summary(placed)
    falling = summary(placed.sortWithinPartitions("p", F.desc("key")))
    assert good["unordered_count"] == 0 < unsorted["unordered_count"] and falling["unordered_count"] == 992
    assert good["checksum"] == unsorted["checksum"] == falling["checksum"]


def test_duplicates_and_changes_show(spark):
    rows = generated(spark, 1000)
    one = rows.limit(1)
    good, twice = summary(S.sort_records(rows, 8)), summary(S.sort_records(rows.union(one), 8))
    assert twice["duplicate_count"] == 1 and twice["record_count"] == 1001 and twice["checksum"] != good["checksum"]
    flipped = rows.select("key", F.when(F.col("key") == F.lit(bytes.fromhex("4a696d47726179524950")), F.concat(F.substring("record", 1, 99), F.lit(b"!"))).otherwise(F.col("record")).alias("record"))
    changed = summary(S.sort_records(flipped, 8))
    assert changed["checksum"] != good["checksum"] and changed["duplicate_count"] == 0 and changed["unordered_count"] == 0


def test_boundaries(spark):
    parts = [(0, b"\x01", b"\x05", 3, 0, 0, 7), (2, b"\x05", b"\x09", 2, 0, 0, 7), (3, b"\x08", b"\x0a", 2, 0, 0, 7)]
    rows = spark.createDataFrame([(p, bytearray(a), bytearray(b), n, d, u, Decimal(c)) for p, a, b, n, d, u, c in parts], "p int, first_key binary, last_key binary, record_count long, duplicate_count long, unordered_count long, checksum decimal(38,0)")
    got = V.merged(rows).first()
    assert (got["duplicate_count"], got["unordered_count"], got["record_count"], bytes(got["first_key"]), bytes(got["last_key"]), int(got["checksum"])) == (1, 1, 7, b"\x01", b"\x0a", 21)
    assert [(r["repeats"], r["descends"]) for r in V.boundaries(rows).orderBy("p").collect()] == [(False, False), (True, False), (False, True)]


def test_empty_input_and_more_partitions_than_records(spark):
    assert summary(S.sort_records(generated(spark, 5), 64))["record_count"] == 5
    none = summary(S.sort_records(generated(spark, 0), 4))
    assert (none["record_count"], none["first_key"], none["checksum"]) == (0, None, "0")


def test_rank(spark):
    rows = S.ranked(S.sort_records(generated(spark, 500), 8)).select("key", "rank").collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: bytes(r["key"]))] == list(range(500))


def moved_and_sorted(rows):
    """(how often a plan shuffles records, how often it sorts them); a window over one row a partition may stand above."""
    plan = [x.strip(" +-:*()0123456789") for x in rows._jdf.queryExecution().executedPlan().toString().splitlines()]
    return sum(x.startswith("Exchange") and "SinglePartition" not in x for x in plan), sum(x.startswith("Sort [") and ("record#" in x or "key#" in x or "s#" in x) for x in plan)


def test_one_shuffle_and_one_sort(spark):
    ordered = S.sort_records(generated(spark, 10), 8)
    for rows in (V.partition_summaries(Job(8, input_count=1000).plan(spark)), V.partition_summaries(ordered), V.boundaries(V.partition_summaries(ordered)), S.with_place(ordered)):
        assert moved_and_sorted(rows) == (1, 1)


@pytest.mark.parametrize("name", ["validate_partitions", "validate_global", "partition_boundaries", "duplicate_keys", "storage_sum_of_checksums", "sort_within_partition", "summary_line"])
def test_queries_sort_their_records_once(spark, name):
    assert moved_and_sorted(queries.queries()[name](spark, "/root/testdata/sf0.001")) == (1, 1)


def test_a_sampled_sort_is_in_order(spark):
    seen = Job(5, input_count=3000, sampled=True).run(spark)
    assert (seen["record_count"], seen["unordered_count"], seen["duplicate_count"]) == (3000, 0, 0) and V.summary_line(seen) == V.summary_line(Job(5, input_count=3000).run(spark))


def test_summaries_at_hand_merge_as_the_frame_does(spark):
    for n in (0, 1, 3000):
        parts = V.partition_summaries(generated(spark, n).repartition(3))
        rows = [r.asDict() for r in parts.collect()]
        assert V.summary_line(V.merged_rows(rows)) == V.summary_line(V.merged(spark.createDataFrame(rows, V.SUMMARY)).first().asDict())


def test_an_order_that_is_broken_shows_in_the_observation(spark):
    """Rows whose partition claims the order of another column: keys fall, and the window sees them fall."""
    rows = spark.createDataFrame([(0, bytearray(bytes([9 - i] * 10)), bytearray(100)) for i in range(10)], "p int, key binary, record binary").coalesce(1)
    got = V.partition_summaries(rows, key=F.col("key")).first()
    assert (got["unordered_count"], got["duplicate_count"]) == (9, 0)


def test_summaries_equal_a_window_over_the_places(spark):
    rows = S.sort_records(generated(spark, 3000), 8)
    w = Window.partitionBy("p").orderBy("place")
    placed = S.with_place(rows).withColumn("prev", F.lag("key").over(w))
    plain = placed.groupBy("p").agg(F.min_by("key", "place").alias("first_key"), F.max_by("key", "place").alias("last_key"), F.sum(R.crc(F.col("record")).cast("decimal(28,0)")).alias("checksum"), F.count("*").alias("record_count"), F.count_if(F.col("prev") == F.col("key")).alias("duplicate_count"), F.count_if(F.col("prev") > F.col("key")).alias("unordered_count"))
    pick = lambda df: [tuple(map(str, r)) for r in V.readable(df).select("p", "first_key", "last_key", "record_count", "duplicate_count", "unordered_count", "checksum").orderBy("p").collect()]
    assert pick(V.partition_summaries(rows)) == pick(plain)
    mixed = generated(spark, 3000).repartition(3)
    seen = V.merged(V.partition_summaries(mixed)).first()
    assert seen["record_count"] == 3000 and seen["unordered_count"] > 1000
    assert V.merged(V.partition_summaries(generated(spark, 0))).first()["record_count"] == 0
