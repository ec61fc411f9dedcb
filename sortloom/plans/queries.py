"""The queries by name, and the same results in DuckDB's SQL.

Records are made from lineitem: s = orderkey-linenumber-partkey-suppkey, the key the first ten bytes of md5(s), the
record the key's 20 hexadecimal digits and s padded to 80 characters: 100 bytes of ASCII. Results hold
strings and numbers, no bytes, so that the two engines' values compare.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.functions import record as R
from sortloom.operators import partition as P
from sortloom.operators import sort as S
from sortloom.operators import validate as V
from sortloom.plans import cost, job
from sortloom.sources import fixedrec, gensort

PARTS, CHUNK = 8, 250_000


def lineitem_text() -> tuple[Column, Column]:
    """(s, the key's 20 hexadecimal digits)."""
    s = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return s, F.substring(F.md5(s), 1, 20)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """key (10 bytes), record (100 bytes)."""
    s, digits = lineitem_text()
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.unhex(digits).alias("key"), F.encode(F.concat(digits, F.rpad(s, 80, " ")), "utf-8").alias("record"))


def key_column() -> Column:
    """The key, from such a record: it isn't shuffled beside it."""
    return F.unhex(F.substring(F.decode("record", "utf-8"), 1, 20))


def ordered(spark: SparkSession, sf: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """record, p in order."""
    return S.sort_records(records(spark, sf).select("record"), PARTS, key_column(), ties)


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return V.partition_summaries(ordered(spark, sf), key=key_column())


def record_encode(spark, sf):
    text = F.decode("record", "utf-8")
    rows = records(spark, sf).select(R.hex_of(F.col("key")).alias("key"), text.alias("record"), R.value_of(F.col("record")).alias("v"), F.octet_length("record").cast("bigint").alias("bytes"))
    return rows.select("key", "record", F.decode("v", "utf-8").alias("value"), "bytes")


def split_points(spark, sf):
    return P.split_points(spark, 1000)


def partition_assign(spark, sf):
    key = F.col("key")
    return records(spark, sf).select(R.hex_of(key).alias("key"), R.prefix24(key).alias("prefix"), *[P.partition_of(key, n).cast("bigint").alias(f"p{n}") for n in (3, 8, 1000, 1024)])


def partition_histogram(spark, sf):
    return P.histogram(records(spark, sf), 1024).select(F.col("p").cast("bigint").alias("p"), "records")


def sort_global_rank(spark, sf):
    rows = S.ranked(ordered(spark, sf, ("record",)))
    return rows.select(R.hex_of(key_column()).alias("key"), F.trim(F.decode(R.value_of(F.col("record")), "utf-8")).alias("rest"), F.col("rank").cast("bigint").alias("rank"))


def sort_within_partition(spark, sf):
    rows = S.with_place(ordered(spark, sf, ("record",)))
    return rows.select(F.col("p").cast("bigint").alias("p"), (F.col("place") + 1).alias("place"), R.hex_of(key_column()).alias("key"))


def record_crc32(spark, sf):
    return records(spark, sf).select(R.hex_of(F.col("key")).alias("key"), R.crc(F.col("record")).alias("crc"))


def validate_partitions(spark, sf):
    rows = summaries(spark, sf)
    return rows.select(F.col("p").cast("bigint").alias("p"), *[R.hex_of(F.col(c)).alias(c) for c in ("first_key", "last_key")], "record_count", "duplicate_count", "unordered_count", F.col("checksum").cast("bigint").alias("checksum"))


def validate_global(spark, sf):
    return V.readable(V.merged(summaries(spark, sf)))


def partition_boundaries(spark, sf):
    rows = V.boundaries(summaries(spark, sf))
    return rows.select(F.col("p").cast("bigint").alias("p"), R.hex_of(F.col("previous_last")).alias("previous_last"), R.hex_of(F.col("first_key")).alias("first_key"), "repeats", "descends")


def short_records(spark, sf):
    """Keys of order and line number only, which repeat."""
    s = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.unhex(F.substring(F.md5(s), 1, 20)).alias("key"), F.encode(s, "utf-8").alias("record"))


def duplicate_keys(spark, sf):
    """Counted in the sorted stream, key by key against the one before."""
    rows = V.merged(V.partition_summaries(S.sort_records(short_records(spark, sf), PARTS), key=F.col("key")))
    return rows.select("record_count", "duplicate_count")


def checksum_hex(spark, sf):
    """Of records counted a thousand million times over: more than 64 bits."""
    total = records(spark, sf).agg(R.crc_sum(F.col("record")).alias("t"))
    return total.select(R.u128_hex(F.col("t")).alias("checksum"), R.u128_hex((F.col("t") * 1_000_000_000).cast("decimal(38,0)")).alias("large"))


def chunk_manifest(spark, sf):
    rows = job.chunk_manifest(records(spark, sf).select(P.partition_of(F.col("key"), PARTS).alias("p")), CHUNK, prefix="out/")
    return rows.select(F.col("p").cast("bigint").alias("p"), "chunk", "object_name", "records", "bytes")


def gensort_binary(spark, sf):
    rows = gensort.generate(spark, 1000, partitions=3)
    return rows.select(F.col("n").cast("bigint").alias("n"), R.hex_of(R.key_of(F.col("record"))).alias("key"), R.hex_of(F.col("record")).alias("record"))


def gensort_ascii(spark, sf):
    rows = gensort.generate(spark, 1000, ascii_form=True, partitions=3)
    return rows.select(F.col("n").cast("bigint").alias("n"), F.decode(R.key_of(F.col("record")), "utf-8").alias("key"), R.hex_of(F.col("record")).alias("record"))


def gensort_skip_ahead(spark, sf):
    rows = gensort.generate(spark, 500, start=2000, partitions=4)
    return rows.select(F.col("n").cast("bigint").alias("n"), R.hex_of(R.key_of(F.col("record"))).alias("key"))


def split_alignment(spark, sf):
    """By the function that the reader cuts files with."""
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("start"), (F.col("id") * 53 % 700).alias("length"))
    first, size = fixedrec.aligned(F.col("start"), F.col("length"))
    return rows.select("start", "length", first.alias("first"), size.alias("bytes"))


def scratch(spark: SparkSession) -> str:
    """A folder for files that are written and read again: shared on a cluster, temporary in a single process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/fixedrec-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="fixedrec-")


def fixedrec_roundtrip(spark, sf):
    path = scratch(spark)
    fixedrec.write(ordered(spark, sf), path, chunk_bytes=CHUNK)
    rows = fixedrec.read(spark, path, split_bytes=100_050)
    return rows.select(F.decode("record", "utf-8").alias("record"))


def gauges(spark, sf) -> DataFrame:
    """Lines made from events, of sinks and others, with a task's counts growing over time; n their order."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    at, task = F.col("event_id") % 500, F.col("event_id") % 16
    op = F.when(F.col("event_id") % 5 == 0, "Map").otherwise("DataSink (out)")
    line = F.concat(at.cast("string"), F.lit(" host"), (task % 4).cast("string"), F.lit(".x.tm"), (task % 4).cast("string"), F.lit(".sort."), op, F.lit("."), task.cast("string"), F.lit(".numRecordsIn:"), (at * 10 + task).cast("string"), F.lit("|g"))
    return e.select(F.col("event_id").alias("n"), line.alias("line"))


def gauge_parse(spark, sf):
    return cost.sink_records(cost.parsed(gauges(spark, sf), order="n"))


def storage(spark, sf) -> DataFrame:
    return cost.last_writes(cost.sink_records(cost.parsed(gauges(spark, sf), order="n")), "n")


def storage_byte_seconds(spark, sf):
    return cost.byte_seconds(storage(spark, sf), 10_000_000, 0.0, 600.0)


def storage_cost(spark, sf):
    return cost.storage_cost(storage(spark, sf), 10**13, 0.0, 600.0, 0.024)


def key_hash43(spark, sf):
    return records(spark, sf).select(R.hex_of(F.col("key")).alias("key"), R.key_hash43(F.col("key")).cast("bigint").alias("hash"))


def normalized_key(spark, sf):
    return records(spark, sf).select(R.hex_of(F.col("key")).alias("key"), *[R.hex_of(R.normalized_key(F.col("key"), n)).alias(f"n{n}") for n in (4, 10, 16)])


def object_listing(spark, sf):
    path = scratch(spark)
    fixedrec.write(ordered(spark, sf), path, chunk_bytes=CHUNK)
    names = fixedrec.listing(spark, path)
    return names.select("split_number", F.substring_index("object_name", "/", -2).alias("object_name"), "object_size")


def total_bytes(spark, sf):
    path = scratch(spark)
    fixedrec.write(ordered(spark, sf), path, chunk_bytes=CHUNK)
    return job.total_bytes(fixedrec.listing(spark, path))


def u128_numbers(spark, sf):
    """Decimal and hexadecimal digits to numbers and back, and digits by place."""
    digits = F.concat(F.col("l_orderkey").cast("string"), F.lit("00000000000000"), F.col("l_partkey").cast("string"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(digits.alias("digits"))
    rows = rows.select("digits", R.u128_of_decimal(F.col("digits")).alias("x")).withColumn("hex", R.u128_hex(F.col("x")))
    key = F.unhex(F.lpad("hex", 32, "0"))
    return rows.select("digits", "hex", R.u128_of_hex(F.col("hex")).cast("string").alias("back"), R.byte_at(key, 15).cast("bigint").alias("last_byte"), R.hex_digit(key, 31).alias("last_digit"))


def storage_sum_of_checksums(spark, sf):
    """Checksums add up over files: the sum of the partitions' checksums, read back from hexadecimal digits."""
    parts = V.readable(summaries(spark, sf))
    return parts.agg(R.u128_hex(F.sum(R.u128_of_hex(F.col("checksum"))).cast("decimal(38,0)")).alias("checksum"))


def key_order(spark, sf):
    """Each key against the next line's key and against itself: order, and equality of records by their keys."""
    s, digits = lineitem_text()
    other = F.substring(F.md5(F.concat(s, F.lit("+"))), 1, 20)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(digits.alias("key"), other.alias("other"))
    a, b = F.unhex("key"), F.unhex("other")
    record = lambda k, filler: F.concat(k, F.lit(filler * R.VALUE_BYTES))
    return rows.select("key", "other", R.key_compare(a, b).cast("bigint").alias("order"), R.key_compare(b, a).cast("bigint").alias("back"), R.key_compare(a, a).cast("bigint").alias("own"), R.same_key(record(a, b"x"), record(b, b"x")).alias("same"), R.same_key(record(a, b"x"), record(a, b"y")).alias("same_key"))


def u128_arithmetic(spark, sf):
    """Sums, products and shifts that wrap at 128 bits, and halves."""
    s, _ = lineitem_text()
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.md5(s).alias("a"), F.md5(F.reverse(s)).alias("b"), (F.col("l_linenumber") * 23 + F.col("l_suppkey") % 7).cast("int").alias("n"))
    x, y = R.wide_of_hex(F.col("a")), R.wide_of_hex(F.col("b"))
    return rows.select("a", "b", F.col("n").cast("bigint").alias("n"), R.wide_hex(R.wide_add(x, y)).alias("plus"), R.wide_hex(R.wide_multiply(x, y)).alias("times"), R.wide_hex(R.wide_shift_left(x, F.col("n"))).alias("shifted"), R.wide_half(x, True).alias("high"), R.wide_half(x, False).alias("low"))


def generator_checksum(spark, sf):
    """Of records made in both forms."""
    total = lambda form: gensort.generate(spark, 1000, ascii_form=form, partitions=3).agg(R.u128_hex(R.crc_sum(F.col("record"))).alias("checksum"))
    return total(False).select(F.lit("binary").alias("form"), "checksum").union(total(True).select(F.lit("ascii"), "checksum"))


def summary_line(spark, sf):
    """What the job prints."""
    return V.summary_text(V.readable(V.merged(summaries(spark, sf))))


def discarded_sort(spark, sf):
    """The summary of a job that makes, sorts and discards records."""
    seen = job.Job(PARTS, input_count=1000).run(spark)
    return spark.createDataFrame([(bytes(seen["first_key"]).hex(), bytes(seen["last_key"]).hex(), format(seen["checksum"], "x"), seen["record_count"], seen["duplicate_count"], seen["unordered_count"])], "first_key string, last_key string, checksum string, record_count long, duplicate_count long, unordered_count long")


# ---- SQL -----------------------------------------------------------------------------------------------------


def _crc_table() -> str:
    """The 256 entries of the CRC-32 table, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"([{', '.join(map(str, out))}]::BIGINT[])"


REC = """l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS s FROM lineitem),
r AS (SELECT substr(md5(s), 1, 20) AS key, substr(md5(s), 1, 20) || rpad(s, 80, ' ') AS rec, ('0x' || substr(md5(s), 1, 6))::BIGINT AS k FROM l)"""


def _p(n: int) -> str:
    return f"((k + 1) * {n} + 16777215) // 16777216 - 1"


def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1])))"


VALIDATED = f"""{REC}, o AS (SELECT {_p(PARTS)} AS p, key, rec, lag(key) OVER (PARTITION BY {_p(PARTS)} ORDER BY key) AS prev FROM r),
v AS (SELECT p, min(key) AS first_key, max(key) AS last_key, count(*) AS record_count, count(*) FILTER (prev = key) AS duplicate_count, count(*) FILTER (prev > key) AS unordered_count, sum({_crc("rec")}) AS checksum FROM o GROUP BY p)"""


def _limbs(x: int) -> list[int]:
    return [x >> 32 * i & 0xFFFFFFFF for i in range(4)]


def _generated(last: int) -> str:
    """n and the random number's four limbs of 32 bits, lowest first, by steps of the generator."""
    a, c = _limbs(gensort.A), _limbs(gensort.C)
    t = [" + ".join(f"x{i} * {a[j - i]}::HUGEINT" for i in range(j + 1)) + f" + {c[j]}" for j in range(4)]
    s = ["(" + t[0] + ")"]
    for j in range(1, 4):
        s.append(f"({t[j]} + ({s[j - 1]} >> 32))")
    first = ", ".join(f"{x}::HUGEINT AS x{i}" for i, x in enumerate(c))
    return f"WITH RECURSIVE g AS (SELECT 0::BIGINT AS n, {first} UNION ALL SELECT n + 1, {', '.join(f'{x} & 4294967295' for x in s)} FROM g WHERE n < {last}), h AS (SELECT n, lower(printf('%08x%08x%08x%08x', x3::BIGINT, x2::BIGINT, x1::BIGINT, x0::BIGINT)) AS r, x0, x1, x2, x3 FROM g)"


def _fours(first: int) -> str:
    """Hexadecimal of the upper-case digits of r from a place, each four times."""
    return f"array_to_string(list_transform(string_split(upper(substr(r, {first})), ''), lambda d: repeat(lower(hex(d)), 4)), '')"


def _crc_hex(digits: str) -> str:
    """Of 100 bytes as 200 hexadecimal digits."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 100), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c, x) & 255) + 1])))"


NUMBER = "lower(hex(printf('%032X', n)))"


def oracle_sql() -> dict[str, str]:
    pow95 = lambda i: str(95**i)
    key95 = " || ".join([f"chr((32 + (hi // {pow95(i)}::UBIGINT) % 95)::INTEGER)" for i in range(8)] + [f"chr((32 + (lo // {pow95(i)}::UBIGINT) % 95)::INTEGER)" for i in range(2)])
    hash43 = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 10), lambda i: ('0x' || substr(key, 2 * i + 1, 2))::BIGINT)), lambda h, b: ((h * 43 + b - CASE WHEN b > 127 THEN 256 ELSE 0 END) % 4294967296 + 4294967296) % 4294967296)"
    gauge_sql = """e AS (SELECT event_id AS n, event_id % 500 AS ts, event_id % 16 AS task, CASE WHEN event_id % 5 = 0 THEN 'Map' ELSE 'DataSink (out)' END AS op FROM events),
q AS (SELECT * FROM e WHERE op LIKE 'DataSink%'),
b AS (SELECT task, ts, max_by((ts * 10 + task) * 100, n) AS bytes FROM q GROUP BY task, ts),
c AS (SELECT bytes - lag(bytes, 1, 0) OVER w AS grown, {stop} - coalesce(lag(ts) OVER w, 0) AS since FROM b WINDOW w AS (PARTITION BY task ORDER BY ts)),
t AS (SELECT sum(grown)::BIGINT AS seen, sum(grown * since)::DOUBLE AS charge FROM c)"""
    manifest = f"""{REC}, c AS (SELECT {_p(PARTS)} AS p, (row_number() OVER (PARTITION BY {_p(PARTS)} ORDER BY key) - 1) * 100 // {CHUNK} AS chunk FROM r),
m AS (SELECT p, chunk, count(*) AS n FROM c GROUP BY p, chunk)"""
    binary = f"{_generated(999)}, g1 AS (SELECT substr(r, 1, 20) AS key, substr(r, 1, 20) || '0011' || {NUMBER} || '8899aabb' || {_fours(21)} || 'ccddeeff' AS rec FROM h)"
    letters = f"y AS (SELECT *, (x3 * 4294967296 + x2)::UBIGINT AS hi, (x1 * 4294967296 + x0)::UBIGINT AS lo FROM h), z AS (SELECT *, {key95} AS key FROM y), g2 AS (SELECT lower(hex(key)) || '2020' || {NUMBER} || '2020' || {_fours(20)} || '0d0a' AS rec FROM z)"
    wide = lambda d: f"(('0x' || substr({d}, 1, 16))::UBIGINT::UHUGEINT * 18446744073709551616::UHUGEINT + ('0x' || substr({d}, 17, 16))::UBIGINT::UHUGEINT)"
    m64 = "18446744073709551616::UHUGEINT"
    digits = lambda x: f"coalesce(nullif(lower(ltrim(hex({x}), '0')), ''), '0')"
    joined = lambda high, low: f"(({high}) % {m64}) * {m64} + ({low}) % {m64}"
    plus = joined(f"x // {m64} + y // {m64} + (x % {m64} + y % {m64}) // {m64}", f"x % {m64} + y % {m64}")
    times = joined(f"((x % {m64}) * (y % {m64})) // {m64} + ((x // {m64}) * (y % {m64})) % {m64} + ((x % {m64}) * (y // {m64})) % {m64}", f"(x % {m64}) * (y % {m64})")
    return {
        "key_order": "WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS s FROM lineitem), k AS (SELECT substr(md5(s), 1, 20) AS key, substr(md5(s || '+'), 1, 20) AS other FROM l) SELECT key, other, CASE WHEN key < other THEN -1 WHEN key > other THEN 1 ELSE 0 END::BIGINT AS \"order\", CASE WHEN other < key THEN -1 WHEN other > key THEN 1 ELSE 0 END::BIGINT AS back, 0::BIGINT AS own, key = other AS same, true AS same_key FROM k",
        "u128_arithmetic": f"WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS s, l_linenumber * 23 + l_suppkey % 7 AS n FROM lineitem), k AS (SELECT md5(s) AS a, md5(reverse(s)) AS b, n::BIGINT AS n FROM l), v AS (SELECT *, {wide('a')} AS x, {wide('b')} AS y FROM k) SELECT a, b, n, {digits(plus)} AS plus, {digits(times)} AS times, CASE WHEN n >= 128 THEN '0' ELSE {digits('CASE WHEN n = 0 THEN x ELSE (x & ((1::UHUGEINT << (128 - n)::UHUGEINT) - 1::UHUGEINT)) << n::UHUGEINT END')} END AS shifted, substr(a, 1, 16) AS high, substr(a, 17) AS low FROM v",
        "generator_checksum": f"{binary}, {letters} SELECT 'binary' AS form, lower(ltrim(hex((SELECT sum({_crc_hex('rec')}) FROM g1)::BIGINT), '0')) AS checksum UNION ALL SELECT 'ascii', lower(ltrim(hex((SELECT sum({_crc_hex('rec')}) FROM g2)::BIGINT), '0'))",
        "summary_line": f"WITH {REC}, o AS (SELECT key, rec, lag(key) OVER (ORDER BY key) AS prev FROM r) SELECT 'first key: ' || min(key) || ', last key: ' || max(key) || ', checksum: ' || lower(ltrim(hex(sum({_crc('rec')})::BIGINT), '0')) || ', record count: ' || count(*) || ', duplicate count: ' || (count(*) FILTER (prev = key)) || ', unordered count: ' || (count(*) FILTER (prev > key)) AS line FROM o",
        "discarded_sort": f"{binary}, o AS (SELECT key, rec, lag(key) OVER (ORDER BY key) AS prev FROM g1) SELECT min(key) AS first_key, max(key) AS last_key, lower(ltrim(hex(sum({_crc_hex('rec')})::BIGINT), '0')) AS checksum, count(*) AS record_count, count(*) FILTER (prev = key) AS duplicate_count, count(*) FILTER (prev > key) AS unordered_count FROM o",
        "record_encode": f"WITH {REC} SELECT key, rec AS record, substr(rec, 11) AS value, length(rec) AS bytes FROM r",
        "split_points": "SELECT i, i * 16777216 // 1000 AS prefix FROM range(1, 1000) t(i)",
        "partition_assign": f"WITH {REC} SELECT key, k AS prefix, {', '.join(f'{_p(n)} AS p{n}' for n in (3, 8, 1000, 1024))} FROM r",
        "partition_histogram": f"WITH {REC}, c AS (SELECT {_p(1024)} AS p, count(*) AS n FROM r GROUP BY 1) SELECT t.p, coalesce(n, 0) AS records FROM range(1024) t(p) LEFT JOIN c USING (p)",
        "sort_global_rank": f"WITH {REC} SELECT key, trim(substr(rec, 11)) AS rest, row_number() OVER (ORDER BY key, rec) - 1 AS rank FROM r",
        "sort_within_partition": f"WITH {REC} SELECT {_p(PARTS)} AS p, row_number() OVER (PARTITION BY {_p(PARTS)} ORDER BY key, rec) AS place, key FROM r",
        "record_crc32": f"WITH {REC} SELECT key, {_crc('rec')} AS crc FROM r",
        "validate_partitions": f"WITH {VALIDATED} SELECT p, first_key, last_key, record_count, duplicate_count, unordered_count, checksum::BIGINT AS checksum FROM v",
        "validate_global": f"WITH {REC}, o AS (SELECT key, rec, lag(key) OVER (ORDER BY key) AS prev FROM r) SELECT min(key) AS first_key, max(key) AS last_key, lower(ltrim(hex(sum({_crc('rec')})::BIGINT), '0')) AS checksum, count(*) AS record_count, count(*) FILTER (prev = key) AS duplicate_count, count(*) FILTER (prev > key) AS unordered_count FROM o",
        "partition_boundaries": f"WITH {VALIDATED}, b AS (SELECT p, lag(last_key) OVER (ORDER BY p) AS previous_last, first_key FROM v) SELECT p, previous_last, first_key, coalesce(previous_last = first_key, false) AS repeats, coalesce(previous_last > first_key, false) AS descends FROM b",
        "duplicate_keys": "SELECT sum(n)::BIGINT AS record_count, sum(n - 1)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
        "checksum_hex": f"WITH {REC}, t AS (SELECT sum({_crc('rec')})::UHUGEINT AS t FROM r) SELECT lower(ltrim(hex(t), '0')) AS checksum, lower(ltrim(hex(t * 1000000000::UHUGEINT), '0')) AS large FROM t",
        "chunk_manifest": f"WITH {manifest} SELECT p, chunk, 'out/' || p || '/' || chunk AS object_name, n AS records, n * 100 AS bytes FROM m",
        "gensort_binary": f"{_generated(999)} SELECT n, substr(r, 1, 20) AS key, substr(r, 1, 20) || '0011' || {NUMBER} || '8899aabb' || {_fours(21)} || 'ccddeeff' AS record FROM h",
        "gensort_ascii": f"{_generated(999)}, y AS (SELECT *, (x3 * 4294967296 + x2)::UBIGINT AS hi, (x1 * 4294967296 + x0)::UBIGINT AS lo FROM h), z AS (SELECT *, {key95} AS key FROM y) SELECT n, key, lower(hex(key)) || '2020' || {NUMBER} || '2020' || {_fours(20)} || '0d0a' AS record FROM z",
        "gensort_skip_ahead": f"{_generated(2499)} SELECT n, substr(r, 1, 20) AS key FROM h WHERE n >= 2000",
        "split_alignment": 'SELECT start, length, start // 100 * 100 AS "first", (start + length - start // 100 * 100) // 100 * 100 AS bytes FROM (SELECT i * 37 % 1000 AS start, i * 53 % 700 AS length FROM range(1000) t(i))',
        "fixedrec_roundtrip": f"WITH {REC} SELECT rec AS record FROM r",
        "gauge_parse": "SELECT (event_id % 500)::DOUBLE AS time, 'host' || event_id % 16 % 4 AS host, 'x' AS x, 'tm' || event_id % 16 % 4 AS tm_id, 'sort' AS job_name, 'DataSink (out)' AS op_name, (event_id % 16)::VARCHAR AS task_number, 'numRecordsIn' AS gauge_name, event_id % 500 * 10 + event_id % 16 AS gauge_value, 'g' AS gauge_type, event_id AS n FROM events WHERE event_id % 5 <> 0",
        "storage_byte_seconds": f"WITH {gauge_sql.format(stop=600)} SELECT seen AS seen_bytes, charge AS output_byte_seconds, (10000000 - seen) * 600.0::DOUBLE AS missing_byte_seconds, 6000000000::DOUBLE AS input_byte_seconds, charge + (10000000 - seen) * 600.0::DOUBLE + 6000000000::DOUBLE AS byte_seconds FROM t",
        "storage_cost": f"WITH {gauge_sql.format(stop=600)}, s AS (SELECT charge + (10000000000000 - seen) * 600.0::DOUBLE + 6000000000000000::DOUBLE AS byte_seconds FROM t) SELECT byte_seconds, ceil(byte_seconds * 0.024::DOUBLE / 1073741824.0::DOUBLE / 2592000.0::DOUBLE * 100) / 100 AS cost FROM s",
        "key_hash43": f"WITH {REC}, h AS (SELECT key, {hash43} AS h FROM r) SELECT key, h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END AS hash FROM h",
        "normalized_key": f"WITH {REC} SELECT key, substr(key, 1, 8) AS n4, key AS n10, rpad(key, 32, '0') AS n16 FROM r",
        "object_listing": f"WITH {manifest} SELECT row_number() OVER (ORDER BY p, chunk) - 1 AS split_number, p || '/' || chunk AS object_name, n * 100 AS object_size FROM m",
        "total_bytes": f"WITH {manifest} SELECT count(*) AS objects, sum(n * 100)::BIGINT AS bytes FROM m",
        "u128_numbers": "SELECT d AS digits, lower(ltrim(hex(d::UHUGEINT), '0')) AS hex, (d::UHUGEINT)::VARCHAR AS back, (d::UHUGEINT % 256)::BIGINT AS last_byte, upper(right(hex(d::UHUGEINT), 1)) AS last_digit FROM (SELECT l_orderkey || '00000000000000' || l_partkey AS d FROM lineitem)",
        "storage_sum_of_checksums": f"WITH {REC} SELECT lower(ltrim(hex(sum({_crc('rec')})::UHUGEINT), '0')) AS checksum FROM r",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        record_encode, split_points, partition_assign, partition_histogram, sort_global_rank, sort_within_partition, record_crc32, validate_partitions, validate_global, partition_boundaries, duplicate_keys, checksum_hex, chunk_manifest,
        gensort_binary, gensort_ascii, gensort_skip_ahead, split_alignment, fixedrec_roundtrip, gauge_parse, storage_byte_seconds, storage_cost, key_hash43, normalized_key, object_listing, total_bytes, u128_numbers, storage_sum_of_checksums,
        key_order, u128_arithmetic, generator_checksum, summary_line, discarded_sort,
    )
    return {f.__name__: f for f in every}
