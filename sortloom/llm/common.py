"""What the operators of this subpackage share: reading tables, text normalisation, shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every operator here.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: only A-Z change, unlike str.lower().
FOLD = {ord(u): ord(l) for u, l in zip(UPPER, LOWER, strict=True)}


#: Rows that Python workers get at a time while a table is kept.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


#: Splits of a table below which it is small (2 GB at most) and dealt to all cores before it is worked on.
FEW_SPLITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of so few splits that cores would stand idle is dealt to all of them, any larger one is read as it lies."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else rows


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def one_space(c: Column) -> Column:
    """Every white space of SPACES as a blank."""
    for space in SPACES[1:]:
        c = F.replace(c, F.lit(space), F.lit(" "))
    return c


def words_of(c: Column) -> Column:
    """The words of a text (null: none) as an array, natively: cut at single blanks, which needs no pattern, empty ones taken out."""
    return F.array_remove(F.split(one_space(F.coalesce(c, F.lit(""))), " ", -1), "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body mentions it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that a scan appends to one array, and code points of a piece of a text, so that time grows with the row and not with its square.
BLOCK, PIECE_BITS = 64, 9


def scan(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step gives for each item, from left to right: step(state, item) is (the next state, an output of the SQL type `kind`).

    A fold that appends to its result copies it at each step, so items are folded in blocks, and blocks are put together.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def folded(each: Column) -> Column:
        last = F.greatest(F.ceil(F.size(each) / BLOCK) - 1, F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(each, i * BLOCK + 1, F.lit(BLOCK)))
        first = F.array(F.struct(start.alias("state"), none.alias("out")))
        done = F.aggregate(blocks, first, lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.struct(F.element_at(acc, -1)["state"].alias("state"), none.alias("out")), one))))
        return F.flatten(F.transform(done, lambda d: d["out"]))

    return bound(items, folded)


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<s, e, v>>: start and end in code points, and the words of each match, left to right."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("n"), v.alias("v")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return at + x["g"] + x["n"], F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["n"]).alias("e"), x["v"].alias("v"))

    inner = F.filter(pairs, lambda x: x["v"].isNotNull())  # the gap after the last match has none
    return scan(inner, F.lit(0), "struct<s: int, e: int, v: string>", step)


def pieces(text: Column) -> Column:
    """The text cut into pieces of equal length, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), F.lit(0))


def between(cut: Column, a: Column, b: Column) -> Column:
    """The characters a .. b - 1 of a text cut into pieces: only the pieces that hold them are touched, wherever they stand."""
    first = F.shiftright(a, PIECE_BITS)
    near = F.array_join(F.slice(cut, first + 1, F.shiftright(b - 1, PIECE_BITS) - first + 1), "")
    return F.when(b > a, F.substr(near, a.bitwiseAND((1 << PIECE_BITS) - 1) + 1, b - a)).otherwise("")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or, where that is unset, under one set here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _own_root(spark)
    return f"{root.rstrip('/')}/sortloom-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sortloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


_made: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends, any executor may be lost."""
    path, conf = scratch(df.sparkSession), df.sparkSession.conf
    was = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, str(min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS))  # whole texts: fewer rows at a time
    try:
        df.write.parquet(path)
    finally:
        conf.set(ARROW_ROWS, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    _made.append(out)
    return out


def let_go(*frames: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "kept_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
            _made[:] = [x for x in _made if x is not df]


def kept_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, kept; whatever tables it has kept on its way are deleted then."""
    before = list(_made)
    out = kept(make())
    let_go(*[x for x in _made if x is not out and not any(x is y for y in before)])
    return out


def _let_all_go() -> None:
    """At the end of the program: tables that a result may have been read from until now."""
    with contextlib.suppress(Exception):
        if SparkSession.getActiveSession():
            let_go(*_made)


atexit.register(_let_all_go)


#: Rows of numbers up to which a table of them is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marked for broadcast if a count (of a kept table, so of its footers) proves it small; else as it is, for a shuffled join that Spark may split."""
    return F.broadcast(df) if df.count() <= max_rows else df


#: Rows of a key beyond which a join deals them to several tasks; keys that are dealt at most (the rest joins as it is).
HOT_ROWS, HOT_KEYS = 2000, 100_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """left.join(right, on, how), inner or left, where right has few rows of a key and left may have a third of all rows in one.

    The rows of a key with more than HOT_ROWS are dealt to several tasks by a hash of the columns `by` (all, unless named), each
    of which gets a copy of right's rows of that key. Counting is pre-aggregated, or done already: sizes has the keys and `rows`.
    """
    if getattr(left, "kept_at", None) and left.count() <= HOT_ROWS:
        return left.join(right, on, how)
    sizes = left.groupBy(*on).agg(F.count("*").alias("rows")) if sizes is None else sizes
    hot = sizes.select(*on, F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("deals")).where("deals > 1").orderBy(F.desc("deals")).limit(HOT_KEYS)
    found = hot.collect()  # at most HOT_KEYS rows
    if not found:
        return left.join(right, on, how)
    named = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    dealt = left.join(named, on, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(*(by or left.columns)), F.col("deals")).cast("int"), F.lit(0))).drop("deals")
    copies = right.join(named, on, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return dealt.join(copies, [*on, "deal"], how).drop("deal")


@contextlib.contextmanager
def same_joins(spark: SparkSession) -> Iterator[None]:
    """Joins are shuffled unless broadcast is asked for after a count: plans are the same at every size."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Sieve:
    """Which numbers may be among some: a bit each of a table of at most 2**28 (32 MB), made natively and collected.

    What it lets through holds all of them and about one in sixteen others (more only beyond sixteen million numbers); an exact
    join may follow. So a table of texts is cut down where it lies, without a shuffle or a broadcast that grows with the input.
    """

    def __init__(self, numbers: DataFrame):
        """numbers: one column of bigint."""
        (name,) = numbers.columns
        self.bits = max(16, min(28, (16 * max(1, numbers.count()) - 1).bit_length()))
        at = self.cell(F.col(name)) + 1
        parts = numbers.where(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("x"))
        table = np.zeros(1 << self.bits - 3, np.uint8)
        for r in parts.collect():
            table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["x"], np.uint8)[: len(table)]
        self.table = numbers.sparkSession.sparkContext.broadcast(table)

    def cell(self, number: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(number, F.lit(9)), 64 - self.bits)

    @staticmethod
    def may(table: np.ndarray, cell: pa.Array) -> np.ndarray:
        """For workers: which of the cells are set."""
        at = cell.fill_null(0).to_numpy(zero_copy_only=False)
        return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & cell.is_valid().to_numpy(zero_copy_only=False)

    def through(self, rows: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows whose number may be among them; or, with inside=False, those whose number surely isn't (null isn't)."""
        shared, schema = self.table, rows.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                may = Sieve.may(table, batch.column(batch.num_columns - 1))
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(may == inside))

        number = F.col(f"`{column}`")
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(number.isNotNull(), self.cell(number)).alias("sieve_cell")).mapInArrow(run, schema)


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """The rows whose number in `column` isn't in gone (one column of the same name): of a large table only those that may go are shuffled."""
    if gone.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), column, "left_anti")
    sieve = Sieve(gone)
    return sieve.through(rows, column, inside=False).unionByName(sieve.through(rows, column).join(gone, column, "left_anti"))


_held: dict[str, Callable[[], object]] = {}


def alone(name: str, release: Callable[[], object]) -> None:
    """For Python workers, which outlive tasks: tables that other operators have kept for their next task are let go.

    name: the operator whose task begins; release: how its own tables are let go when another's task begins.
    """
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    _held[name] = release
    # What the task before has freed goes back to the machine.
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries see to it by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def one_line(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
