"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signatures: a first permutation sends each shingle to a place on a circle of 2**CIRCLE places; a second
permutation gives each place its value. Coordinate k is the smallest value among the shingles' places
moved on by k: two permutations make all coordinates, and those of a shingle are neighbours in one table.
COORDINATES are cut into bands of BAND rows; at a Jaccard similarity of 0.8 two documents share no band
with a probability of 5e-8. Links are confirmed on the full shingle sets.

Links, without emitting all pairs of a bucket:
1. Documents with equal shingle sets form classes; from here on a class is one node.
2. Every member of a bucket is verified against a few centres of the bucket (its smallest members under
   several orders). The links found give components.
3. What is left are pairs in a bucket whose members are still in different components. Each bucket has a
   reference r, its centre with most links, and every member's intersection with r is known from step 2.
   Two members have at most min(|x & r|, |y & r|) shingles of r in common, and outside r as many as an index of
   what lies outside counts; a pair is verified only where both together could be enough, which is an exact bound.
So every candidate pair is verified, ruled out, or lies within one component already. Components come
from alternating large-star and small-star steps on tables; nothing is collected.

Defined results: null texts and texts without words have no shingles and are linked with nothing; texts
with fewer words than a shingle have one, the whole sequence; rows with equal doc_id count as the same
document when links are followed; a row without doc_id gets its class's component, or null if no row of
it has an id; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm import wordhash as H
from sortloom.llm.common import BROADCAST_ROWS, Sieve, alone, hot_join, kept, let_go, same_joins, table

CIRCLE, COORDINATES, BAND = 22, 128, 4
BANDS = COORDINATES // BAND
#: Orders by which a bucket's centres are chosen.
ORDERS = 4
#: Members of a centre that are verified in one group; groups of a centre go to different tasks.
GROUP = 500
#: Links, after those of each chunk are put together, up to which one task puts together the rest.
ONE_TASK = 200_000
#: Centres that have several groups, at most: beyond, groups are larger.
GROUPED = 100_000
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


@cache
def circle() -> np.ndarray:
    """The second permutation's values, each place with those after it, around the circle."""
    values = np.random.default_rng(20).permutation(1 << CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    places = (H.mix(shingles, 31) >> H.U(64 - CIRCLE)).astype(np.int64)
    rows = circle()
    return reduce(np.minimum, (rows[places[i : i + 4096]].min(axis=0) for i in range(0, len(places), 4096)))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; equal only for equal bands of the same index."""
    key = np.arange(1, BANDS + 1, dtype=H.U)
    for row in sig.reshape(BANDS, BAND).T.astype(H.U):
        key = H.mix(key * H.U(H.WORDS) + row, 3)
    return key


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data = LOWERED[data]
    starts, ends, at = H.words(data, offsets)
    hashes = H.word_hashes(data, starts, ends)[0]
    runs = H.run_hashes(hashes, size)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= size:
            yield np.unique(runs[s : e - size + 1])
        elif e > s:
            yield H.run_hashes(hashes[s:e], e - s)
        else:
            yield np.zeros(0, H.U)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (of shingles), f1 and f2 (a fingerprint of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("neardup", circle.cache_clear)
        for batch in batches:
            for i, j, data, offsets in H.blocks(batch.column(1)):
                n, f1, f2, bands = [], [], [], []
                for s in shingle_sets(data, offsets, size):
                    n.append(len(s))
                    f1.append(int(H.mix(s, 41).sum(dtype=H.U).view(np.int64)))
                    f2.append(int(H.mix(s, 43).sum(dtype=H.U).view(np.int64)))
                    bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """node and set (its sorted shingle hashes as bytes) of the documents with these ids, and of a few others."""
    sieve = Sieve(ids)
    shared = sieve.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:  # sieved here: a second worker beside this one would cost its memory
            batch = whole.filter(pa.array(Sieve.may(shared.value, whole.column(2))))
            for i, j, data, offsets in H.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(data, offsets, size)], pa.binary())], names=["node", "set"])

    node = F.col("doc_id").cast("bigint")
    return docs.select(node.alias("node"), "text", F.when(node.isNotNull(), sieve.cell(node)).alias("cell")).mapInArrow(run, "node bigint, set binary")


def _beside(pairs: DataFrame, sets: DataFrame, work, schema: str) -> DataFrame:
    """The rows that work(set of a, set of b) gives for each of the distinct pairs (a, b), a kept table: a's set is sent once for each group of its partners."""
    group = max(GROUP, -(-pairs.count() // GROUPED))
    groups = kept(pairs.groupBy("a").agg(F.ceil(F.count("*") / group).cast("int").alias("groups")))
    hot = groups.where("groups > 1")  # at most GROUPED rows
    members = pairs.join(F.broadcast(hot), "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")), F.lit(0)).cast("int").alias("g"), "b")
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("bigint").alias("b"))
    asked = kept(heads.union(members).withColumn("node", F.coalesce("b", "a")))
    let_go(groups)
    fields = [f.split() for f in schema.split(", ")]
    arrow = [{"bigint": pa.int64(), "binary": pa.binary()}[kind] for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads_now = None, []
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch, out = whole.slice(i, 512), []
                for x, y, s in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    s = np.frombuffer(s, H.U)
                    if y is None:
                        if x != now:
                            now, heads_now = x, []
                        heads_now.append(s)
                    else:
                        for h in heads_now if x == now else []:
                            out += [(x, y, *row) for row in work(h, s)]
                columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=[name for name, _ in fields])

    # Only the sets asked for are shuffled.
    wanted = Sieve(asked.select("node").distinct()).through(sets, "node")
    streams = asked.join(wanted, "node").select("a", "g", "b", "set")
    return streams.repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first()).mapInArrow(run, schema)


def _common(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each of s whether it is in h; both sorted."""
    at = np.searchsorted(h, s)
    at[at == len(h)] = 0
    return h[at] == s


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b): na, nb, both (the sizes of their shingle sets and of the intersection)."""
    return kept(_beside(pairs, sets, lambda h, s: [(len(h), len(s), int(_common(h, s).sum()))], "a bigint, b bigint, na bigint, nb bigint, both bigint"))


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a chunk of a partition, each node to the smallest that the chunk connects it with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def flush() -> pa.RecordBatch:
        got = [(x, r) for x in list(root) if (r := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > 500_000:
            yield flush()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest id it is connected with) for every linked id, by alternating star steps, or by one task if a count proves the links few."""
    edges = kept(links.select("a", "b").where("a <> b").mapInArrow(_forest, "u bigint, v bigint"))  # u > v
    few = edges.count() <= ONE_TASK
    if few:
        before, edges = edges, kept(edges.coalesce(1).mapInArrow(_forest, "u bigint, v bigint"))
        let_go(before)
    while not few:
        # Large star: what is above v is linked to the smallest id around v, v itself unless there is a link down from it.
        down = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = kept(hot_join(edges, down, ["v"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = hot_join(large, least, ["u"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, kept(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        let_go(before, large)
        # Done when every component is one star: each node has one link down, and what it is linked to has none.
        chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if chained.isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", F.col("v").alias("label")).distinct())


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after more links, which join whole components."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = kept(more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct())
    moved = kept(components(between))
    let_go(between)
    new = moved.join(labels, "node", "left_anti")
    old = hot_join(labels, moved.toDF("label", "to"), ["label"], "left").select("node", F.coalesce("to", "label").alias("label"))
    return old.union(new)


def _left(sets: DataFrame, members: DataFrame, centres: DataFrame, tested: DataFrame, links: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a bucket, in different components, that are neither tested nor ruled out."""
    sides = tested.select("a", "b", "na", "nb", "both").union(tested.select("b", "a", "nb", "na", "both"))
    degree = links.select(F.col("a").alias("c")).union(links.select("b")).groupBy("c").agg(F.count("*").alias("links"))
    reference = centres.join(degree, "c", "left").groupBy("key").agg(F.max_by("c", F.struct(F.coalesce("links", F.lit(0)), "c")).alias("ref"))
    placed = hot_join(members, reference, ["key"]).select("ref", "node").distinct()
    placed = placed.join(labels, "node", "left").select("ref", "node", F.coalesce("label", "node").alias("label"))
    placed = kept(placed)
    each = placed.groupBy("ref", "label").agg(F.count("*").alias("k"))
    main = each.groupBy("ref").agg(F.count("*").alias("labels"), F.sum("k").alias("members"), F.max_by("label", F.struct("k", "label")).alias("main")).where("labels > 1 and members > 2").select("ref", "main")
    known = sides.toDF("ref", "node", "nr", "n", "m")
    others = hot_join(placed.where("ref <> node"), main, ["ref"]).join(known, ["ref", "node"]).select("ref", "node", "label", "main", "n", "m")
    others = kept(others)
    # The reference itself is tested against every member, so pairs are among the others.
    pairs = kept(others.select(F.col("ref").alias("a"), F.col("node").alias("b")))
    outside = _beside(pairs, sets, lambda h, s: [(s[~_common(h, s)].tobytes(),)], "a bigint, b bigint, outside binary").toDF("ref", "node", "outside")
    rows = kept(others.join(outside, ["ref", "node"]))
    left = kept(_possible(rows, percent).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    let_go(placed, others, pairs, rows)
    return left


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of one reference, in different components, whose intersection could be large enough.

    rows: ref, node, label, main (the label of most), n, m (shingles, and those in the reference), outside (the others).
    Every pair has a member that isn't of the main label. These stand in blocks of at most GROUP or so, each with an index of what
    lies outside the reference; the reference's members pass by each block, in groups that go to different tasks.
    """
    few, every = F.col("label") != F.col("main"), F.lit(1)
    sizes = rows.groupBy("ref").agg(F.ceil(F.count_if(few) / GROUP).cast("int").alias("blocks"), F.ceil(F.count(every) / (8 * GROUP)).cast("int").alias("groups"))
    sizes = kept(sizes.where("blocks > 0"))
    placed = rows.join(F.broadcast(sizes), "ref") if sizes.count() <= BROADCAST_ROWS else hot_join(rows, sizes, ["ref"], by=["ref", "node"])
    of = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")
    up_to = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    columns = ["node", "label", "main", "n", "m", "outside"]
    heads = placed.where(few).withColumn("block", of("blocks", 1)).select("ref", "block", up_to("groups").alias("g"), F.lit(0).alias("kind"), *columns)
    members = placed.withColumn("g", of("groups", 2)).select("ref", up_to("blocks").alias("block"), "g", F.lit(1).alias("kind"), *columns)
    stream = heads.unionByName(members).repartition("ref", "block", "g").sortWithinPartitions("ref", "block", "g", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, index, held = None, [], {}, None
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch, found = whole.slice(i, 512), []
                for ref, b, g, kind, node, label, main, n, m, outside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (ref, b, g) != now:
                        now, block, index, held = (ref, b, g), [], {}, None
                    shingles = np.frombuffer(outside, H.U).tolist()
                    if kind == 0:
                        for x in shingles:
                            index.setdefault(x, []).append(len(block))
                        block.append((node, label, n, m))
                        continue
                    if not block:
                        continue
                    if held is None:
                        held = np.array(block, np.int64).T
                    nodes, labels, sizes1, inside = held
                    both = np.minimum(inside, m)
                    for x in shingles:
                        if x in index:
                            np.add.at(both, index[x], 1)
                    ok = (labels != label) & (100 * np.minimum(sizes1, n) >= percent * np.maximum(sizes1, n)) & ((100 + percent) * both >= percent * (sizes1 + n))
                    if label != main:
                        ok &= nodes > node
                    found += [(min(node, x), max(node, x)) for x in nodes[ok].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return stream.mapInArrow(run, "a bigint, b bigint")


def link_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n, f1, f2; one row per class: f1, f2, component)."""
    signed = kept(_signed(docs, size))
    classes = kept(
        signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "bands"))).alias("x")).select("f1", "f2", F.col("x.doc_id").alias("node"), "x.bands")
    )
    nodes = classes.where("node is not null")
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = kept(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    keys = buckets.select("key")
    shared = Sieve(keys).through(rows, "key")  # most keys are of one node only and aren't shuffled a second time
    members = kept(hot_join(shared, keys, ["key"], sizes=buckets))
    let_go(buckets)
    orders = [F.min_by("node", F.xxhash64("node", F.lit(k)) if k else F.col("node")).alias(f"c{k}") for k in range(ORDERS)]
    centres = kept(members.groupBy("key").agg(*orders).select("key", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(ORDERS)]))).alias("c")))
    first = hot_join(members, centres, ["key"]).where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    first = kept(first)
    # Whatever is verified later is a member of some bucket, so these sets serve to the end.
    ids = kept(first.select(F.col("a").alias("node")).union(first.select("b")).distinct())
    sets = kept(_sets(docs, ids, size))
    let_go(ids)
    tested = measured(first, sets)
    links = kept(linked(tested, percent))
    labels = kept(components(links))
    left = _left(sets, members, centres, tested, links, labels, percent)
    more = kept(linked(measured(left, sets), percent)) if not left.isEmpty() else left
    if not more.isEmpty():
        labels = kept(_joined(labels, more))
    found = nodes.select("f1", "f2", "node").join(labels, "node", "left").select("f1", "f2", F.coalesce("label", "node").alias("component"))
    found = kept(found)
    let_go(classes, members, centres, first, sets, tested, links, labels, left, more)
    return signed.select("doc_id", "n", "f1", "f2"), found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    with same_joins(docs.sparkSession):
        rows, classes = link_classes(docs, size, percent)
    named = classes.select("f1", "f2", "component")
    joined = rows.join(F.broadcast(named), ["f1", "f2"], "left") if named.count() <= BROADCAST_ROWS else hot_join(rows, named, ["f1", "f2"], "left", by=["doc_id"])
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
c AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY 2),
t AS (SELECT id, len(s) AS n, unnest(s) AS x FROM c),
f AS (SELECT x FROM t GROUP BY x HAVING count(*) > 1),
u AS (SELECT id, n, x FROM t WHERE x IN (SELECT x FROM f)),
p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id AS a, id AS m FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.m = e.a),
k AS (SELECT a, min(m) AS m FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.m, s.doc_id) AS component_id, coalesce(k.m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s AND len(s.s) > 0 LEFT JOIN k ON c.id = k.a
"""
