"""Removal of passages that occur more than once: every word covered by a run of `width` words whose
sequence also starts anywhere else, in the same text or another.

Method: a count-min sketch as prefilter. Each run is represented by its anchor, the run of ANCHOR words
with the smallest hash among those inside it; equal runs have equal anchors, at different places, so the
number of places at which an anchor is chosen is never less than the number of times any of its runs
occurs. Every partition sketches its anchors; the merged sketch overestimates counts and misses none. A
second pass exactly groups only runs whose anchor is estimated to be repeated, by a fingerprint of 128 bits in two
independent lanes (`wordhash`): words of any length count with all their bytes, and no run is taken for another but
by chance, 1e-12 over 1e13 runs.

For scale: partitions send the non-empty cells of their sketches only; cells are merged block by block,
and one bit a cell (seen twice or more) goes back to the executors, at most ROWS * 2**MAX_BITS / 8 bytes
however large the input. Beyond that width the estimate only grows looser, the result is the same.
Rows that are whole copies of each other are settled by their SHA-256, and a run that occurs again within a
chunk of a partition is settled there; of a very common passage a task sends one row, whatever the number of its chunks.

Defined results: null text has no words, nothing is removed and the kept text is empty; texts shorter
than `width` words lose nothing; repeated rows are copies of each other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sortloom.llm import wordhash as H
from sortloom.llm.common import alone, kept, small, table

#: Words of an anchor; hash rows of the sketch; cells of a row: between 2**MIN_BITS and 2**MAX_BITS.
ANCHOR, ROWS, MIN_BITS, MAX_BITS, BLOCKS = 8, 2, 16, 27, 256
#: Runs that a partition holds before it sends them on.
CHUNK = 200_000
#: Repeated runs that a task remembers having sent on.
SENT = 1 << 18
#: Digests of copied texts up to which they are broadcast (about 20 MB).
BROADCAST_ROWS = 300_000
ALONE, FIRST, COPY = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


def cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; rows follow each other."""
    return [(H.mix(anchors, r + 101) >> H.U(64 - bits)).astype(np.int64) + (r << bits) for r in range(ROWS)]


def anchors(hashes: np.ndarray, word_offsets: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run inside its text?, anchor of each run, hash of each anchor-sized run), by first word."""
    g = H.run_hashes(hashes, size)
    inside = H.runs_inside(word_offsets, width, len(hashes))[: max(0, len(hashes) - width + 1)]
    return inside, H.sliding(np.minimum, g, width - size + 1), g


def chosen(inside: np.ndarray, lowest: np.ndarray, g: np.ndarray, span: int) -> np.ndarray:
    """The places of anchors: where a hash is the smallest of some run."""
    if not len(lowest):
        return np.zeros(0, np.int64)
    a = np.zeros(len(lowest) + 2 * (span - 1), H.U)
    a[span - 1 : span - 1 + len(lowest)] = np.where(inside, lowest, H.U(0))
    return np.flatnonzero((H.sliding(np.maximum, a, span) == g) & (g != 0))


def flagged(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text and state: alone, first of several copies, or another copy; the texts' bytes). Only digests and ids are shuffled."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), F.unhex(F.sha2("text", 256)).alias("digest"))
    seen = Observation()
    counted = rows.observe(seen, F.sum(F.octet_length("text")).alias("bytes"))  # in the pass that counts digests
    copied = counted.where("text is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("n")
    copied = kept(copied)
    state = F.when(F.col("first_digest").isNull(), ALONE).when(F.col("doc_id").eqNullSafe(F.col("first_id")), FIRST).otherwise(COPY)
    joined = rows.join(small(copied.withColumnRenamed("digest", "first_digest"), BROADCAST_ROWS), F.col("digest") == F.col("first_digest"), "left")
    return joined.select("doc_id", "text", state.cast("int").alias("state")), 0 if docs.isEmpty() else seen.get["bytes"] or 0


def sketch(rows: DataFrame, width: int, size: int, bits: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether it was counted twice or more."""
    block_cells = (ROWS << bits) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos, held = [], [], 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate([np.zeros(0, np.int64), *ones]), return_counts=True)
            two = np.union1d(cell[n > 1], np.concatenate([np.zeros(0, np.int64), *twos]))
            one = np.setdiff1d(cell[n == 1], two, assume_unique=True)
            out = []
            for many, c in ((False, one), (True, two)):
                block = c // block_cells
                for b, s, e in zip(*(x.tolist() for x in _groups(block)), strict=True):
                    out.append((b, many, (c[s:e] - b * block_cells).astype(np.uint32).tobytes()))
            ones.clear(), twos.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.binary())], names=["block", "many", "cells"])

        for batch in batches:
            state = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in H.blocks(batch.column(0)):
                starts, ends, at = H.words(data, offsets)
                if len(starts) < width:
                    continue
                inside, lowest, g = anchors(H.word_hashes(data, starts, ends)[0], at, width, size)
                place = chosen(inside, lowest, g, width - size + 1)
                of = state[i:j][np.searchsorted(at, place, "right") - 1]
                for c in cells(g[place[of == ALONE]], bits):
                    ones.append(c)
                for c in cells(g[place[of == FIRST]], bits):
                    twos.append(c)
                held += len(place)
                if held > 4_000_000:
                    held = 0
                    yield flush()
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, many, got in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, counts = block, np.zeros(block_cells, np.uint8)
                c = np.frombuffer(got, np.uint32)
                counts[c] = 2 if many else np.minimum(counts[c] + 1, 2)
        if now is not None:
            yield done()

    parts = rows.where(f"state <> {COPY}").select("text", "state").mapInArrow(count, "block int, many boolean, cells binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    out = np.zeros((BLOCKS, block_cells // 8), np.uint8)
    for r in merged.collect():  # of bounded size: a bit a cell
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, place after the last) of each stretch of equal neighbours."""
    if not len(keys):
        return keys, keys, keys
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], first, np.concatenate([first[1:], [len(keys)]])


def _bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


#: kinds of rows that the second pass writes: finished documents, documents to be cut, runs to be grouped, runs known to be repeated
DONE, TEXT, RUN, KNOWN = 0, 1, 2, 3
PASS = "kind int, doc_id bigint, uid bigint, text string, n_words bigint, sha string, h1 bigint, h2 bigint, pos int, len int, weight int"


def second_pass(rows: DataFrame, bits: np.ndarray, width: int, size: int, row_bits: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        alone("substrings", lambda: None)
        base, row = TaskContext.get().partitionId() << 36, 0
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        sent = np.zeros((2, SENT), H.U)

        def flush() -> Iterator[pa.RecordBatch]:
            """Groups what this partition holds: runs that occur twice here are settled here."""
            if not held:
                return
            h1, h2, uid, pos, of = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((h2, h1))
            h1, h2, uid, pos, of = h1[order], h2[order], uid[order], pos[order], of[order]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(h1)]]))
            many = np.maximum.reduceat(of, first) == FIRST
            many |= n > 1
            lone = first[~many]
            one = np.ones(len(lone), np.int32)
            yield _batch(RUN, len(lone), h1=h1[lone].view(np.int64), h2=h2[lone].view(np.int64), uid=uid[lone], pos=pos[lone], len=one, weight=one)
            rep = first[many]
            slot = (h1[rep] & H.U(SENT - 1)).astype(np.int64)
            fresh = (sent[0, slot] != h1[rep]) | (sent[1, slot] != h2[rep])
            rep, slot = rep[fresh], slot[fresh]
            # Where two share a place the last one stays in both rows.
            _, last = np.unique(slot[::-1], return_index=True)
            last = len(slot) - 1 - last
            sent[0, slot[last]], sent[1, slot[last]] = h1[rep[last]], h2[rep[last]]
            yield _batch(RUN, len(rep), h1=h1[rep].view(np.int64), h2=h2[rep].view(np.int64), weight=np.full(len(rep), 2, np.int32))
            back = np.repeat(many, n) & (of == ALONE)
            uid, pos = uid[back], pos[back]
            order = np.lexsort((pos, uid))
            uid, pos = uid[order], pos[order]
            if len(uid):
                step = np.concatenate([[True], (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1] + 1)])
                first = np.flatnonzero(step)
                yield _batch(KNOWN, len(first), uid=uid[first], pos=pos[first], len=np.diff(np.concatenate([first, [len(uid)]])).astype(np.int32))

        for batch in batches:
            ids, states = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in H.blocks(batch.column(1)):
                starts, ends, at = H.words(data, offsets)
                n, state = np.diff(at), states[i:j]
                candidate = np.zeros(0, np.int64)
                if len(starts) >= width:
                    hashes, hashes2 = H.word_hashes(data, starts, ends)
                    inside, lowest, _ = anchors(hashes, at, width, size)
                    place = np.flatnonzero(inside)
                    text_of = np.searchsorted(at, place, "right") - 1
                    own = state[text_of] != COPY
                    place, text_of = place[own], text_of[own]
                    ok = np.ones(len(place), bool)
                    for c in cells(lowest[place], row_bits):
                        ok &= _bit(seen, c)
                    candidate, text_of = place[ok], text_of[ok]
                    if len(candidate):
                        h1 = H.run_hashes(hashes, width, H.WORDS)[candidate]
                        h2 = H.run_hashes(hashes2, width, H.WORDS2)[candidate]
                        held.append((h1, h2, base + row + i + text_of, (candidate - at[text_of]).astype(np.int32), state[text_of]))
                        waiting += len(candidate)
                hit = np.zeros(j - i, bool)
                hit[text_of if len(candidate) else []] = True
                copied = (state != ALONE) & (n >= width)
                cut = hit & (state == ALONE)
                raw = data.tobytes()
                sha = [EMPTY if gone else hashlib.sha256(b" ".join(raw[offsets[k] : offsets[k + 1]].split())).hexdigest() for k, gone in enumerate(copied.tolist()) if not cut[k]]
                rest = np.flatnonzero(~cut)
                yield _batch(DONE, len(rest), doc_id=ids.slice(i, j - i).take(pa.array(rest)), n_words=n[rest], sha=pa.array(sha, pa.string()), len=np.where(copied, n, 0)[rest].astype(np.int32))
                rest = np.flatnonzero(cut)
                yield _batch(TEXT, len(rest), doc_id=ids.slice(i, j - i).take(pa.array(rest)), uid=base + row + i + rest, text=batch.column(1).slice(i, j - i).take(pa.array(rest)), pos=np.full(len(rest), -1, np.int32), len=np.zeros(len(rest), np.int32))
                if waiting > CHUNK:
                    waiting = 0
                    yield from flush()
            row += batch.num_rows
        yield from flush()

    return rows.mapInArrow(run, PASS)


_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("sha", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.int32()), ("len", pa.int32()), ("weight", pa.int32())])


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    arrays = []
    for f in _ARROW:
        if f.name == "kind":
            arrays.append(pa.array(np.full(n, kind, np.int32)))
        elif f.name in columns:
            arrays.append(x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type))
        else:
            arrays.append(pa.nulls(n, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def cut_texts(rows: DataFrame, width: int, with_text: bool) -> DataFrame:
    """Rows of one uid follow each other, the text first, then runs to be cut: a streaming pass, one text in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def done() -> None:
            doc_id, words, marks = now
            gone = np.cumsum(marks[:-1]) > 0
            left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))

        def batch_of() -> pa.RecordBatch:
            got = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(got, kinds, strict=True)], schema=pa.schema(kinds))

        for batch in batches:
            pos, length, uid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 0))
            texts = np.flatnonzero(pos == -1).tolist()
            for s, e in zip([0, *texts] if not texts or texts[0] else texts, [*texts, len(pos)] if not texts or texts[0] else [*texts[1:], len(pos)], strict=True):
                if s < e and pos[s] == -1:
                    if now is not None:
                        done()
                    words = batch.column(4)[s].as_py().encode().split()
                    now = batch.column(1)[s].as_py(), words, np.zeros(len(words) + 1, np.int64)
                    s += 1
                if s < e:
                    np.add.at(now[2], pos[s:e], 1)
                    np.add.at(now[2], pos[s:e] + length[s:e] + (width - 1), -1)
            if len(out) > 200:
                yield batch_of()
        if now is not None:
            done()
        yield batch_of()

    ordered = rows.repartition("uid").sortWithinPartitions("uid", "pos").select("uid", "doc_id", "pos", "len", "text")
    return ordered.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def remove_repeated(docs: DataFrame, width: int, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row (and, if asked for, kept_text of the rows that were cut)."""
    size = min(ANCHOR, width)
    rows, n_bytes = flagged(docs)
    expected = n_bytes / 6 * 2 / (width - size + 2)  # words of six bytes or so; anchors' share of them
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1.0, expected) * 4)))))
    found = kept(second_pass(rows, sketch(rows, width, size, bits), width, size, bits))
    runs = found.where(f"kind = {RUN}").select("h1", "h2", "uid", "pos", "len", "weight")
    total = F.expr("sum(weight) over (partition by h1, h2)")
    hits = runs.withColumn("total", total).where("total > 1 and uid is not null").select("uid", "pos", "len")
    marks = hits.unionByName(found.where(f"kind = {KNOWN}").select("uid", "pos", "len"))
    texts = found.where(f"kind = {TEXT}").select("uid", "doc_id", "pos", "len", "text")
    cut = cut_texts(texts.unionByName(marks, allowMissingColumns=True), width, with_text)
    done = found.where(f"kind = {DONE}").select("doc_id", "n_words", F.col("len").cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    out = done.unionByName(cut)
    return out if with_text else out.drop("kept_text")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), width=35)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT doc_id, p, array_to_string(w[p : p + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(p, p + 35)) AS p FROM r) GROUP BY doc_id),
x AS (SELECT d.doc_id, w, c.ps, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS k FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM x
"""
