"""Benchmark items in documents, up to edits: the CGK embedding, repeated bit-sampling LSH and exact verification.

Symbols are words (runs of ASCII digits and letters, A-Z lower-cased, and other characters beyond ASCII).
The CGK random walk reads a window: at each step it writes the word it stands on, and moves on if the
step's random bit of that word is set, so that strings few edits apart become strings few places apart. A walk
over a window of an item's size (rounded down to its class's, CLASSES) has as many steps, and never runs
past the window. A repetition has random bits of its own and samples COORDINATES steps of a stretch of SPAN steps, the stretch anywhere in
the walk; windows whose samples are equal collide. Every second repetition reads windows from their end, so edits that crowd into one half
leave the other half's walks alone. Windows start, or end, at every word of a document.

Recall: with a fifth of an item's words replaced, REPEATS repetitions find over 0.97 of the passages at every length
from 5 to 80 words (the tests measure each), and all of those without edits; items of fewer words than an edit
needs have walks that are equal wherever they stand word for word. No item is too short to be looked for.

Windows that can't match are passed over before they are walked, which loses none: k edits spoil 2 k pairs of neighbouring
words at most, so a window must hold n - 1 - 2 k pairs that some item has.

Every collision is verified exactly: the least number of word edits between the item and any stretch of
the document around the window (Myers' bit-parallel algorithm). A document is contaminated by an item if
that number is at most (1 - similarity) times the item's words.

The benchmark is the stated query set: its items go to the executors in blocks of at most BLOCK_ITEMS items and
BLOCK_BYTES bytes of text (or one item), against all rows. Nothing is shuffled. Defined results: null and wordless
texts match nothing; items of fewer words than an edit needs are looked for word for word, also where ordinary
language repeats them by chance; equal items each match; repeated rows give repeated rows; an empty table on either
side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm import wordhash as H
from sortloom.llm.common import alone, kept, table
from sortloom.llm.neardup import LOWERED

#: Repetitions; sampled steps of each, and the stretch of the walk that they are taken from.
REPEATS, COORDINATES, SPAN = 24, 4, 12
#: Words of an edit's worth at least apart: sizes of items are rounded down to one of these, about 1.4 apart.
CLASSES = [1, 2, 3, 4, 5, 7, *(int(10 * 1.4**i) for i in range(30))]
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Bits of a table of what items have.
SEEN_BITS = 22
SEPARATES = np.ones(256, bool)
SEPARATES[48:58] = SEPARATES[97:123] = SEPARATES[128:] = False
FOUND = "doc_id bigint, item_id bigint, edits bigint, item_words bigint, first_word bigint, similarity double"


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text)."""
    data = LOWERED[data]
    starts, ends, at = H.words(data, offsets, SEPARATES)
    return H.word_hashes(data, starts, ends)[0], at


def samples(steps: int, repeat: int) -> list[int]:
    """The sampled steps of a repetition: one from each part of a stretch of the walk."""
    rng = np.random.default_rng(1000 * steps + repeat)
    span, n = min(SPAN, steps), min(COORDINATES, steps)
    first = int(rng.integers(0, steps - span + 1))
    cuts = np.linspace(first, first + span, n + 1).astype(int)
    return [int(rng.integers(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def repeats_of(steps: int) -> int:
    """One for items that take no edits."""
    return REPEATS if steps >= 5 else 1


def walk_keys(words: np.ndarray, starts: np.ndarray, repeat: int, classes: list[int]) -> dict[int, np.ndarray]:
    """For each class the key of each window: the words on which the walk from `starts` stands at the sampled steps."""
    taken = {c: samples(c, repeat) for c in classes}
    steps = max(t[-1] for t in taken.values()) + 1
    words = np.concatenate([words, np.zeros(steps, H.U)])
    at, keys = starts.copy(), {c: np.full(len(starts), c, H.U) for c in classes}
    for j in range(steps):
        if j % 64 == 0:
            bits = H.mix(words, 500 + repeat + 100 * (j // 64))
        for c in classes:
            if j in taken[c]:
                keys[c] = H.mix(keys[c] + words[at], 71)
        at += ((bits[at] >> H.U(j % 64)) & H.U(1)).astype(np.int64)
    return keys


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A cell for each word and the one after it, in whichever direction they are read."""
    return (H.mix(words[:-1] + words[1:], 73) >> H.U(64 - SEEN_BITS)).astype(np.int64)


def edits_within(masks: dict[int, int], n: int, words: list[int], most: int) -> tuple[int, int] | None:
    """(least edits between the item and any stretch of these words, where that stretch ends), if at most `most`. Myers."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, None
    for i, w in enumerate(words):
        eq = masks.get(w, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | (full & ~(d | plus)), plus & d
        if hp & last:
            score += 1
        elif hm & last:
            score -= 1
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | (full & ~(x | hp)), hp & x
        if score <= most and (best is None or score < best[0]):
            best = score, i + 1
    return best


def marked(cells: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[cells] = True
    return seen


class Items:
    """A block of benchmark items: their words, and their windows' keys in each repetition."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        raw = [t.encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, raw)])
        hashes, at = text_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids, self.words, self.masks, self.most = [], [], [], []
        flat, base = [], 0
        for (item_id, _), s, e in zip(items, at[:-1].tolist(), at[1:].tolist(), strict=True):
            w = hashes[s:e]
            if not len(w):
                continue
            masks: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.ids.append(item_id), self.words.append((base, len(w))), self.masks.append(masks), self.most.append(int((1 - similarity) * len(w) + 1e-9))
            flat.append(w)
            base += len(w)
        if not flat:
            return
        size, first = np.array([n for _, n in self.words]), np.array([f for f, _ in self.words])
        of_class = np.array(CLASSES)[np.searchsorted(CLASSES, size, "right") - 1]
        self.classes = sorted(set(of_class.tolist()))
        self.single = marked((np.concatenate(flat) >> H.U(64 - SEEN_BITS)).astype(np.int64)[first[size == 1]])
        self.double = marked(np.concatenate([pairs_of(w) for w in flat]))
        #: Of each class the words that a window and edits can take up, the pairs that it must hold, and how far edits move places.
        most = np.array(self.most)
        self.needs = {c: (int((size + most)[of_class == c].max()), int((size - 1 - 2 * most)[of_class == c].min()), int(most[of_class == c].max())) for c in self.classes}
        self.tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for repeat in range(REPEATS):
            words = np.concatenate(flat if repeat % 2 == 0 else [w[::-1] for w in flat])
            for c in self.classes:
                if repeat < repeats_of(c):
                    own = np.flatnonzero(of_class == c)
                    key = walk_keys(words, first[own], repeat, [c])[c]
                    order = np.argsort(key, kind="stable")
                    self.tables[repeat, c] = key[order], own[order]
        #: One table for the keys of all classes and repetitions: three such tables are sent, whatever the items.
        self.keys = marked((np.concatenate([key for key, _ in self.tables.values()]) >> H.U(64 - SEEN_BITS)).astype(np.int64))

    def possible(self, words: np.ndarray, classes: list[int]) -> np.ndarray:
        """Where windows of some class start that hold enough of the items' pairs of words, and, as edits move places, those beside them."""
        edge = np.zeros(len(words) + 1, np.int32)
        has = np.zeros(len(words) + 1, np.int32)
        np.cumsum(self.double[pairs_of(words)], out=has[1:-1])
        has[-1] = has[-2]
        for c in classes:
            room, pairs, beside = self.needs[c]
            if c == 1:
                ok = np.flatnonzero(self.single[(words >> H.U(64 - SEEN_BITS)).astype(np.int64)])
            else:
                n = max(0, len(words) - room + 1)
                enough = np.concatenate([has[room - 1 : room - 1 + n] - has[:n], has[-1] - has[n:-1]])
                ok = np.flatnonzero(enough >= pairs)
            np.add.at(edge, np.maximum(ok - beside, 0), 1)
            np.add.at(edge, np.minimum(ok + beside + 1, len(words)), -1)
        return np.flatnonzero(np.cumsum(edge[:-1]))

    def collisions(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where the item would start, item) of each colliding window."""
        sizes = np.array([n for _, n in self.words])
        for back in (0, 1):
            way = words[::-1] if back else words
            before: list[int] = []
            for repeat in range(back, REPEATS, 2):
                classes = [c for c in self.classes if repeat < repeats_of(c)]
                if not classes:
                    break
                if classes != before:  # without the classes that take no edits there are fewer windows
                    begin, before = self.possible(way, classes), classes
                    # Only the stretches that walks can come by are looked at from here on.
                    edge = np.zeros(len(way) + 1, np.int32)
                    edge[begin] = 1
                    np.add.at(edge, np.minimum(begin + max(classes), len(way)), -1)
                    by = np.cumsum(edge[:-1]) > 0
                    short, start = way[by], (np.cumsum(by) - 1)[begin]
                if not len(begin):
                    continue
                keys = walk_keys(short, start, repeat, classes)
                for c in classes:
                    known, item = self.tables[repeat, c]
                    maybe = np.flatnonzero(self.keys[(keys[c] >> H.U(64 - SEEN_BITS)).astype(np.int64)])
                    low, high = np.searchsorted(known, keys[c][maybe], "left"), np.searchsorted(known, keys[c][maybe], "right")
                    n = high - low
                    if n.any():
                        place = begin[np.repeat(maybe, n)]
                        of = item[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
                        yield (len(words) - place - sizes[of] if back else place), of

    def matches(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, edits, first word of the stretch) of each text and item that match, by the fewest edits, then the first place."""
        if not self.ids or not len(words):
            return
        found = [np.stack(x) for x in self.collisions(words)]
        if not found:
            return
        guess, item = np.concatenate(found, axis=1)
        n_words, most_of = np.array([n for _, n in self.words]), np.array(self.most)
        # A window may begin or end in a text's neighbour: it counts for the text that holds its middle.
        text = np.searchsorted(at, np.clip(guess + n_words[item] // 2, 0, len(words) - 1), "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # Items without edits: the run of words must be there as it is, and its first place in a text is the answer.
        whole = (most_of[item] == 0) & (guess >= at[text]) & (guess + n_words[item] <= at[text + 1])
        for t, i, g in np.unique(np.stack([text, item, guess])[:, whole], axis=1).T.tolist():
            n = self.words[i][1]
            if (t, i) not in best and all(self.masks[i].get(w, 0) >> k & 1 for k, w in enumerate(words[g : g + n].tolist())):
                best[t, i] = 0, g - int(at[t])
        # Collisions of a text and item at nearly the same alignment are one candidate.
        near_by = most_of[item] > 0
        slack = most_of[item] + 1
        todo = np.unique(np.stack([text, item, guess // slack])[:, near_by], axis=1).T.tolist()
        for t, i, g in todo:
            n, most = self.words[i][1], self.most[i]
            s, e = max(int(at[t]), (g - 1) * (most + 1)), min(int(at[t + 1]), (g + 2) * (most + 1) + n + most)
            near = words[s:e].tolist()
            # All but `most` of the item's words must stand there: most false candidates end here.
            if sum(map(self.masks[i].__contains__, near)) < n - most:
                continue
            got = edits_within(self.masks[i], n, near, most)
            if got is not None:
                value = got[0], max(0, s + got[1] - n - int(at[t]))
                if (t, i) not in best or value < best[t, i]:
                    best[t, i] = value
        for (t, i), (edits, first) in sorted(best.items()):
            yield t, i, edits, first


def _against(docs: DataFrame, items: list[tuple[int, str]], similarity: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Items(items, similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        alone("decontaminate", lambda: None)
        for batch in batches:
            ids = batch.column(0)
            for i, _, data, offsets in H.blocks(batch.column(1)):
                words, at = text_words(data, offsets)
                rows = [(ids[i + t].as_py(), block.ids[k], edits, block.words[k][1], first, 1 - edits / block.words[k][1]) for t, k, edits, first in block.matches(words, at)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "edits", "item_words", "first_word", "similarity"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, FOUND)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks, one at least."""
    block, held, n = [], 0, 0
    for item_id, text in benchmark.where("text is not null").select(F.col("item_id").cast("bigint"), "text").toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or held + len(text.encode()) > BLOCK_BYTES):
            yield block
            block, held, n = [], 0, n + 1
        block.append((item_id, text))
        held += len(text.encode())
    if block or not n:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, edits, item_words, first_word, similarity."""
    out, held = None, None
    for block in _blocks(benchmark):
        if held is not None:  # a block of several is done before the next one is made
            out = kept(held) if out is None else out.union(kept(held))
        held = _against(docs, block, similarity)
    return held if out is None else out.union(held)


def _without(docs: DataFrame, items: list[tuple[int, str]], similarity: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Items(items, similarity))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        alone("decontaminate", lambda: None)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for i, _, data, offsets in H.blocks(batch.column(at_text)):
                for t, *_ in block.matches(*text_words(data, offsets)):
                    clean[i + t] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose own text holds no item, whatever their ids."""
    for block in _blocks(benchmark):
        docs = _without(docs, block, similarity)
    return docs


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
