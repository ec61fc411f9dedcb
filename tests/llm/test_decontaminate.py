import pickle
import random
import re

import numpy as np
import pytest

from sortloom.llm import decontaminate as D
from tests.llm.helpers import SF, both, empty

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def least_edits(item, text):
    """Edits between the item and the nearest stretch of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute_contaminated(rows, items, similarity=0.8):
    """Pairs (doc_id, item_id), with a cheap bound before the table of edits: enough of the item's words must be in the text."""
    out = set()
    cut = [(i, w) for i, t in items if (w := words(t))]
    for d, t in rows:
        w = words(t)
        have = set(w)
        for i, x in cut:
            most = int((1 - similarity) * len(x) + 1e-9)
            if sum(y not in have for y in x) <= most and least_edits(x, w) <= most:
                out.add((d, i))
    return out


def test_query_equals_brute_force(spark):
    docs = both(spark, 500)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == brute_contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], items) and got


def edited(rng, item, edits, vocabulary):
    w = item.split()
    for _ in range(edits):
        p, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.5:
            w[p] = rng.choice(vocabulary)
        elif kind < 0.75:
            w.insert(p, rng.choice(vocabulary))
        else:
            del w[p]
    return w


def test_recall_up_to_the_threshold_and_no_strangers(spark):
    rng = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    vocabulary = [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(100).collect() for w in r["text"].split()]
    rows, true = [], set()
    for k, (i, t) in enumerate(items):
        edits = int(rng.choice((0, 0.1, 0.2)) * len(words(t)))
        w = edited(rng, t, edits, vocabulary)
        rows.append((k, " ".join(rng.choices(vocabulary, k=80) + w + rng.choices(vocabulary, k=80))))
        if least_edits(words(t), words(rows[-1][1])) <= int(0.2 * len(words(t)) + 1e-9):
            true.add((k, i))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")).collect()}
    assert len(got & true) >= 0.98 * len(true) and got <= true


def test_bit_parallel_edits_equal_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item, text = [rng.randrange(6) for _ in range(rng.randint(1, 70))], [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        masks = {}
        for k, x in enumerate(item):
            masks[x] = masks.get(x, 0) | 1 << k
        want = least_edits(item, text)
        got = D.edits_within(masks, len(item), text, len(item))
        assert got is None and not text or got[0] == want


def test_embedding_keeps_near_strings_near():
    """Windows around an edit collide far more often than strangers."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 64).astype(np.uint64)
    b = a.copy()
    b[30] = 5
    start = np.arange(5, 25)
    near = sum(int((D.walk_keys(a, start, r, [20])[20] == D.walk_keys(b, start, r, [20])[20]).sum()) for r in range(D.REPEATS))
    far = sum(int((D.walk_keys(a, start, r, [20])[20] == D.walk_keys(a, start + 20, r, [20])[20]).sum()) for r in range(D.REPEATS))
    assert near > len(start) * D.REPEATS * 0.5 and far == 0


def test_blocks_of_items_and_empty_sides(spark, monkeypatch):
    docs = both(spark, 100)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, D.contaminated(docs, items).collect()), key=str)
    for name, most in (("BLOCK_ITEMS", 7), ("BLOCK_BYTES", 900)):
        monkeypatch.setattr(D, name, most)
        assert sorted(map(tuple, D.contaminated(docs, items).collect()), key=str) == whole and len(list(D._blocks(items))) > 3
        monkeypatch.undo()
    assert D.contaminated(empty(spark), items).count() == 0
    assert D.contaminated(docs, spark.createDataFrame([(1, None), (2, ""), (3, "few words")], "item_id long, text string")).count() == 0


def packed(raw):
    return D.text_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 15, 19, 20, 24, 25, 29, 30, 40, 45, 59, 60, 80])
def test_recall_at_the_threshold_by_length(n):
    """150 items of n words, a fifth of them replaced at places of all kinds, between strange words, at even and odd places."""
    rng = random.Random(n)
    names = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(names, k=n))) for k in range(150)]
    for where in ("anywhere", "first", "last"):
        raw, copies = [], []
        for k, (_, t) in enumerate(items):
            w = t.split()
            for p in {"anywhere": rng.sample(range(n), n // 5), "first": range(n // 5), "last": range(n - n // 5, n)}[where]:
                w[p] = f"strange{rng.randrange(10**6)}"
            around = rng.choices(names, k=20 + k % 2), rng.choices(names, k=9)
            raw.append(" ".join([*around[0], *w, *around[1]]).encode())
            copies.append(" ".join([*around[0], t, *around[1]]).encode())
        block = D.Items(items, 0.8)
        found = {(t, block.ids[i]) for t, i, _, _ in block.matches(*packed(raw))}
        assert sum((k, k) in found for k in range(150)) >= 0.95 * 150, where
        assert {(k, k, 0) for k in range(150)} <= {(t, block.ids[i], e) for t, i, e, _ in block.matches(*packed(copies))}


def test_passages_within_the_threshold_are_found_with_their_edits():
    """Items of each length, with as many edits of all kinds as they may take, from even and odd places."""
    rng = random.Random(6)
    names = [f"w{k}" for k in range(3000)]
    items = [(n * 100 + k, " ".join(rng.choices(names, k=n))) for n in range(1, 61) for k in range(8)]
    block = D.Items(items, 0.8)
    raw = []
    for k, (i, t) in enumerate(items):
        raw.append(" ".join(rng.choices(names, k=20 + k % 2) + edited(rng, t, len(words(t)) // 5, names) + rng.choices(names, k=9)).encode())
    found = {(t, block.ids[i]): e for t, i, e, _ in block.matches(*packed(raw))}
    missed = 0
    for k, (i, t) in enumerate(items):
        least = least_edits(words(t), words(raw[k].decode()))
        assert least <= len(words(t)) // 5
        if (k, i) in found:
            assert found[k, i] == least
        else:
            missed += 1
    assert missed <= 0.02 * len(items), missed


def test_what_is_sent_to_workers_is_small(spark):
    """Tables of fixed size and a few numbers for each item and repetition."""
    rows = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()
    assert len(pickle.dumps(D.Items([(r["item_id"], r["text"]) for r in rows], 0.8))) < 16 << 20


def test_very_long_items_and_texts():
    rng = random.Random(9)
    names = [f"w{k}" for k in range(3000)]
    t = " ".join(rng.choices(names, k=700))
    w = t.split()
    for p in rng.sample(range(700), 140):
        w[p] = f"strange{p}"
    block = D.Items([(1, t), (2, " ".join(rng.choices(names, k=900)))], 0.8)
    raw = [(" ".join(rng.choices(names, k=20000)) + " " + " ".join(w)).encode(), b"", " ".join(w[:300]).encode()]
    assert [(i, block.ids[k], e) for i, k, e, _ in block.matches(*packed(raw))] == [(0, 1, 140)]


def test_short_items_are_found(spark):
    items = [(1, "Paris"), (2, "forty two"), (3, "the red door opens"), (4, "who wrote the long letter"), (5, "one two three four five six seven"), (6, "forty two"), (7, " - "), (8, "two")]
    rows = [(1, "In PARIS, in Paris: forty-two. Forty two!"), (2, "forty, or two; who wrote that long letter"), (3, "parish the red door. opens one two four five six seven"), (4, None), (5, "door opens the red"), (None, "paris")]
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["first_word"]) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == brute_contaminated(rows, items, 0.8)
    assert got[1, 1] == (0, 1) and got[1, 2] == got[1, 6] == (0, 4) and got[2, 4][0] == got[3, 5][0] == 1 and (1, 7) not in got and (None, 1) in got
