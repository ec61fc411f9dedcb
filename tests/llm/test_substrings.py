import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sortloom.llm import substrings as S
from sortloom.llm import wordhash as H
from tests.llm.helpers import both, duck, empty, odd, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    n = Counter()
    cut = [(d, WORD.findall(t or "")) for d, t in rows]
    for _, w in cut:
        n.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for d, w in cut:
        gone = {j for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [35, 9, 3, 1])
def test_equals_brute_force(spark, width):
    docs = both(spark, 250)
    assert got(S.remove_repeated(docs, width)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], width)


def test_small_vocabulary_and_a_hot_passage(spark):
    """Overlapping and periodic repeats, and one passage that a third of the documents share."""
    rng = random.Random(8)
    hot = [f"h{i}" for i in range(50)]
    rows = []
    for i in range(150):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 60))] + [f"u{i}-{j}" for j in range(rng.randint(0, 30))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = hot
        rows.append((i, " ".join(w) if i % 7 else "x y " * 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width in (35, 12):
        assert got(S.remove_repeated(docs, width)) == brute(rows, width)


def test_chunks_and_a_sketch_too_small_lose_nothing(spark, monkeypatch):
    docs = both(spark, 150)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 35)
    monkeypatch.setattr(S, "CHUNK", 50)
    monkeypatch.setattr(S, "MIN_BITS", 9)
    monkeypatch.setattr(S, "MAX_BITS", 9)
    monkeypatch.setattr(S, "BLOCKS", 4)
    assert got(S.remove_repeated(docs, 35)) == want


def test_query_equals_sql(spark):
    assert same(S.op10_repeated_passages(spark, "/root/testdata/sf0.01").toPandas(), duck(S.ORACLE))


def test_kept_text(spark):
    rows = [(1, "a b c d e"), (2, "x  b c d\ty"), (3, None)]
    out = {r["doc_id"]: r["kept_text"] for r in S.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 3, with_text=True).collect()}
    assert out == {1: "a e", 2: "x y", 3: None}


def test_odd_and_no_rows(spark):
    assert S.remove_repeated(empty(spark), 35).count() == 0
    assert got(S.remove_repeated(odd(spark), 35)) == brute([(r["doc_id"], r["text"]) for r in odd(spark).collect()], 35)


def thue_morse(a, b):
    """1024 characters, and the same with a and b exchanged: equal for any polynomial modulo 2**64 with an odd base."""
    x = "".join((a, b)[bin(i).count("1") & 1] for i in range(1024))
    return x, x.translate({ord(a): b, ord(b): a})


def test_long_words_count_with_all_their_bytes(spark):
    x, y = thue_morse("a", "b")
    around = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*around[:20], x, *around[20:]])), (2, " ".join([*around[:20], y, *around[20:], "more"]))]
    rows += [(3, "c" * 64 + " " + " ".join(around[:10])), (4, "c" * 65 + " " + " ".join(around[:10])), (5, "d" * 8 + " e"), (6, "d" * 7 + " e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (35, 2, 1):
        assert got(S.remove_repeated(docs, width)) == brute(rows, width)
    words = [x, y, x[:64], y[:64], x[:63], x[:65], *("a" * n for n in (1, 7, 8, 9, 16, 17, 64, 65)), "a\x00", "a\x00\x00"]
    data = " ".join(words).encode()
    hashes = H.word_hashes(np.frombuffer(data, np.uint8), *H.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[:2])
    assert len(set(hashes[0].tolist())) == len(set(hashes[1].tolist())) == len(words)


def test_hashes_of_blocks():
    import pyarrow as pa

    texts = ["a bb  a", None, "", "bb a\x0bcc\x1c dd", " é "]
    for limit in (1, 1 << 20):
        seen = []
        for i, j, data, offsets in H.blocks(pa.array(texts), limit):
            starts, ends, at = H.words(data, offsets)
            hashes = [tuple(x) for x in H.word_hashes(data, starts, ends).T.tolist()]
            for k in range(j - i):
                seen.append([(data[s:e].tobytes(), h) for s, e, h in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], hashes[at[k] : at[k + 1]], strict=True)])
        assert [[w for w, _ in t] for t in seen] == [(t or "").encode().split() for t in texts]
        of = {w: h for t in seen for w, h in t}
        assert len(set(of.values())) == len(of) and all(of[w] == h for t in seen for w, h in t)
    x = np.arange(1, 9, dtype=np.uint64)
    assert len(set(H.run_hashes(np.tile(x, 3), 4).tolist())) == 8
    assert (H.sliding(np.minimum, np.array([5, 3, 4, 9, 1], np.uint64), 3) == [3, 3, 1]).all()
