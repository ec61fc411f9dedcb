import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortloom.llm import common, neardup
from sortloom.llm import wordhash as H
from tests.llm.helpers import both, duck, empty, odd, same
from tests.llm.test_substrings import thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_components(rows, size, percent=80):
    """Component of each doc_id, by all pairs."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


def test_query_equals_brute_force(spark):
    docs = both(spark, 500)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 2).where("doc_id is not null").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    component = brute_components(rows, 2)
    assert got == {(d, len(shingles(t, 2)), component[d], component[d] == d) for d, t in rows}


def test_query_equals_sql(spark):
    assert same(neardup.op9_near_duplicates(spark, "/root/testdata/sf0.01").toPandas(), duck(neardup.ORACLE))


def test_a_large_group_of_near_copies_loses_no_link(spark):
    """Copies with few to many words changed: some are linked only to some others, and some to none."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            w[p] = f"x{rng.integers(0, 400)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()}
    want = brute_components(rows, 2)
    assert got == want and 1 < len(set(want.values())) < 160


def test_long_words_count_with_all_their_bytes(spark):
    x, y = thue_morse("a", "b")
    rows = [(1, f"the {x} end of it"), (2, f"the {y} end of it"), (3, x), (4, y), (5, x)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3} == brute_components(rows, 2)


def test_bands_meet_as_independent_coordinates_would():
    """Pairs at the threshold that share few bands: circulant coordinates, neighbours in a band, miss no more than others do."""
    rng, n, few = np.random.default_rng(11), 400, 0
    shared = []
    for _ in range(n):
        both, a, b = (rng.integers(0, 2**63, k).astype(H.U) for k in (160, 20, 20))
        keys = [neardup.band_keys(neardup.signature(np.concatenate([both, x]))) for x in (a, b)]
        shared.append(int((keys[0] == keys[1]).sum()))
    few = sum(s < 4 for s in shared)
    # 32 bands that each meet with 0.8**4: 13 of 32 on average, fewer than 4 about once in 7,000.
    assert min(shared) > 0 and few <= 6 and abs(np.mean(shared) - 32 * 0.8**4) < 1.5


def test_signatures_agree_as_similarity_says():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(H.U) for n in (600, 200, 200))
    agree = (neardup.signature(np.concatenate([shared, a])) == neardup.signature(np.concatenate([shared, b]))).mean()
    assert abs(agree - 0.6) < 0.15


@pytest.mark.parametrize("few", [0, 200_000])
def test_chain_of_links_is_one_component(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "ONE_TASK", few)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long").repartition(7)
    got = {r["node"]: r["label"] for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("name", ["documents", "copies"])
def test_beyond_every_bound_the_result_is_the_same(spark, monkeypatch, name):
    """No broadcast of ids, keys hot from three rows on, groups of two partners, few of them: the paths of large tables."""
    if name == "documents":
        docs = both(spark, 200).where("doc_id is not null").select("doc_id", "text")
    else:
        rng = np.random.default_rng(3)
        base = [f"w{i}" for i in range(60)]
        rows = [(i, " ".join(f"x{i}" if k == p else w for k, w in enumerate(base))) for i, p in enumerate(rng.integers(0, 90, 70).tolist())]
        docs = spark.createDataFrame([*rows, *[(100 + i, " ".join(base)) for i in range(40)]], "doc_id long, text string")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    for module, bound, value in ((common, "BROADCAST_ROWS", 0), (neardup, "BROADCAST_ROWS", 0), (common, "HOT_ROWS", 3), (neardup, "GROUP", 2), (neardup, "GROUPED", 20), (neardup, "ONE_TASK", 0)):
        monkeypatch.setattr(module, bound, value)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()} == want


def test_a_sieve_lets_its_numbers_through_and_few_others(spark):
    numbers = spark.createDataFrame([(i * 7919,) for i in range(3000)] + [(None,), (-5,)], "x long")
    sieve = common.Sieve(numbers)
    rows = spark.range(-10, 40_000).select(F.col("id").alias("x"), F.lit("t").alias("y")).union(numbers.select("x", F.lit("own")))
    through = [r["x"] for r in sieve.through(rows, "x").where("y = 'own'").collect()]
    assert sorted(through) == sorted([i * 7919 for i in range(3000)] + [-5])
    others = sieve.through(rows, "x").where("y = 't'").count()
    assert others < 0.1 * 40_000 and others + sieve.through(rows, "x", inside=False).where("y = 't'").count() == 40_010
    assert common.Sieve(numbers.limit(0)).through(rows, "x").count() == 0
    for bound in (0, 10**6):
        common_rows, common.BROADCAST_ROWS = common.BROADCAST_ROWS, bound
        left = common.without(rows, numbers.where("x is not null"), "x")
        assert left.where("y = 'own' and x is not null").count() == 0 and left.where("x is null").count() == 1 and left.count() == 40_010 - 7 + 1
        common.BROADCAST_ROWS = common_rows


def test_a_join_that_deals_hot_keys_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    left = spark.createDataFrame([(k, i) for k in (None, 1, 2, 3) for i in range((k or 2) * 9)], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (4, "d"), (None, "e")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.hot_join(left, right, ["k"], how).select("k", "i", "v").collect())) == sorted(map(str, left.join(right, ["k"], how).select("k", "i", "v").collect()))


def test_odd_and_no_rows(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    got = {r["doc_id"]: r for r in neardup.near_duplicates(odd(spark), 2).where("doc_id is not null").collect()}
    assert got[9001]["n_shingles"] == got[9003]["n_shingles"] == 0 and got[9002]["kept"]
    assert got[9004]["n_shingles"] == 1
