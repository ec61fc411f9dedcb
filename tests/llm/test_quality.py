import math
import re
from collections import Counter

from sortloom.llm import quality
from tests.llm.helpers import both, empty, odd

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = SPACE.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark):
    docs = both(spark, 400)
    got = sorted((tuple(r) for r in quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in docs.collect():
        b = brute(r["text"])
        want.append((r["doc_id"], *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want, key=str)


def test_distance_equals_brute_force(spark):
    p, q = [3.0, 0.0, 1.0], [0.2, 0.5, 0.3]
    s = [x / 4 for x in p]
    m = [(a + b) / 2 for a, b in zip(s, q, strict=True)]
    want = math.sqrt(sum(0.5 * x * math.log2(x / c) for v in (s, q) for x, c in zip(v, m, strict=True) if x))
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality.distance(quality.shares(F.array(*map(F.lit, p))), F.array(*map(F.lit, q)))).first()[0]
    assert abs(got - want) < 1e-12


def classes_of(text):
    w = "".join(SPACE.findall(text or ""))
    of = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 4 if c in ".,;:!?'\"()-" else 5 if c < "\x80" else 3 if "\xc0" <= c <= "\u024f" else 6
    n = Counter(map(of, w))
    return [n[i] for i in range(7)]


def js(p, q):
    half = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, 0.5 * sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True))))


def test_kept_and_distances_equal_brute_force(spark):
    """The method in plain Python: references from all rows, the nearest of them, guards."""
    docs = both(spark, 700)
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    common = quality.common_words(docs)
    assert set(common) == {r[1] for r in rows} - {None} and all(len(x) == len(set(x)) <= quality.PER_LANGUAGE for x in common.values())
    words = [Counter(SPACE.findall(t or "")) for _, _, t in rows]
    times = lambda n, w: n[w] + (n[w[:1].upper() + w[1:]] if w[:1].upper() != w[:1] else 0)
    rest = lambda x: [*x, max(0.0, 1 - sum(x))]
    known = []
    for label in sorted(common):
        own = [i for i, r in enumerate(rows) if r[1] == label]
        classes = [sum(x) for x in zip(*(classes_of(rows[i][2]) for i in own), strict=True)]
        n = sum(sum(words[i].values()) for i in own)
        if sum(classes):
            known.append(([x / sum(classes) for x in classes], rest([sum(times(words[i], w) for i in own) / n for w in common[label]]), common[label]))
    want = []
    for (d, _, t), n in zip(rows, words, strict=True):
        b, c = brute(t), classes_of(t)
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        p = [x / max(1, sum(c)) for x in c]
        far = min((js(p, q) + (y := js(rest([times(n, w) / max(1, b[0]) for w in own]), r)), js(p, q), y) for q, r, own in known)
        a, y = far[1] if b[1] >= quality.LEAST_CHARS else None, far[2] if b[0] >= quality.LEAST_WORDS else None
        kept = not failed and not (a or 0) > quality.FAR_CLASSES and not (y or 0) > quality.FAR_WORDS
        want.append((d, *b, failed, kept, a and round(a, 9), y and round(y, 9)))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], r["class_distance"] and round(r["class_distance"], 9), r["word_distance"] and round(r["word_distance"], 9)) for r in quality.judged(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 20 < sum(not w[7] and not w[6] for w in want) + 19


def test_every_label_has_a_reference(spark):
    """100 labels, each with words of its own: all are learned, and a text is near its own label's."""
    rows = [(i, " ".join([f"w{chr(97 + i % 10)}{chr(97 + i // 10 % 10)}"] * 30 + [f"{chr(97 + j % 26)}x{i}q{j}" for j in range(70)]), f"l{i % 100:02d}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(quality.common_words(docs)) == 100
    assert all(r["word_distance"] < 0.3 for r in quality.judged(docs).collect())


def test_common_words_are_counted_over_all_documents(spark):
    """Words of nearly the same frequency: their order is right only if every document counts."""
    rows = [(i, " ".join(["Plain", "odd1", *(f"w{chr(97 + k)}" for k in range(26) if (i * 7919 + k * 31) % 1200 < 1100 - 6 * k)]), "xy" if i % 2 else "zz") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {}
    for label in ("xy", "zz"):
        n = Counter(w for _, t, lang in rows if lang == label for w in t.lower().split() if re.fullmatch(r"[^\W\d_]+", w))
        want[label] = [w for w, k in sorted(n.items(), key=lambda x: (-x[1], x[0])) if k >= 3][: quality.PER_LANGUAGE]
    assert quality.common_words(docs) == want


def test_junk_goes_and_prose_stays(spark):
    rows = quality.judged(both(spark, 1000)).alias("k")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {(r["quality"], r["kept"]): r["count"] for r in rows.join(labels, "doc_id").where("n_words >= 20 and not base_failed").groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) == 0 and got[(0, False)] >= got.get((0, True), 0)


def test_no_labels_and_no_rows(spark):
    assert quality.judged(empty(spark)).count() == 0
    rows = quality.judged(odd(spark).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
