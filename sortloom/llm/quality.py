"""Quality rules, natively: fixed base rules, and the divergence of a document's histograms from references.

The method: a document's histogram of character classes and its histogram of common words are compared with
references by the Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). Each label of a language
has one pair of references, summed over all documents that have it: shares of the character classes, and shares of the language's
own PER_LANGUAGE common words and of all other words. A document's distances are those to the language whose pair is
nearest. A document is refused if it is farther than FAR_CLASSES or FAR_WORDS. Guards: a histogram of fewer than
LEAST_CHARS characters or LEAST_WORDS words isn't compared.

Which words are common is counted over all documents of a label, as their shares and those of the classes are.
Every label has a reference of its own; more than LABELS of them are no languages and an error.

Everything else that reads texts is one native expression on the row, evaluated once into a table of counts;
nothing is shuffled but each task's distinct words with their counts, and the references' sums.

Defined results: null and wordless texts have no words, fail the base rule and are not kept; texts of any
length are read whole; runs of eight words are told apart by a 64-bit hash within a text; without any label there
are no references and the method refuses nothing; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sortloom.llm.common import SPACES, bound, kept, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Distances beyond which a document is refused, and the least lengths to compare.
FAR_CLASSES, FAR_WORDS, LEAST_CHARS, LEAST_WORDS = 0.32, 0.34, 200, 60
#: Common words of a language; how often a word must be there; labels, at most.
PER_LANGUAGE, LEAST_SEEN, LABELS = 24, 3, 10_000
N_CLASSES = 7


#: What the words without a-z are taken apart into, one after the other; what is left then is symbols and other characters.
TAKEN = {"stop": r"[.,;:!?'\"()-]+", "upper": "[A-Z]+", "digit": "[0-9]+"}


def class_counts(word_chars: Column) -> Column:
    """Characters of the words by class: a-z, A-Z, digits, accented letters, stops, symbols, others, from the columns rest, no_stop, no_upper, no_digit."""
    left = [F.length(c) for c in ("rest", *(f"no_{k}" for k in TAKEN))]
    plain = F.regexp_replace("no_digit", r"[\x{C0}-\x{24F}]+", "")
    beyond = F.length(F.regexp_replace(plain, r"[\x00-\x7F]+", ""))
    counts = (word_chars - left[0], left[1] - left[2], left[2] - left[3], left[3] - F.length(plain), left[0] - left[1], F.length(plain) - beyond, beyond)
    return F.array(*[x.cast("double") for x in counts])


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """For each label its common words, in lower case, the most frequent first."""
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    labels = rows.select("lang").distinct().limit(LABELS + 1).collect()
    if len(labels) > LABELS:
        raise ValueError(f"lang has more than {LABELS} values")
    if not labels:
        return {}
    words = rows.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).where(F.rlike("word", F.lit(r"^\p{L}+$")))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = words.groupBy("lang", "word").count().where(f"count >= {LEAST_SEEN}").withColumn("place", F.row_number().over(order)).where(f"place <= {PER_LANGUAGE}")
    out: dict[str, list[str]] = {r["lang"]: [] for r in labels}
    for r in top.orderBy("lang", "place").collect():
        out[r["lang"]].append(r["word"])
    return out


def hashed(spark: SparkSession, words: dict[str, list[str]]) -> dict[str, list[tuple[int, int]]]:
    """For each label the hashes of its words as they are and with a capital, as the rows' words are hashed."""
    flat = sorted({w for each in words.values() for w in each})
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(flat)), "array<string>")).alias("w"))
    code = {r["w"]: (r["a"], r["b"]) for r in rows.select("w", F.xxhash64("w").alias("a"), F.xxhash64(F.concat(F.upper(F.substring("w", 1, 1)), F.expr("substring(w, 2)"))).alias("b")).collect()}
    return {label: [code[w] for w in each] for label, each in words.items()}


def tallied(hashes: Column) -> Column:
    """map<hash, times> of an array of hashes."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i)))

    return bound(F.sort_array(hashes), runs)


def runs_of_four(h: Column) -> Column:
    """A hash of each run of four words, from theirs."""
    return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 3, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3)))


def doubled(runs: Column, step: int) -> Column:
    """Hashes of runs twice as long, from those of runs of `step` words."""
    n = F.greatest(F.size(runs) - step, F.lit(0))
    return F.zip_with(F.slice(runs, F.lit(1), n), F.slice(runs, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def twins(order: Column) -> Column:
    """Of sorted (hash, place) the places whose hash stands next to an equal one, in order."""
    n = F.size(order)
    no = F.array(F.lit(None).cast("bigint"))
    hashes = F.transform(order, lambda x: x["h"])
    after = F.concat(F.slice(hashes, F.lit(2), n), no)
    before = F.concat(no, F.slice(hashes, F.lit(1), n - 1))
    same = F.zip_with(after, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    marked = F.zip_with(order, same, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def covered(places: Column) -> Column:
    """How many words runs of WINDOW words from these places cover."""
    steps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def measures(docs: DataFrame, vocabulary: list[int]) -> DataFrame:
    """doc_id, lang, the base counts, the histogram of classes and the words of the vocabulary (by hash) with their counts, of each row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"))
    rows = rows.withColumn("w", words_of(F.col("t"))).withColumn("ink", F.array_join("w", "")).withColumn("rest", F.regexp_replace("ink", "[a-z]+", ""))
    before = "rest"
    for name, pattern in TAKEN.items():
        rows = rows.withColumn(f"no_{name}", F.regexp_replace(before, pattern, ""))
        before = f"no_{name}"
    # A run of eight words that is there twice holds one of four that is: only then are the eights hashed.
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("r4", runs_of_four(F.col("h")))
    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    eights = F.transform(doubled(F.col("r4"), 4), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    rows = rows.withColumn("o", F.when(F.size("r4") > F.size(F.array_distinct("r4")), F.sort_array(eights)).otherwise(none))
    rows = rows.withColumn("c", F.when(F.size("o") > 0, twins(F.col("o"))).otherwise(F.expr("cast(array() as array<int>)")))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length("ink"),
        "n_symbols": F.length("no_digit") - F.length(F.translate("no_digit", SYMBOLS, "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("c") > 0, covered(F.col("c"))).otherwise(0),
    }
    common = tallied(F.filter("h", lambda x: x.isin(vocabulary))) if vocabulary else F.expr("cast(map() as map<bigint, int>)")
    return rows.select("doc_id", "lang", *[v.cast("bigint").alias(k) for k, v in counts.items()], class_counts(F.length("ink")).alias("classes"), common.alias("common"))


def times(common: Column, x: Column) -> Column:
    """How often a word x, of hashes a and b, is among the common words; a and b are the same where it has no capital."""
    first = F.coalesce(F.element_at(common, x["a"]), F.lit(0))
    return first + F.when(x["a"] == x["b"], 0).otherwise(F.coalesce(F.element_at(common, x["b"]), F.lit(0)))


def references(counts: DataFrame, words: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """For each label, shares of the classes and, of its common words by their hashes, shares of all words, over all its documents."""
    if not words:
        return []
    own = F.from_json(F.lit(json.dumps({label: [{"a": a, "b": b} for a, b in each] for label, each in words.items()})), "map<string, array<struct<a: bigint, b: bigint>>>")
    rows = counts.where("lang is not null").withColumn("own", F.transform(F.element_at(own, F.col("lang")), lambda x: times(F.col("common"), x)))
    sums = [F.sum(F.col("classes")[i]).alias(f"a{i}") for i in range(N_CLASSES)] + [F.sum(F.get("own", F.lit(i))).alias(f"b{i}") for i in range(PER_LANGUAGE)]
    out = []
    for r in rows.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).orderBy("lang").collect():
        chars, n = sum(r[f"a{i}"] for i in range(N_CLASSES)), r["n"]
        if chars and n and r["lang"] in words:
            out.append({"classes": [r[f"a{i}"] / chars for i in range(N_CLASSES)], "words": [{"a": a, "b": b, "share": (r[f"b{i}"] or 0) / n} for i, (a, b) in enumerate(words[r["lang"]])]})
    return out


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda acc, v: acc + v)
    return F.zip_with(counts, F.array_repeat(F.greatest(total, F.lit(1.0)), F.size(counts)), lambda v, t: v / t)


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)))


def with_rest(some: Column) -> Column:
    """Shares of some words, and what is left for all others."""
    return F.concat(some, F.array(F.greatest(F.lit(0.0), 1.0 - F.aggregate(some, F.lit(0.0), lambda acc, v: acc + v))))


def judged(docs: DataFrame, far_classes: float = FAR_CLASSES, far_words: float = FAR_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the distances that the method went by (null: not compared)."""
    words = hashed(docs.sparkSession, common_words(docs))
    counts = kept(measures(docs, sorted({x for each in words.values() for ab in each for x in ab})))
    known = references(counts, words)
    rows = counts.withColumn("p", shares(F.col("classes")))
    listed = F.from_json(F.lit(json.dumps(known)), "array<struct<classes: array<double>, words: array<struct<a: bigint, b: bigint, share: double>>>>")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def far(r: Column) -> Column:
        from_classes = distance(F.col("p"), r["classes"])
        from_words = distance(with_rest(F.transform(r["words"], lambda x: times(F.col("common"), x) / n)), with_rest(F.transform(r["words"], lambda x: x["share"])))
        return bound(F.struct(from_classes.alias("classes"), from_words.alias("words")), lambda d: F.struct((d["classes"] + d["words"]).alias("both"), d["classes"].alias("classes"), d["words"].alias("words")))

    rows = rows.withColumn("near", F.array_min(F.transform(listed, far)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    from_classes = F.when(F.col("word_chars") >= LEAST_CHARS, F.col("near.classes"))
    from_words = F.when(F.col("n_words") >= LEAST_WORDS, F.col("near.words"))
    refused = F.coalesce(from_classes > far_classes, F.lit(False)) | F.coalesce(from_words > far_words, F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~refused).alias("kept"), from_classes.alias("class_distance"), from_words.alias("word_distance")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
