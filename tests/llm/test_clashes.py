"""Other columns of the tables, named as operators name their own, change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sortloom.llm import decontaminate, languages, licenses, neardup, personal, quality, secrets, sentencepieces, substrings, urls
from tests.llm.helpers import SF, both, sampled

NAMES = ("spans", "base", "t", "w", "h", "r4", "rest", "low", "found", "row", "key", "node", "place", "draw", "deal", "deals", "rows", "groups", "sieve_cell", "state", "digest", "uid", "pos", "kind", "ids", "host", "path", "rule", "item_id", "n_words", "score", "near", "label")


def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


OPERATORS = {
    "decontaminate": lambda spark, docs: decontaminate.contaminated(docs, benchmark(spark).withColumn("text2", F.lit("x"))),
    "secrets": lambda spark, docs: secrets.find_secrets(docs),
    "personal": lambda spark, docs: personal.find_personal(docs),
    "languages": lambda spark, docs: languages.identify(docs, languages.learned_outside(docs)),
    "sentencepieces": lambda spark, docs: sentencepieces.encode_documents(docs).drop("n_checked"),
    "licenses": lambda spark, docs: licenses.scan(docs),
    "quality": lambda spark, docs: quality.judged(docs),
    "neardup": lambda spark, docs: neardup.near_duplicates(docs, 2),
    "substrings": lambda spark, docs: substrings.remove_repeated(docs, 35),
}


def with_others(df):
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES if n not in df.columns])


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    docs = both(spark, 80)
    rows = lambda d: sorted(map(str, OPERATORS[name](spark, d).collect()))
    assert rows(with_others(docs)) == rows(docs)


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = lambda p: sorted(map(str, urls.judge(p, urls.rules_frame(spark, urls.RULES)).collect()))
    assert rows(with_others(pages)) == rows(pages)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, k):
    docs = sampled(spark, 60)
    stage = corpus_pipeline.STAGES[k][1]
    rows = lambda d: sorted(map(str, stage(spark, d, SF).collect()))
    assert rows(with_others(docs)) == rows(docs)


def test_redaction_keeps_other_columns(spark):
    docs = with_others(sampled(spark, 60))
    got = personal.redacted(docs)
    assert got.columns == docs.columns and got.where("spans <> 'clash' or base <> 'clash'").count() == 0
