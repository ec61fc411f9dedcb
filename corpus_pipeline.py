"""From raw documents to token ids, in stages: STAGES in order, each on all that the stage before has kept.

run(spark, sf_dir) applies them to the table documents; each stage's rows are written as a table in the shared
folder and read again. All stages but the last return the columns of documents.

1. language: documents without letters, or without a language that the score vouches for, go.
2. near duplicates: of documents linked by five-word shingles at a similarity of 0.8 one stays, that with the smallest doc_id.
3. decontamination: documents that hold a benchmark item, up to a fifth of its words in edits, go.
4. personal data: spans are replaced by their kind; n_chars follows the text.
5. tokens: ids of the text, checked against their library where a stretch begins with a blank, and the digest of what they decode to.

Defined results: null and empty texts go at the first stage; every row is decided by its own text, whether
its doc_id is missing or repeated; of linked rows without doc_id, or with the same, one stays, and ids go before none; rows that
repeat an id and text count as one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm import decontaminate, languages, neardup, personal, sentencepieces
from sortloom.llm.common import kept, kept_alone, let_go, table, without

#: The least language score that a document stays with.
LEAST_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.spoken(docs.select(COLUMNS), languages.learned_outside(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = docs.withColumn("row", F.col("doc_id").cast("bigint"))
    else:  # ids don't tell rows apart: numbers in the order of ids do, and are written down with the rows
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
        rows = kept(docs.dropDuplicates(["doc_id", "text"]).orderBy(*order).withColumn("row", F.monotonically_increasing_id()))
    found = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size=5, percent=80)
    gone = kept(found.where("not kept").select(F.col("doc_id").alias("row")))
    return without(rows, gone, "row").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.uncontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.redacted(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
#: Trained models, edit distances and token merges are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, kept_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        let_go(before)
    return STAGES[-1][1](spark, docs, sf_dir)
