"""From raw documents to a training mixture: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.

* language: a text without letters can't be named and goes; a missing lang is
  filled with the prediction.
* near_duplicates: one document of each group stays; two documents are linked from
  a similarity of ``SIMILAR`` percent on, and a link at just that is missed with a
  chance of (1 - 0.8**5)**25 = 5e-5.
* benchmark: documents that hold a benchmark item go.
* personal_data: spans are masked in the text; every document stays.
* mixture: one row for each document that the mixture takes, with the number of
  its copies and the words they count.

An empty table, null texts and null ids pass through every stage; what each
does with them is in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, language, minhash, mixing, pii
from keyloom.llm.common import written

SIMILAR = 80


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = language.identify(docs, language.train(docs)).filter(F.col("lang_pred") != "und")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, SIMILAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).filter("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixture", mixture),
]

#: Language models, sketches and alignments are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
