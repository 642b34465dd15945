"""A training-corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``docs``, whatever they are; the last one returns packed pieces.

1. language: documents without a letter (``und``) or whose words are unsure of their
   languages (mean of each word's largest marginal under ``LEAST_CERTAINTY``) go; mixed
   languages alone are no reason.
2. toxicity: documents scored 0.5 or more go.
3. exact dedup: of equal texts the row with the smallest id stays.
4. near dup: of each group linked by five-word shingles at a similarity of 0.8 or more,
   one row stays, of the smallest id; rows that share an id are told apart by their
   texts. Texts without a word stay.
5. packing: the rest becomes sequences of at most 2048 tokens.

Defined results: null texts go in stage 1; a null id is a document of its own; empty
tables give empty results with the same columns. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import exact_dedup, language, ngram_join, packing, toxicity
from lodestack.llm.common import free_name, written

#: Under this mean of each word's largest marginal the words are worse than a coin toss between two languages.
LEAST_CERTAINTY = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    crf = language.train(docs, language.held_out("doc_id"))
    found = free_name(docs, "language_found")
    scored = docs.withColumn(found, language.language_of(F.col("text"), crf))
    return scored.where((F.col(found)["lang"] != language.UNKNOWN) & (F.col(found)["certainty"] >= LEAST_CERTAINTY)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.held_out("doc_id"))
    score = free_name(docs, "toxicity_score")
    return docs.withColumn(score, toxicity.toxicity_of(F.col("text"), lexicon)).where(F.col(score) < 0.5).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_checksums(packing.pack(docs))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dup", near_dup_stage),
    ("packing", packing_stage),
]

#: Learned models and the tokenizer are beyond SQL; tests/llm holds every stage, and run() as a whole, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
