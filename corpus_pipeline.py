"""A corpus pipeline of five stages: clean, deduplicate, pseudonymize, pack.

Each stage is (name, function of (session, documents, folder of tables)); what it returns is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents.

Defined cases: a null text is the empty text to every stage; an empty table passes through; columns besides those
of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sqlverdict.llm import exact_dedup, near_dup, packing, pii, toxicity
from sqlverdict.llm._spark import load, written
from sqlverdict.llm.bpe import tokenizer_file


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymize(docs, pii.key_of(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs, tokenizer_file())


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dup", near), ("pii", private), ("packing", pack)]
#: The first and third stages are learned and sketched: no SQL gives their rows, so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
