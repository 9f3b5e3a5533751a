"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, mixing.

Each stage works on all that the one before kept and returns the columns of
its input, whatever their names; the last one returns the mix.

Defined cases: a null text counts as empty and stays null where its row stays;
an empty text is clean, and one of all empty texts stays as their
representative; rows that repeat id and text are one; a null id is never
learned from and comes last among near-duplicates; a very long text is scored,
compared, scanned and cleaned as a whole; without labels no document is toxic,
and without items none is contaminated; of equal documents the smallest id
stays; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.common import table
from loomspark.llm.decontam import drop_leaks
from loomspark.llm.mixing import mix
from loomspark.llm.pii import clean
from loomspark.llm.simhash import first_of_each
from loomspark.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), similarity=0.8, recall=0.99)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, weights=(1, 2, 3), most=3)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mixing", mixing)]

#: Learning, fingerprints and random walks are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
