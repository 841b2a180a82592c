"""From raw documents to packed windows: five stages over the whole table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.  Each
begins by having the executors give back the memory that the one before took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import language_id, line_dedup, mixing, ngram_join, packing
from chronoloom.llm.queries import tokenizer_path
from chronoloom.llm.shared import durable, fold, heaps_give_back, read_table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; learned from three quarters of them."""
    heaps_give_back(spark)
    model = language_id.fit(docs, where=fold(F.col("doc_id"), 4) != 2)
    return language_id.keep_accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_give_back(spark)
    return line_dedup.dedup_documents(docs)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five words, similarity 0.8."""
    heaps_give_back(spark)
    return ngram_join.keep_one_each(docs, k=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_give_back(spark)
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    heaps_give_back(spark)
    # its workers stand beside JVMs that have grown in the stages before
    return packing.pack(docs, tokenizer_path(), cache_words=50_000)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", ngram_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Compression sizes and tokenizer ids cannot be had in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
