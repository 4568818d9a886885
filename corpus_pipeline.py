"""Corpus pipeline: documents without toxic texts, exact copies and near duplicates, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last one
returns the pieces of the packed sequences. `run` writes each stage's result as Parquet and reads it for the next.

Every stage decides row by row, by the row's own text, whatever doc_ids repeat or are missing: a toxic row goes, of equal
and of nearly equal texts the row with the smallest doc_id stays (a null doc_id last). Null texts count as empty, which are
copies of each other. Extra columns pass through, whatever their names, up to the packing; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labelwright.llm import common, exact, jaccard, packing, toxicity

CAPACITY, END = 1024, 2


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END)


STAGES = [("toxicity", toxic), ("exact_dedup", exact_copies), ("ngram_jaccard_join", near_copies), ("best_fit_packing", pack)]

#: The classifier and the packing are beyond SQL; tests/llm/test_rows.py holds the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
