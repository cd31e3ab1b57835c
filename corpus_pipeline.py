"""A training corpus from raw documents: quality rules, exact dedup, near dedup, mixing, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return docs' own columns.

Every stage takes empty tables, nulls in any column, texts of any length, repeated rows and extra columns of any name but
those that start with __fp, __mix or __near; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, exact, mix, near, quality
from quadrille.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text is rejected; repeated rows are judged alike, each for itself."""
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one of smallest doc_id (of those that have one). Of rows with equal text and doc_id one stays;
    null texts, which are equal to nothing, stay all; an empty text is a text."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one of smallest doc_id. Null texts, texts without words and rows without a doc_id are in no group
    and stay; rows that share a doc_id stay or go together."""
    return near.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights in tokens, repeated where a source falls short. A null or empty text counts no tokens
    and is taken or left as any other of its sources; rows that share a doc_id (or have none) fare alike; a null lang or source is of no such source."""
    return mix.select_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its doc_id, language and source. A null text has null ids, an empty one an empty list; each repeated row has its own."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", tokens),
]

#: Hash-seeded selection, min-cost flow and byte-pair merges are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
