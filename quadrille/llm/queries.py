"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, exact, mix, near, pii, quality, secrets, tokens_out, toxicity, urls
from quadrille.llm.common import fresh_path, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.tag(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.screen(read(spark, sf_dir, "pages"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokens_out.write(read(spark, sf_dir, "documents"), path)
    return spark.read.parquet(path)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mixture(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.where(F.size("quality.rejected_by") == 0).select("doc_id", *(F.col("quality")[m].alias(m) for m in quality.MEASURES))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_url_filter, op4_token_output, op5_source_mix, op6_bpe, op7_secrets, op8_quality_rules, op9_ngram_jaccard, op10_exact_dedup, pipeline)}

SQL = {
    "op3_url_filter": urls.duckdb_sql(),
    "op8_quality_rules": quality.duckdb_sql(),
    "op10_exact_dedup": exact.duckdb_sql(),
    "op9_ngram_jaccard": near.duckdb_sql(),
}
