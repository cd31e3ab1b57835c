"""Token ids as Parquet lists, laid out for selective reads.

`write` stores one row for each document: ids of tokens as a list<int> column, and metadata. Encodings
are chosen by column: ids are few distinct small numbers, so the list is dictionary-encoded (16 bits or
fewer for a vocabulary of 50,000); doc_id and n_tokens are delta-encoded (format version 2 without a
dictionary); lang and source keep dictionaries. Row groups and pages have set sizes, and pages have
column and offset indexes (minimum, maximum, place), so that a reader can skip pages. Texts are dealt to tasks by ranges
of doc_id (a doc_id that many rows share is cut by a hash of the text) and rows are sorted by doc_id within each file, so that a file, a row group and a page each
hold a narrow range of doc_id.

`read_metadata` reads no token pages, `read_tokens` only the row groups and pages whose doc_id range is
wanted: both leave that to Parquet's pushed-down filters and pruned columns.

Nulls in any column are stored as nulls; a null text has a null list, an empty text an empty list. Rows
that repeat are stored each. Texts are encoded whole. Extra columns of the documents aren't written
unless named in `metadata`; a name that clashes with token_ids or n_tokens raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe

ROW_GROUP, PAGE = 16 << 20, 64 << 10
METADATA = ("doc_id", "lang", "source")


def options(row_group: int = ROW_GROUP, page: int = PAGE) -> dict[str, str]:
    """Writer settings of the layout."""
    return {
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.page.row.count.limit": "2000",
        "compression": "zstd",
    }


def write(docs: DataFrame, path: str, metadata=METADATA, vocabulary: str = bpe.VOCABULARY, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encodes docs' texts and writes (metadata, n_tokens, token_ids) to path."""
    if clash := {"token_ids", "n_tokens"} & set(metadata):
        raise ValueError(f"metadata may not be named {sorted(clash)}")
    placed = docs.select(*metadata, "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    coded = bpe.encode(placed, vocabulary=vocabulary, compiled=True, round_trip=False, keep=False)
    coded.select(*metadata, "n_tokens", "token_ids").write.options(**options(row_group, page)).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns but the ids, whose pages aren't read."""
    df = spark.read.parquet(path)
    return df.drop("token_ids")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and token_ids of the documents from first to last (both included); others' pages are skipped."""
    df = spark.read.parquet(path).select("doc_id", "token_ids")
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df
