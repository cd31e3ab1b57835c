"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.session import forget, fresh_path, written

__all__ = ["forget", "fresh_path", "read", "written"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
