"""Additions: the hourly crawl log and the frontier over streams (the batch forms are in operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quadrille.operators import frontier


def crawl_log(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(hour, responses, successes, plds) of a stream (ts, pld, status); hours close `lateness` after their end.

    Distinct domains are estimated, as an exact set would have to be kept for each open hour.
    """
    hours = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"))
    return hours.agg(F.count("*").alias("responses"), F.sum((F.col("status") == 200).cast("long")).alias("successes"), F.approx_count_distinct("pld").alias("plds")).select(F.col("window.start").alias("hour"), "responses", "successes", "plds")


def grow_frontier(links: DataFrame, path: str) -> DataStreamWriter:
    """Merges a stream of link counts (uri, n) into frontier versions path/v=<batch>; a replayed batch is written over."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("uri").agg(F.sum("n").alias("n"))
        if number:
            old = spark.read.parquet(f"{path}/v={number - 1}").select("uri", "n", "done")
        else:
            old = new.limit(0).withColumn("done", F.lit(False))
        frontier.merge(old, new).write.mode("overwrite").parquet(f"{path}/v={number}")

    return links.writeStream.foreachBatch(merge)
