"""Streams against the batch forms."""

from pyspark.sql import functions as F

from quadrille.session import fresh_path
from quadrille.streaming import crawl


def test_hourly_log_of_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", f"site{m % 3}", 200 if m % 2 else 404) for h in range(5) for m in range(0, 60, 10)]
    events = spark.createDataFrame(rows, "ts string, pld string, status int").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = crawl.crawl_log(stream, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    query.processAllAvailable()
    query.stop()
    got = [tuple(r) for r in spark.sql("SELECT hour(hour), responses, successes, plds FROM hours ORDER BY 1").collect()]
    assert got == [(h, 6, 0, 3) for h in range(5)]


def test_frontier_grows_by_batches(spark, tmp_path):
    links = spark.createDataFrame([("<http://a>", 2), ("<http://b>", 1), ("<http://a>", 3)], "uri string, n long")
    links.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(links.schema).parquet(f"file://{tmp_path}/in")
    out = fresh_path(spark, "frontier")
    query = crawl.grow_frontier(stream, out).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.processAllAvailable()
    links.repartition(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    got = {r.uri: (r.n, r.done) for r in spark.read.parquet(f"{out}/v=1").collect()}
    assert got == {"<http://a>": (10, False), "<http://b>": (2, False)}
