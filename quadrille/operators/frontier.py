"""Crawl frontier: link counts, done marks, limits by domain and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as t


def count_links(quads: DataFrame) -> DataFrame:
    """(uri, n): documents that mention each IRI in subject, predicate or object."""
    rows = quads.select("c", F.explode(F.array("s", "p", "o")).alias("uri")).where(t.is_iri(F.col("uri"))).distinct()
    return rows.groupBy("uri").agg(F.count("*").alias("n"))


def merge(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """(uri, n, done) of a frontier (uri, n, done) and new counts (uri, n): counts add up, done stays done."""
    return frontier.unionByName(links.withColumn("done", F.lit(False))).groupBy("uri").agg(F.sum("n").alias("n"), F.max("done").alias("done"))


def schedule(frontier: DataFrame) -> DataFrame:
    """(uri, n) still to be crawled, most-linked first."""
    return frontier.where("NOT done").select("uri", "n").orderBy(F.desc("n"), "uri")


def limit_domains(frontier: DataFrame, most: int) -> DataFrame:
    """At most 2 * most URIs of each domain, most-linked first."""
    w = Window.partitionBy(t.pay_level_domain(F.col("uri"))).orderBy(F.desc("n"), "uri")
    return frontier.where("NOT done").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= 2 * most).select("uri", "n")


def rounds(frontier: DataFrame, most: int, target: int) -> DataFrame:
    """(uri, round): domains take turns, `most` rounds at most, until `target` URIs are given out."""
    pld = t.pay_level_domain(F.col("uri"))
    turn = F.row_number().over(Window.partitionBy(pld).orderBy(F.desc("n"), "uri"))
    return frontier.where("NOT done").withColumn("round", turn).where(F.col("round") <= most).orderBy("round", F.desc("n"), "uri").limit(target).select("uri", "round")


def poll(frontier: DataFrame, scores: DataFrame, seed: int = 1) -> DataFrame:
    """(uri, n) that pass a seeded draw with the probability of their domain's score; unknown domains pass."""
    rows = frontier.withColumn("pld", t.pay_level_domain(F.col("uri"))).join(scores, "pld", "left")
    draw = F.pmod(F.xxhash64("uri", F.lit(seed)), F.lit(1_000_000)) / 1e6
    return rows.where(draw < F.coalesce("score", F.lit(1.0))).select("uri", "n")


def links_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, link): absolute targets of the pages' href attributes."""
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), 1))
    rows = pages.select("page_id", base.alias("base"), href.alias("href"))
    link = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.concat("base", F.lit("/"), "href"))
    return rows.select("page_id", link.alias("link")).distinct()
