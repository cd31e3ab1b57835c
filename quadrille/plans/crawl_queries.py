"""Queries on crawl logs and frontiers; events stand for a log and pages for crawled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import frontier, stats
from quadrille.plans.book import Book, pld
from quadrille.session import written
from quadrille.sources.quads import views

BOOK = Book()
_LOG = "SELECT event_id AS id, ts, concat('site', user_id % 40, '.example.org') AS pld, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'purchase' THEN 303 WHEN 'signup' THEN 301 ELSE 404 END AS status, CASE WHEN event_type = 'view' THEN 'application/rdf+xml' ELSE 'text/html' END AS content, CASE WHEN event_id % 10 = 0 THEN '/robots.txt' ELSE concat('/d/', event_id) END AS url FROM {}"
_WITH = f"WITH lg AS ({_LOG.format('events')})"


def _log(spark, d):
    return spark.sql(_LOG.format("{events}"), events=spark.read.parquet(f"{d}/events.parquet"))


@BOOK.add("agg_crawl_log", f"{_WITH}, f AS (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('hour', min(ts) OVER (PARTITION BY pld))::TIMESTAMP AS first FROM lg) SELECT hour, count(*) AS responses, count(DISTINCT pld) AS plds, count(DISTINCT CASE WHEN first = hour THEN pld END) AS new_plds, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END)::BIGINT AS successes FROM f GROUP BY hour", raw=True)
def agg_crawl_log(spark, d):
    return stats.crawl_log(_log(spark, d))


@BOOK.add("win_session_log", f"{_WITH}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS far FROM lg WINDOW w AS (PARTITION BY pld ORDER BY ts, id)), h AS (SELECT *, sum(far) OVER (PARTITION BY pld ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT pld, session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM h GROUP BY pld, session", raw=True)
def win_session_log(spark, d):
    return stats.log_sessions(_log(spark, d))


_STATUS = f"{_WITH}, st AS (SELECT pld, sum(CASE WHEN status = 200 AND content = 'application/rdf+xml' THEN 1 ELSE 0 END)::BIGINT AS useful, sum(CASE WHEN NOT (status = 200 AND content = 'application/rdf+xml') AND status NOT IN (301, 302, 303) THEN 1 ELSE 0 END)::BIGINT AS useless FROM lg WHERE NOT ends_with(url, '/robots.txt') GROUP BY pld)"


@BOOK.add("agg_status", f"{_STATUS} SELECT * FROM st", raw=True)
def agg_status(spark, d):
    return stats.status_counts(_log(spark, d))


@BOOK.add("cr_pldscore", f"{_STATUS} SELECT pld, round((useful + 10) / (useful + useless + 10)::DOUBLE, 9) AS score FROM st", raw=True)
def cr_pldscore(spark, d):
    return stats.domain_scores(stats.status_counts(_log(spark, d))).withColumn("score", F.round("score", 9))


_LINKS = ", ln AS (SELECT uri, count(*) AS n FROM (SELECT DISTINCT c, unnest([s, p, o]) AS uri FROM quads) WHERE starts_with(uri, '<') GROUP BY uri)"
_FRONT = f"{_LINKS}, fr AS (SELECT uri, sum(n)::BIGINT AS n, bool_or(done) AS done FROM (SELECT uri, n, FALSE AS done FROM ln UNION ALL SELECT DISTINCT c, 1, TRUE FROM quads) GROUP BY uri)"


@BOOK.add("cr_links", f"{_LINKS} SELECT uri, n FROM ln")
def cr_links(spark, d):
    return frontier.count_links(views(spark, d, "quads")[0])


def _frontier(spark, d):
    q = views(spark, d, "quads")[0]
    done = q.select(F.col("c").alias("uri")).distinct().select("uri", F.lit(1).cast("long").alias("n"), F.lit(True).alias("done"))
    return frontier.merge(done, frontier.count_links(q))


@BOOK.add("cr_frontier", f"{_FRONT} SELECT uri, n, done FROM fr")
def cr_frontier(spark, d):
    return _frontier(spark, d)


@BOOK.add("srt_links", f"{_FRONT} SELECT uri, n FROM fr WHERE NOT done")
def srt_links(spark, d):
    return frontier.schedule(_frontier(spark, d))


@BOOK.add("cr_rounds", f"{_FRONT}, t AS (SELECT uri, n, row_number() OVER (PARTITION BY {pld('uri')} ORDER BY n DESC, uri) AS round FROM fr WHERE NOT done) SELECT uri, round FROM t WHERE round <= 40 ORDER BY round, n DESC, uri LIMIT 100")
def cr_rounds(spark, d):
    return frontier.rounds(_frontier(spark, d), 40, 100)


@BOOK.add("cr_queue", f"{_FRONT}, t AS (SELECT uri, n, row_number() OVER (PARTITION BY {pld('uri')} ORDER BY n DESC, uri) AS k FROM fr WHERE NOT done) SELECT uri, n FROM t WHERE k <= 50")
def cr_queue(spark, d):
    return frontier.limit_domains(_frontier(spark, d), 25)


@BOOK.add("src_http", """WITH b AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS h FROM pages) SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h WHEN starts_with(h, '/') THEN base || h ELSE base || '/' || h END AS link FROM b""", raw=True)
def src_http(spark, d):
    return frontier.links_of_pages(spark.read.parquet(f"{d}/pages.parquet"))


@BOOK.add("cr_master", None)
def cr_master(spark, d):
    """Two rounds of a crawl over the pages, as (crawl, uri, round): what the first fetches is done, and its links feed the second."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    seeds = pages.select(F.col("url").alias("uri"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("done")).distinct()
    first = written(frontier.rounds(seeds, 5, 1000), "crawl-first")
    fetched = pages.join(first, pages["url"] == first["uri"], "left_semi")
    links = frontier.links_of_pages(fetched).groupBy(F.col("link").alias("uri")).agg(F.count("*").alias("n"))
    known = seeds.unionByName(first.select("uri", F.lit(0).cast("long").alias("n"), F.lit(True).alias("done")))
    second = frontier.rounds(frontier.merge(known, links), 5, 1000)
    return first.select(F.lit(1).alias("crawl"), "uri", "round").union(second.select(F.lit(2), "uri", "round"))
