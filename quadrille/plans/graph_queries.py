"""Queries on link graphs and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import joins, rank, stats
from quadrille.plans.book import TYPE, Book, pld, strip
from quadrille.session import written
from quadrille.sources.quads import views

BOOK = Book()

_LINKS = f""", spots AS (SELECT {strip('c')} AS src, s AS x FROM quads UNION ALL SELECT {strip('c')}, o FROM quads WHERE p <> {TYPE}),
links AS (SELECT DISTINCT src, {strip('x')} AS dst FROM spots WHERE starts_with(x, '<') AND src <> {strip('x')})"""
_GRAPH = f"""{_LINKS}, inner_links AS (SELECT DISTINCT l.src, coalesce(r.dst, l.dst) AS dst FROM links l LEFT JOIN redirects r ON l.dst = r.src),
graph AS (SELECT src, dst FROM inner_links WHERE dst IN (SELECT c FROM quads))"""


def _documents(spark, d):
    """(c): the documents of all quads, which are worked through for them once."""
    return written(views(spark, d, "contexts")[0], "documents")


def _graph(spark, d, documents=None):
    documents = documents or _documents(spark, d)
    q, r = views(spark, d, "quads", "redirects", given={"contexts": documents})
    return rank.document_links(q, documents, r)


def _page_rank_sql(graph: str, nodes: str) -> str:
    out = [f", nd AS ({nodes}), nn AS (SELECT count(*) AS n FROM nd), gr AS MATERIALIZED (SELECT DISTINCT src, dst FROM {graph} WHERE src IN (SELECT node FROM nd) AND dst IN (SELECT node FROM nd)), dg AS MATERIALIZED (SELECT src, count(*) AS k FROM gr GROUP BY src)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM nd, nn)"]
    for i in range(rank.ROUNDS):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT nd.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (1 - coalesce((SELECT sum(rank) FROM r{i} WHERE node IN (SELECT src FROM dg)), 0)) / n + 0.85::DOUBLE * coalesce(f.inflow, 0) AS rank FROM nd CROSS JOIN nn LEFT JOIN (SELECT gr.dst, sum(r.rank / dg.k) AS inflow FROM gr JOIN r{i} r ON gr.src = r.node JOIN dg ON dg.src = gr.src GROUP BY gr.dst) f ON f.dst = nd.node)")
    return ",\n".join(out) + f" SELECT node, round(rank, 9) AS rank FROM r{rank.ROUNDS}"


@BOOK.add("g_extract", f"{_LINKS} SELECT src, dst FROM links")
def g_extract(spark, d):
    return rank.extract_links(views(spark, d, "quads")[0])


@BOOK.add("g_extract_schema", f", spots AS (SELECT {strip('c')} AS src, unnest([s, p, o]) AS x FROM quads) SELECT DISTINCT src, {strip('x')} AS dst FROM spots WHERE starts_with(x, '<') AND src <> {strip('x')}")
def g_extract_schema(spark, d):
    return rank.extract_links(views(spark, d, "quads")[0], schema_too=True)


@BOOK.add("g_contexts", "SELECT DISTINCT c FROM quads")
def g_contexts(spark, d):
    return views(spark, d, "quads")[0].select("c").distinct()


@BOOK.add("join_redirect", f"{_GRAPH} SELECT src, dst FROM inner_links")
def join_redirect(spark, d):
    q, r = views(spark, d, "quads", "redirects")
    return joins.redirect(rank.extract_links(q), r)


@BOOK.add("join_semi_ctx", f"{_LINKS} SELECT src, dst FROM links WHERE dst IN (SELECT c FROM quads)")
def join_semi_ctx(spark, d):
    q, documents = views(spark, d, "quads")[0], _documents(spark, d)
    return joins.within(rank.extract_links(q, ends=documents.withColumnRenamed("c", "node")), documents)


@BOOK.add("join_anti_redirect", ", k AS (SELECT DISTINCT c FROM q_ref WHERE c LIKE '%src2%') SELECT src, min(dst) AS dst FROM redirects WHERE src <> dst AND src NOT IN (SELECT c FROM k) GROUP BY src")
def join_anti_redirect(spark, d):
    r, ref = views(spark, d, "redirects", "q_ref")
    return joins.clean_redirects(r, ref.where("c LIKE '%src2%'").select("c").distinct())


@BOOK.add("g_rewrite", f"{_GRAPH} SELECT src, dst, 'out' AS way FROM graph UNION ALL SELECT dst, src, 'in' FROM graph")
def g_rewrite(spark, d):
    g = _graph(spark, d)
    return g.withColumn("way", F.lit("out")).unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("way")))


@BOOK.add("g_pagerank", _GRAPH + _page_rank_sql("graph", "SELECT DISTINCT c AS node FROM quads"))
def g_pagerank(spark, d):
    documents = _documents(spark, d)
    return rank.page_rank(_graph(spark, d, documents), documents.withColumnRenamed("c", "node")).select("node", F.round("rank", 9).alias("rank"))


_DOMAINS = f"{_LINKS}, dl AS (SELECT DISTINCT {pld('src')} AS src, {pld('dst')} AS dst FROM links)"


@BOOK.add("g_pagerank_na", f"{_DOMAINS}, dd AS (SELECT src, dst FROM dl WHERE src <> dst)" + _page_rank_sql("dd", "SELECT src AS node FROM dd UNION SELECT dst FROM dd"))
def g_pagerank_na(spark, d):
    links = written(rank.domain_links(views(spark, d, "quads")[0]), "domain-links")
    return rank.page_rank(links, links.select(F.col("src").alias("node")).union(links.select("dst"))).select("node", F.round("rank", 9).alias("rank"))


@BOOK.add("g_idrank", ", m AS (SELECT DISTINCT s, c FROM quads) SELECT s AS node, round(sum(coalesce(rank, 0.0)), 9) AS rank FROM m LEFT JOIN ranks r ON m.c = r.node GROUP BY s")
def g_idrank(spark, d):
    q, r = views(spark, d, "quads", "ranks")
    return rank.identifier_ranks(q, r).select("node", F.round("rank", 9).alias("rank"))


_SUM = "SELECT DISTINCT s, p, o, c, round(sum(rank) OVER (PARTITION BY s, p, o), 6) AS rank FROM (SELECT DISTINCT * FROM {})"


@BOOK.add("agg_rank_sum", _SUM.format("ranked"))
def agg_rank_sum(spark, d):
    return rank.sum_ranks(views(spark, d, "ranked")[0]).withColumn("rank", F.round("rank", 6))


@BOOK.add("g_rank_triples", ", j AS (SELECT q.*, coalesce(r.rank, 0.0) AS rank FROM quads q LEFT JOIN ranks r ON q.c = r.node) " + _SUM.format("j"))
def g_rank_triples(spark, d):
    q, r = views(spark, d, "quads", "ranks")
    return rank.sum_ranks(joins.rank_by(q, r)).withColumn("rank", F.round("rank", 6))


@BOOK.add("win_group_bcast", "SELECT s, p, o, c, rank, max(rank) OVER (PARTITION BY s, p, o) AS best FROM ranked")
def win_group_bcast(spark, d):
    from pyspark.sql import Window

    return views(spark, d, "ranked")[0].withColumn("best", F.max("rank").over(Window.partitionBy("s", "p", "o")))


@BOOK.add("agg_rank_max", "SELECT s, p, o, m AS rank, count(*) FILTER (rank < m) AS dominated, count(*) FILTER (rank = m) - 1 AS equal FROM (SELECT *, max(rank) OVER (PARTITION BY s, p, o) AS m FROM ranked) GROUP BY s, p, o, m")
def agg_rank_max(spark, d):
    return rank.max_ranks(views(spark, d, "ranked")[0], counters=True)


@BOOK.add("agg_idrank", "SELECT s AS node, round(sum(rank), 6) AS rank FROM ranked GROUP BY s")
def agg_idrank(spark, d):
    return views(spark, d, "ranked")[0].groupBy(F.col("s").alias("node")).agg(F.round(F.sum("rank"), 6).alias("rank"))


_BINS = "SELECT 'all' AS measure, 0 AS bin, node, rank FROM ranks UNION ALL SELECT 'log10', CASE WHEN rank > 0 THEN CAST(floor(log10(rank)) AS INT) END, node, rank FROM ranks"


@BOOK.add("agg_rankdist", f"SELECT measure, bin, count(*) AS n, round(sum(rank), 6) AS rank_sum, max(rank) AS rank_max, first(node ORDER BY rank DESC, node) AS node_max FROM ({_BINS}) GROUP BY measure, bin")
def agg_rankdist(spark, d):
    return stats.rank_distribution(views(spark, d, "ranks")[0]).withColumn("rank_sum", F.round("rank_sum", 6))
