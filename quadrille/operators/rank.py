"""Link graphs, PageRank and ranks of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import joins
from quadrille.session import bucketed, forget, written

DAMPING, ROUNDS = 0.85, 10
#: Links that a task of a PageRank round reads.
LINKS_A_TASK = 100_000
TRIPLE = ("s", "p", "o")


def extract_links(quads: DataFrame, schema_too: bool = False, skip: tuple[str, ...] = (), ends: DataFrame | None = None) -> DataFrame:
    """(src, dst): from each document to the IRIs it mentions, without fragments and self-links.

    Unless schema_too, predicates and the objects of rdf:type don't count. Where only links to `ends` (node) are asked for, quads that surely
    name none of them are passed over before they are taken apart; some links to others may be left.
    """
    plain = F.lit(True) if schema_too else F.col("p") != t.RDF_TYPE
    spots = {"s": t.strip_fragment(F.col("s")), "o": F.when(plain, t.strip_fragment(F.col("o")))} | ({"p": t.strip_fragment(F.col("p"))} if schema_too else {})
    rows = quads.where(~F.col("p").isin(*skip)) if skip else quads
    rows = rows.select(t.strip_fragment(F.col("c")).alias("src"), *(x.alias(k) for k, x in spots.items()))
    if ends is not None:
        rows = joins.among(rows, ends, tuple(spots))[0]
    hit = rows.select("src", F.explode(F.array(*spots)).alias("dst"))
    return hit.where(t.is_iri(F.col("dst"))).where("src <> dst").distinct()


def document_links(quads: DataFrame, documents: DataFrame, redirects: DataFrame) -> DataFrame:
    """(src, dst): links that lead to one of the documents (c), those to redirects (src, dst) by way of them."""
    ends = documents.select(F.col("c").alias("node")).union(redirects.select("src"))
    return joins.within(joins.redirect(extract_links(quads, ends=ends), redirects), documents)


def page_rank(links: DataFrame, nodes: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(node, rank) after the given rounds from a uniform start; nodes is (node).

    The rank of nodes without links is spread over all nodes. Links are written once in buckets by source, so that a round moves
    ranks and flows only; every round's ranks are written and the ones before deleted, so that no plan grows with the number of rounds.
    """
    nodes = written(nodes.select("node").distinct(), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    inside = written(links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct(), "rank-inside")
    sources = inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    degrees = written(nodes.join(sources, "node", "left"), "rank-degrees")
    out, name = bucketed(inside, "rank-links", "src", inside.count() // LINKS_A_TASK + 1)
    ranks = written(degrees.withColumn("rank", F.lit(1.0 / n)), "rank-round")
    for _ in range(rounds):
        kept = ranks.where("degree IS NOT NULL").agg(F.sum("rank")).first()[0] or 0.0
        base = (1 - damping) / n + damping * max(0.0, 1 - kept) / n
        share = ranks.where("degree IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share"))
        flow = out.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("inflow"))
        following = written(degrees.join(flow, "node", "left").select("node", "degree", (F.lit(base) + F.lit(damping) * F.coalesce("inflow", F.lit(0.0))).alias("rank")), "rank-round")
        forget(ranks)
        ranks = following
    links.sparkSession.sql(f"DROP TABLE {name}")
    forget(out, inside, degrees, nodes)
    return ranks.select("node", "rank")


def domain_links(quads: DataFrame) -> DataFrame:
    """(src, dst) between pay-level domains of documents and of the IRIs they mention, as extract_links finds them.

    Quads are first reduced to their different authorities, of which there are as many as hosts that meet, before domains are taken.
    """
    ends = [t.document_authority(F.col(x)) for x in "cso"]
    met = quads.select(ends[0].alias("src"), ends[1].alias("s"), F.when(F.col("p") != t.RDF_TYPE, ends[2]).alias("o")).distinct()
    raw = met.select("src", F.explode(F.array("s", "o")).alias("dst")).where(t.is_iri(F.col("dst"))).distinct()
    return raw.select(t.pay_level_domain(F.col("src")).alias("src"), t.pay_level_domain(F.col("dst")).alias("dst")).where("src <> dst").distinct()


def sum_ranks(ranked: DataFrame) -> DataFrame:
    """(s, p, o, c, rank): distinct rows, each with the sum over its triple."""
    once = ranked.select(*TRIPLE, "c", "rank").distinct()
    return once.withColumn("rank", F.sum("rank").over(Window.partitionBy(*TRIPLE))).distinct()


def max_ranks(ranked: DataFrame, counters: bool = False) -> DataFrame:
    """(s, p, o, rank[, dominated, equal]): each triple with its greatest rank, and how many of its other rows rank lower and as high."""
    if not counters:
        return ranked.groupBy(*TRIPLE).agg(F.max("rank").alias("rank"))
    each = ranked.groupBy(*TRIPLE, "rank").agg(F.count("*").alias("n"))
    return each.groupBy(*TRIPLE).agg(F.max("rank").alias("rank"), (F.sum("n") - F.max_by("n", "rank")).alias("dominated"), (F.max_by("n", "rank") - 1).alias("equal"))


def identifier_ranks(quads: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, rank): each subject with the sum of the ranks of the documents of its quads, one for each document."""
    mentions = quads.select(F.col("s").alias("node"), "c").distinct()
    return joins.rank_by(mentions, ranks).groupBy("node").agg(F.sum("rank").alias("rank"))
