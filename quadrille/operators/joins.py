"""Joins of quads with ranks, redirects, equivalences and node sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.session import written

Q = ("s", "p", "o", "c")
#: Bits of the bitmap that tells quads which a join can't touch.
MARK_BITS = 1 << 25


def rank_by(quads: DataFrame, ranks: DataFrame, position: str = "c", missing: float = 0.0) -> DataFrame:
    """quads with the rank of the term at `position`; ranks is (node, rank)."""
    r = ranks.select(F.col("node").alias("__n"), F.col("rank").alias("rank"))
    return quads.join(r, quads[position] == r["__n"], "left").drop("__n").withColumn("rank", F.coalesce("rank", F.lit(missing)))


def rewrite(quads: DataFrame, pivots: DataFrame, position: str, mode: str = "rewrite", alias: str | None = None) -> DataFrame:
    """Replaces terms at `position` by their pivot; pivots is (node, pivot).

    owl:sameAs rows are rewritten (mode rewrite), left out (filter) or kept as they are (buffer), and
    objects of rdf:type are never rewritten. `alias` names a column for the term that was replaced.
    """
    m = pivots.select(F.col("node").alias("__n"), F.col("pivot").alias("__pivot"))
    same = F.col("p") == t.SAME_AS
    if mode == "filter":
        quads = quads.where(~same)
    fixed = F.lit(False)
    if mode == "buffer":
        fixed = fixed | same
    if position == "o":
        fixed = fixed | (F.col("p") == t.RDF_TYPE)
    new = F.when(fixed, F.col(position)).otherwise(F.coalesce("__pivot", F.col(position)))
    out = quads.join(m, quads[position] == m["__n"], "left").withColumn("__new", new)
    if alias:
        out = out.withColumn(alias, F.when(F.col("__new") != F.col(position), F.col(position)))
    return out.withColumn(position, F.col("__new")).drop("__n", "__pivot", "__new")


def _marks(nodes: DataFrame) -> DataFrame:
    """(word, bits) of a bitmap of hashes of nodes (node); words without a bit have no row."""
    return nodes.select(_mark(F.col("node")).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _mark(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(MARK_BITS))


def among(quads: DataFrame, nodes: DataFrame, positions: tuple[str, ...] = ("s", "o")) -> tuple[DataFrame, DataFrame]:
    """(quads that may have one of the nodes at a position, the rest, which surely have none), as `marked` tells."""
    out = marked(quads, nodes, positions)
    return out.where("__may").drop("__may"), out.where("NOT __may").drop("__may")


def marked(quads: DataFrame, nodes: DataFrame, positions: tuple[str, ...] = ("s", "o")) -> DataFrame:
    """quads with __may: whether they may have one of the nodes at a position, told by a small bitmap that is broadcast.

    A bitmap has no more than MARK_BITS / 64 words of 16 bytes; with very many nodes more quads may have one, but none is missed.
    """
    words = written(_marks(nodes), "marks")
    hit, out = F.lit(False), quads
    for k in positions:
        w = F.broadcast(words.select(F.col("word").alias(f"__w{k}"), F.col("bits").alias(f"__b{k}")))
        out = out.join(w, F.shiftright(_mark(F.col(k)), 6) == F.col(f"__w{k}"), "left")
        here = F.coalesce(F.col(f"__b{k}"), F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({k}), {MARK_BITS}L) & 63 AS INT))")) != 0
        hit = hit | (F.col(k).isNotNull() & here)
    return out.select(*quads.columns, hit.alias("__may"))


def redirect(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """(src, dst) with dst sent through redirects (src, dst), distinct."""
    r = redirects.select(F.col("src").alias("__from"), F.col("dst").alias("__to"))
    return links.join(r, links["dst"] == r["__from"], "left").select("src", F.coalesce("__to", "dst").alias("dst")).distinct()


def within(links: DataFrame, nodes: DataFrame, column: str = "dst", key: str = "c") -> DataFrame:
    """Links whose end is among the nodes."""
    return links.join(nodes.select(F.col(key).alias(column)).distinct(), column, "left_semi").select(*links.columns)


def clean_redirects(redirects: DataFrame, contexts: DataFrame) -> DataFrame:
    """Redirects from unknown documents to others, the smallest target for each source."""
    known = contexts.select(F.col("c").alias("src"))
    return redirects.where("src <> dst").join(known, "src", "left_anti").groupBy("src").agg(F.min("dst").alias("dst"))


def shared_value_pairs(quads: DataFrame, key: tuple[str, ...] = ("p", "o"), member: str = "s", limit: int = 38) -> DataFrame:
    """Unordered pairs of members that share a key, for keys of at most `limit` members, with the key."""
    rows = quads.select(*key, F.col(member).alias("x")).distinct()
    size = rows.groupBy(*key).agg(F.count("*").alias("__size")).where(F.col("__size").between(2, limit))
    small = rows.join(size, list(key)).drop("__size")
    a, b = small.withColumnRenamed("x", "a"), small.withColumnRenamed("x", "b")
    return a.join(b, list(key)).where("a < b").select(*key, "a", "b")


def touching(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Quads, each once, whose subject, predicate or object is among the nodes (node): their positions meet the nodes in one join."""
    spots = quads.select(*Q, F.explode(F.array_distinct(F.array("s", "p", "o"))).alias("node"))
    return spots.join(nodes.select("node").distinct(), "node", "left_semi").select(*Q).distinct()


def matching(quads: DataFrame, patterns: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """Quads that match any (s, p, o) pattern; None is a variable."""
    test: Column = F.lit(False)
    for pattern in patterns:
        one = F.lit(True)
        for column, term in zip("spo", pattern, strict=True):
            if term is not None:
                one = one & (F.col(column) == term)
        test = test | one
    return quads.where(test)


def rewrite_counts(quads: DataFrame, pivots: DataFrame) -> DataFrame:
    """For subjects and objects: terms that could be rewritten, that have a class, that change."""
    m = pivots.select("node", "pivot")
    parts = []
    for position in ("s", "o"):
        able = (F.col("p") != t.SAME_AS) & ~t.is_literal(F.col(position))
        if position == "o":
            able = able & (F.col("p") != t.RDF_TYPE)
        rows = quads.where(able).select(F.col(position).alias("node")).join(m, "node", "left")
        parts.append(rows.agg(F.lit(position).alias("position"), F.count("*").alias("possible"), F.count("pivot").alias("indexed"), F.sum((F.col("pivot") != F.col("node")).cast("long")).alias("rewritten")))
    return parts[0].union(parts[1]).withColumn("rewritten", F.coalesce("rewritten", F.lit(0).cast("long")))


def neighbourhood(quads: DataFrame, focus: str, labels: DataFrame) -> DataFrame:
    """Quads of the focus, then label quads of each predicate and non-literal object among them."""
    own = quads.where(F.col("s") == focus).select(*Q)
    near = own.select(F.explode(F.array("p", "o")).alias("s")).where(~t.is_literal(F.col("s"))).distinct()
    return own.unionByName(labels.select(*Q).join(near, "s", "left_semi").select(*Q)).distinct()
