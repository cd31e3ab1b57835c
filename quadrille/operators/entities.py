"""Consolidation: equivalences from explicit statements and from functional properties, and their use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import joins, reason
from quadrille.operators.graph import components
from quadrille.session import forget, written

#: Values that many unrelated subjects share, so that they identify none: empty and placeholder literals, empty addresses, hashes of those.
JUNK = tuple(
    [f'"{x}"' for x in ("", " ", "-", "?", "n/a", "na", "none", "null", "nil", "unknown", "undefined", "anonymous", "test", "todo", "0", "ask", "private", "mailto:", "http://", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "08445a31a78661b5c746feff39a9db6e4e2cc5cf")]
    + [f"<{x}>" for x in ("mailto:", "mailto:null", "mailto:none", "mailto:test@test.com", "mailto:none@none.com", "http://", "http:///", "https://", "http://null", "http://null/", "http://none", "http://none/", "http://example.com", "http://example.com/", "http://www", "http://www.")]
)
MAX_ROUNDS = 20
#: Values that more members share tell nothing of likeness; pairs that a task scores.
LIMIT, PAIRS_A_TASK = 38, 2_000_000


def equality_kinds(schema: DataFrame, redirects: DataFrame) -> DataFrame:
    """(p, kind): sameas, ifp and fp properties, as far as the schema's statements are authoritative for them."""
    owl = "http://www.w3.org/2002/07/owl#"
    kind = F.when(F.col("o") == f"<{owl}InverseFunctionalProperty>", "ifp").when(F.col("o") == f"<{owl}FunctionalProperty>", "fp")
    found = reason.authoritative(schema.where(F.col("p") == t.RDF_TYPE), redirects).select(F.col("s").alias("p"), kind.alias("kind")).where("kind IS NOT NULL").distinct()
    return found.union(schema.sparkSession.createDataFrame([(t.SAME_AS, "sameas")], "p string, kind string"))


def dispatch(quads: DataFrame, kinds: DataFrame) -> DataFrame:
    """quads with the kind of equality reasoning that reads them (a row for each kind), `other` for none; kinds is of the schema's size."""
    return quads.join(kinds, "p", "left").select(*quads.columns, F.coalesce("kind", F.lit("other")).alias("kind"))


def explicit(quads: DataFrame) -> DataFrame:
    """(a, b) of owl:sameAs statements."""
    return quads.where((F.col("p") == t.SAME_AS) & ~t.is_literal(F.col("o"))).select(F.col("s").alias("a"), F.col("o").alias("b"))


def _stars(groups: DataFrame, key: list[str]) -> DataFrame:
    """(a, b): each member of a group with the group's smallest, a minimum taken before the shuffle."""
    least = groups.groupBy(*key).agg(F.min("x").alias("a"), F.max("x").alias("top")).where("a <> top").drop("top")
    return groups.join(least, key).where("x <> a").select("a", F.col("x").alias("b")).distinct()


def by_inverse_functional(quads: DataFrame, properties: list[str], junk: tuple[str, ...] = JUNK) -> DataFrame:
    """Subjects that share a value of an inverse-functional property are one."""
    rows = quads.where(F.col("p").isin(*properties) & ~F.col("o").isin(*junk)).select("p", "o", F.col("s").alias("x")).distinct()
    return _stars(rows, ["p", "o"])


def by_functional(quads: DataFrame, properties: list[str]) -> DataFrame:
    """Non-literal values that a subject has of a functional property are one."""
    rows = quads.where(F.col("p").isin(*properties) & ~t.is_literal(F.col("o"))).select("s", "p", F.col("o").alias("x")).distinct()
    return _stars(rows, ["s", "p"])


def by_cardinality(quads: DataFrame, limits: DataFrame) -> DataFrame:
    """Values of p that an instance of a class has are one, if the class allows p one value; limits is (cls, p)."""
    typed = quads.where(F.col("p") == t.RDF_TYPE).select("s", F.col("o").alias("cls")).distinct()
    asked = typed.join(limits, "cls").select("s", "p").distinct()
    rows = quads.where(~t.is_literal(F.col("o"))).join(asked, ["s", "p"], "left_semi").select("s", "p", F.col("o").alias("x")).distinct()
    return _stars(rows, ["s", "p"])


def classes(pairs: DataFrame) -> DataFrame:
    """(node, pivot): every node of the pairs with the smallest of its class."""
    return components(pairs, "a", "b").withColumnRenamed("component", "pivot")


def fixpoint(quads: DataFrame, inverse_functional: list[str], functional: list[str], limits: DataFrame) -> DataFrame:
    """(node, pivot) when no rule finds a new equivalence on the rewritten quads.

    Only statements that a rule reads are rewritten, and a round adds what it finds to the classes so far (one pair for each
    member), so that neither the data nor the pairs of earlier rounds are worked through again.
    """
    asked = F.broadcast(limits.select("p").distinct())
    kinds = F.broadcast(limits.select(F.col("cls").alias("o")).distinct())
    read = quads.where(F.col("p").isin(*inverse_functional, *functional)).unionByName(quads.join(asked, "p", "left_semi").select(quads.columns)).unionByName(quads.where(F.col("p") == t.RDF_TYPE).join(kinds, "o", "left_semi").select(quads.columns))
    read = written(read.select("s", "p", "o").distinct(), "rule-statements")
    pivots = written(classes(explicit(quads)), "pivots")
    for _ in range(MAX_ROUNDS):
        current = written(consolidate(read, pivots).distinct(), "rewritten")
        fresh = written(by_inverse_functional(current, inverse_functional).unionByName(by_functional(current, functional)).unionByName(by_cardinality(current, limits)).distinct(), "sameas")
        if fresh.isEmpty():
            return pivots
        following = written(classes(fresh.unionByName(pivots.select(F.col("node").alias("b"), F.col("pivot").alias("a")))), "pivots")
        forget(current, fresh, pivots)
        pivots = following
    raise RuntimeError(f"equivalences did not settle in {MAX_ROUNDS} rounds")


def consolidate(quads: DataFrame, pivots: DataFrame, aliases: bool = False, mode: str = "rewrite") -> DataFrame:
    """Quads with subjects and objects replaced by pivots (not objects of rdf:type), with what they replace; mode as in joins.rewrite.

    Only quads that may name a member of a class other than its pivot take part in joins; the others move nowhere.
    """
    pivots = written(pivots.where("node <> pivot"), "replaced")
    if mode == "filter":
        quads = quads.where(F.col("p") != t.SAME_AS)
    asked, rest = joins.among(quads, pivots)
    once = joins.rewrite(asked, pivots, "s", mode, alias="s_orig" if aliases else None)
    done = joins.rewrite(once, pivots, "o", mode, alias="o_orig" if aliases else None)
    none = F.lit(None).cast("string")
    return done.unionByName(rest.select("*", none.alias("s_orig"), none.alias("o_orig")) if aliases else rest)


def same_as_statements(pivots: DataFrame) -> DataFrame:
    """(s, o) of both directions between pivots and members."""
    rows = pivots.where("node <> pivot")
    return rows.select(F.col("pivot").alias("s"), F.col("node").alias("o")).union(rows.select("node", "pivot"))


def ranked_pivot(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, pivot) with each class's highest-ranked member as pivot (the smallest of several)."""
    rows = members.join(ranks, "node", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    best = F.first("node").over(Window.partitionBy("pivot").orderBy(F.desc("rank"), "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("node", best.alias("pivot"))


def sharing(quads: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(shared, lists, pairs, clash), a row for each term, and (kind, way, p); both written.

    A list (kind, size, xs) has the number of different objects of a subject by predicate (way "s"), or of subjects of an object (way "o"),
    and in order those that are no literals; xs is empty where there are more than `limit`, or fewer than two. pairs counts what they pair to,
    clash says that two members may pair in several lists. Kinds are numbered in the order of (p, way). A quad moves once for each way, to the
    term that is shared; a hub's members are sorted and counted, never collected.
    """
    ways = F.explode(F.array(F.lit("o"), F.lit("s"))).alias("way")
    kinds = written(quads.where("p IS NOT NULL").select("p").distinct().select("p", ways).select((F.row_number().over(Window.orderBy("p", "way")) - 1).alias("kind"), "way", "p"), "kinds")
    first = F.broadcast(kinds.groupBy("p").agg(F.min("kind").alias("__k")))
    spots = F.array(F.struct(F.col("o").alias("shared"), F.col("__k").alias("kind"), F.col("s").alias("x")), F.struct(F.col("s").alias("shared"), (F.col("__k") + 1).alias("kind"), F.col("o").alias("x")))
    rows = quads.select("s", "p", "o").join(first, "p").select(F.explode(spots).alias("e")).select("e.*").where("shared IS NOT NULL AND x IS NOT NULL").repartition("shared")
    w = Window.partitionBy("shared", "kind").orderBy("x")
    nth = rows.withColumn("__n", F.dense_rank().over(w)).withColumn("__again", F.coalesce(F.col("x") == F.lag("x").over(w), F.lit(False)))
    sized = nth.withColumn("size", F.last("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("NOT __again")
    able = F.when((F.col("size") <= limit) & ~t.is_literal(F.col("x")), F.col("x"))
    groups = sized.groupBy("shared", "kind").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(able)).alias("xs"))
    groups = groups.withColumn("xs", F.when(F.size("xs") > 1, F.col("xs")).otherwise(F.array().cast("array<string>")))
    n, all_xs = F.size("xs").cast("long"), F.flatten("lists.xs")
    lists = groups.groupBy("shared").agg(F.collect_list(F.struct("kind", "size", "xs")).alias("lists"), F.sum(n * (n - 1) / 2).cast("long").alias("pairs"))
    return written(lists.withColumn("clash", F.size(all_xs) - F.size(F.array_distinct(all_xs)) > 1), "sharing"), kinds


def list_averages(lists: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, way, p, adjusted, average): values of (s, p) by predicate in way "s", subjects of (o, p) in way "o"; adjusted as stats.adjusted_averages."""
    sizes = lists.select(F.explode(F.arrays_zip(F.col("lists.kind").alias("kind"), F.col("lists.size").alias("size"))).alias("e")).select("e.*")
    found = sizes.groupBy("kind").agg(F.count("*").alias("occurrences"), F.sum("size").alias("triples")).join(F.broadcast(kinds), "kind")
    total = found.groupBy("way").agg(F.sum("occurrences").alias("o"), F.sum("triples").alias("t"), (F.count("*") + 1).alias("n"))
    adjusted = (F.col("triples") + F.col("t") / F.col("n")) / (F.col("occurrences") + F.col("o") / F.col("n"))
    return written(found.join(F.broadcast(total), "way").select("kind", "way", "p", adjusted.alias("adjusted"), (F.col("triples") / F.col("occurrences")).alias("average")), "averages")


def averages(quads: DataFrame) -> DataFrame:
    """(way, p, adjusted, average) of quads, as list_averages."""
    return list_averages(*sharing(quads)).select("way", "p", "adjusted", "average")


def _leaders(lists: DataFrame, means: DataFrame) -> DataFrame:
    """(a, bs, shared, clash, kind, confidence, ...): of each list each member with those that follow it; confidence is 1 / (adjusted average * members)."""
    each = lists.where("pairs > 0").select("shared", "clash", F.explode("lists").alias("e")).select("shared", "clash", "e.*").where(F.size("xs") > 1).join(F.broadcast(means), "kind")
    i = F.explode(F.sequence(F.lit(1), F.size("xs") - 1)).alias("i")
    each = each.select("shared", "clash", "kind", "way", "p", (1 / (F.col("adjusted") * F.col("size"))).alias("confidence"), F.col("average").alias("mean"), "xs", i)
    return each.withColumn("a", F.element_at("xs", F.col("i"))).withColumn("bs", F.slice("xs", F.col("i") + 1, F.size("xs"))).drop("xs", "i")


def evidence(lists: DataFrame, means: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, p, way, confidence, mean): all pairs that share an object (way "o") or a subject (way "s") of a predicate, or the few of `among` (a, b)."""
    rows = _leaders(lists, means)
    columns = ("shared", "p", "way", "confidence", "mean")
    if among is not None:
        return rows.join(F.broadcast(among.select("a", "b")), "a").where(F.array_contains("bs", F.col("b"))).select("a", "b", *columns)
    return rows.select("a", F.explode("bs").alias("b"), *columns)


def concurrence(quads: DataFrame, means: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The evidence of quads; means is (way, p, adjusted, average).

    The confidence of a shared value is 1 / (adjusted average * members); literals count as members but don't pair, and values of
    more than `limit` members tell nothing. Members are paired only below that limit.
    """
    lists, kinds = sharing(quads, limit)
    return evidence(lists, means.join(F.broadcast(kinds), ["way", "p"]))


def similarity(lists: DataFrame, means: DataFrame) -> DataFrame:
    """aggregate_similarity of all evidence, which crosses the exchange as one row for each member of a list, with those that follow it.

    Only where two members may pair in several lists of one value are pairs of that value compared first.
    """
    rows = _leaders(lists, means)
    pair = rows.where("clash").select("a", F.explode("bs").alias("b"), "shared", "kind", "confidence").groupBy("a", "b", "shared").agg(F.min_by(F.struct("kind", "confidence"), F.struct(-F.col("confidence"), "kind")).alias("e"))
    every = rows.where("NOT clash").select("a", "bs", "kind", "confidence").union(pair.select("a", F.array("b"), "e.kind", "e.confidence"))
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), (lists.agg(F.sum("pairs")).first()[0] or 0) // PAIRS_A_TASK)
    within = every.repartition(tasks, "a").select("a", F.explode("bs").alias("b"), "kind", "confidence").groupBy("a", "b", "kind").agg(_either(F.col("confidence")).alias("c"))
    return within.join(F.broadcast(means.select("kind", "average")), "kind").groupBy("a", "b").agg(_either(F.col("c") / F.col("average")).alias("score"))


def _either(confidence) -> Column:
    """Noisy-or of a group's confidences."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - confidence, F.lit(1e-12)))))


def aggregate_similarity(evidence: DataFrame) -> DataFrame:
    """(a, b, score): of each shared value the greatest confidence counts; noisy-or within a predicate and way, scaled by 1 / mean, then across them."""
    evidence = evidence.repartition("a", "b")  # one exchange serves all three groupings: their keys begin with the pair
    best = evidence.groupBy("a", "b", "shared").agg(F.min_by(F.struct("p", "way", "confidence", "mean"), F.struct(-F.col("confidence"), "p", "way")).alias("e")).select("a", "b", "e.*")
    within = best.groupBy("a", "b", "p", "way").agg((_either(F.col("confidence")) / F.first("mean")).alias("c"))
    return within.groupBy("a", "b").agg(_either(F.col("c")).alias("score"))
