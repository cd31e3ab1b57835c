"""Queries on equivalences, consolidation, similarity and inconsistencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import conflicts, entities, rank, reason, stats
from quadrille.operators.graph import components
from quadrille.plans.book import SAME, TYPE, Book, pld, strip
from quadrille.plans.reason_queries import _CLOSED, _infer_sql
from quadrille.session import written
from quadrille.sources.quads import V, views

BOOK = Book()
MBOX, NAME, NATION = f"<{V}mbox>", f"<{V}name>", f"<{V}nation>"


def _closure_sql(edges: str) -> str:
    return f", e2 AS MATERIALIZED (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})), reach(node, x) AS (SELECT a, a FROM e2 UNION SELECT r.node, e2.b FROM reach r JOIN e2 ON r.x = e2.a), pv AS MATERIALIZED (SELECT node, min(x) AS \"pivot\" FROM reach GROUP BY node)"


_SAME_EDGES = "SELECT s AS a, o AS b FROM q_sameas"
_IFP = f"SELECT DISTINCT m AS a, s AS b FROM (SELECT s, min(s) OVER (PARTITION BY p, o) AS m FROM q_name WHERE p = '{MBOX}') WHERE m <> s"
_PV = _closure_sql(_SAME_EDGES)
_CONS = f"{_PV}, cons AS MATERIALIZED (SELECT coalesce(a.\"pivot\", q.s) AS s, q.p, CASE WHEN q.p = {TYPE} THEN q.o ELSE coalesce(b.\"pivot\", q.o) END AS o, q.c, CASE WHEN a.\"pivot\" <> q.s THEN q.s END AS s_orig, CASE WHEN q.p <> {TYPE} AND b.\"pivot\" <> q.o THEN q.o END AS o_orig FROM (SELECT * FROM quads UNION ALL SELECT * FROM q_social) q LEFT JOIN pv a ON q.s = a.node LEFT JOIN pv b ON q.o = b.node)"


def _pivots(spark, d):
    return entities.classes(entities.explicit(views(spark, d, "q_sameas")[0]))


def _all(spark, d):
    quads, social = views(spark, d, "quads", "q_social")
    return quads.unionByName(social)


def _consolidated(spark, d):
    return written(entities.consolidate(_all(spark, d), _pivots(spark, d), aliases=True), "consolidated")


def _contradictable(spark, d, pivots=None):
    """The consolidated statements that a constraint rule reads; the others contradict none, so they need not be consolidated to find violations."""
    p, o = F.col("p"), F.col("o")
    limits = (*((cls, q, None) for cls, q in _NONE_OF), *_NONE_IN, *_NONE_AT_ALL)
    classes = {x for pair in (*_PAIRS, *_COMPLEMENTS) for x in pair} | {*_ALL_CLASSES} | {x for cls, _, on in limits for x in (cls, on) if x}
    properties = {NAME, conflicts.DIFFERENT, *_IRREFLEXIVE, *_ASYMMETRIC, *_ALL_PROPERTIES} | {x for pair in _DISJOINT_PROPERTIES for x in pair} | {q for _, q, _ in limits}
    read = p.isin(*sorted(properties)) | ((p == t.RDF_TYPE) & o.isin(*sorted(classes)))
    return written(entities.consolidate(_all(spark, d).where(read), _pivots(spark, d) if pivots is None else pivots, aliases=True), "contradictable")


_SHARED_BOX = "<mailto:3.7@example.org>"
_OWLP = "http://www.w3.org/2002/07/owl#"
_KINDS = f""", kd AS (SELECT DISTINCT t.s AS p, CASE t.o WHEN '<{_OWLP}InverseFunctionalProperty>' THEN 'ifp' ELSE 'fp' END AS kind FROM tbox t LEFT JOIN redirects r ON ({strip('t.s')}) = r.src
  WHERE t.p = {TYPE} AND t.o IN ('<{_OWLP}InverseFunctionalProperty>', '<{_OWLP}FunctionalProperty>') AND coalesce(r.dst, {strip('t.s')}) = t.c UNION ALL SELECT {SAME}, 'sameas'),
  di AS (SELECT q.*, coalesce(kind, 'other') AS kind FROM (SELECT * FROM quads UNION ALL SELECT * FROM q_sameas) q LEFT JOIN kd USING (p))"""


def _dispatched(spark, d):
    q, same, tbox, redirects = views(spark, d, "quads", "q_sameas", "tbox", "redirects")
    return entities.dispatch(q.unionByName(same), entities.equality_kinds(tbox, redirects))


@BOOK.add("c_extract", f"{_KINDS} SELECT s, p, o, c FROM di WHERE kind <> 'other' AND o NOT IN ('{_SHARED_BOX}', {', '.join(chr(39) + x + chr(39) for x in entities.JUNK)})")
def c_extract(spark, d):
    """Statements that equality reasoning reads, without values that identify nothing."""
    return _dispatched(spark, d).where((F.col("kind") != "other") & ~F.col("o").isin(_SHARED_BOX, *entities.JUNK)).select("s", "p", "o", "c")


@BOOK.add("c_dispatch", f"{_KINDS} SELECT kind, count(*) AS n FROM di GROUP BY kind")
def c_dispatch(spark, d):
    return _dispatched(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@BOOK.add("c_ifp", f"SELECT a, b FROM ({_IFP})")
def c_ifp(spark, d):
    return entities.by_inverse_functional(views(spark, d, "q_name")[0], [MBOX])


@BOOK.add("c_fp", f"SELECT DISTINCT m AS a, o AS b FROM (SELECT o, min(o) OVER (PARTITION BY s, p) AS m FROM q_line WHERE p = '<{V}supplier>') WHERE m <> o")
def c_fp(spark, d):
    return entities.by_functional(views(spark, d, "q_line")[0], [f"<{V}supplier>"])


@BOOK.add("c_card", f", a AS (SELECT DISTINCT s FROM q_type WHERE o = '<{V}OrderP>'), r AS (SELECT DISTINCT q.s, q.o FROM q_line q SEMI JOIN a USING (s) WHERE q.p = '<{V}part>') SELECT DISTINCT m AS a, o AS b FROM (SELECT o, min(o) OVER (PARTITION BY s) AS m FROM r) WHERE m <> o")
def c_card(spark, d):
    line, kinds = views(spark, d, "q_line", "q_type")
    limits = spark.createDataFrame([(f"<{V}OrderP>", f"<{V}part>")], "cls string, p string")
    return entities.by_cardinality(line.unionByName(kinds), limits)


for _name in ("c_closure", "c_unionfind"):
    @BOOK.add(_name, f"{_PV} SELECT node, \"pivot\" FROM pv")
    def c_closure(spark, d):
        return _pivots(spark, d)


@BOOK.add("c_fixpoint", _closure_sql(f"{_SAME_EDGES} UNION ALL {_IFP}") + " SELECT node, \"pivot\" FROM pv")
def c_fixpoint(spark, d):
    q, same = views(spark, d, "q_name", "q_sameas")
    limits = spark.createDataFrame([], "cls string, p string")
    return entities.fixpoint(q.unionByName(same), [MBOX], [NATION], limits)


@BOOK.add("c_pivot", f"{_PV}, rk AS (SELECT s AS node, count(*) / 10.0 AS rank FROM q_name WHERE c LIKE '%src1%' GROUP BY s) SELECT node, first_value(node) OVER (PARTITION BY \"pivot\" ORDER BY coalesce(rank, 0.0) DESC, node) AS \"pivot\" FROM pv LEFT JOIN rk USING (node)")
def c_pivot(spark, d):
    r = views(spark, d, "q_name")[0].where("c LIKE '%src1%'").groupBy(F.col("s").alias("node")).agg((F.count("*") / 10.0).alias("rank"))
    return entities.ranked_pivot(_pivots(spark, d), r)


@BOOK.add("c_write_sameas", f"{_PV} SELECT \"pivot\" AS s, node AS o FROM pv WHERE node <> \"pivot\" UNION ALL SELECT node, \"pivot\" FROM pv WHERE node <> \"pivot\"")
def c_write_sameas(spark, d):
    return entities.same_as_statements(_pivots(spark, d))


for _name in ("c_apply", "c_basic"):
    @BOOK.add(_name, f"{_CONS} SELECT s, p, o, c{', s_orig, o_orig' if _name == 'c_apply' else ''} FROM cons")
    def c_apply(spark, d, aliases=_name == "c_apply"):
        return entities.consolidate(_all(spark, d), _pivots(spark, d), aliases=aliases)


_SIZE = f", si AS (SELECT component, count(*) AS size, count(DISTINCT {pld('node')}) AS plds FROM (SELECT node, \"pivot\" AS component FROM pv) GROUP BY component)"


@BOOK.add("agg_sameas_stats", f"{_PV}{_SIZE} SELECT 'size' AS measure, size AS n, count(*) AS classes FROM si GROUP BY size UNION ALL SELECT 'plds', plds, count(*) FROM si GROUP BY plds")
def agg_sameas_stats(spark, d):
    return stats.class_stats(components(entities.explicit(views(spark, d, "q_sameas")[0]), "a", "b"))


@BOOK.add("topk_classes", f"{_PV}{_SIZE}, " + """parts AS (SELECT * FROM (SELECT 'size' AS part, component, size, plds FROM si ORDER BY size DESC, component LIMIT 10) UNION ALL SELECT * FROM (SELECT 'plds', component, size, plds FROM si ORDER BY plds DESC, component LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'drawn', component, size, plds FROM si ORDER BY md5(component), component LIMIT 10)) SELECT part, component AS "pivot", size, plds FROM parts""")
def topk_classes(spark, d):
    """The 10 largest classes, the 10 of the most pay-level domains, and 10 drawn by hash."""
    per = written(_pivots(spark, d).groupBy("pivot").agg(F.count("*").alias("size"), F.count_distinct(t.pay_level_domain(F.col("node"))).alias("plds")), "classes")
    out = None
    for part, first in (("size", F.desc("size")), ("plds", F.desc("plds")), ("drawn", F.md5("pivot"))):
        one = per.orderBy(first, "pivot").limit(10).select(F.lit(part).alias("part"), "pivot", "size", "plds")
        out = one if out is None else out.union(one)
    return out


@BOOK.add("agg_ranked_classes", f"{_PV} SELECT \"pivot\", count(*) AS size FROM pv WHERE \"pivot\" IN (SELECT \"pivot\" FROM pv WHERE node IN (SELECT s FROM q_name WHERE c LIKE '%src3%')) GROUP BY \"pivot\"")
def agg_ranked_classes(spark, d):
    pv = written(_pivots(spark, d), "pivots")
    ranked = views(spark, d, "q_name")[0].where("c LIKE '%src3%'").select(F.col("s").alias("node")).distinct()
    hit = pv.join(ranked, "node", "left_semi").select("pivot").distinct()
    return pv.join(hit, "pivot", "left_semi").groupBy("pivot").agg(F.count("*").alias("size"))


def _averages_sql() -> str:
    out = []
    for way, value in (("s", "o"), ("o", "s")):
        out.append(f"ga_{way} AS (SELECT p, count(*) AS occ, sum(n)::DOUBLE AS tri FROM (SELECT {way}, p, count(*) AS n FROM (SELECT DISTINCT {way}, p, {value} FROM quads) GROUP BY {way}, p) GROUP BY p)")
        out.append(f"gt_{way} AS (SELECT sum(occ) AS o, sum(tri) AS t, count(*) + 1 AS n FROM ga_{way})")
    rows = " UNION ALL ".join(f"SELECT '{w}' AS way, p, (tri + t / n) / (occ + o / n) AS adjusted, tri / occ AS average FROM ga_{w}, gt_{w}" for w in "so")
    return ", " + ", ".join(out) + f", me AS MATERIALIZED ({rows})"


_SIM = f"""{_averages_sql()}, rw AS MATERIALIZED (SELECT DISTINCT 's' AS way, s AS shared, p, o AS x FROM quads UNION ALL SELECT DISTINCT 'o', o, p, s FROM quads),
  sz AS (SELECT way, shared, p, count(*) AS size FROM rw GROUP BY way, shared, p HAVING count(*) <= 38 AND count(*) FILTER (NOT starts_with(x, '"')) > 1),
  cf AS MATERIALIZED (SELECT way, shared, p, x, 1 / (adjusted * size) AS k, average FROM rw JOIN sz USING (way, shared, p) JOIN me USING (way, p) WHERE NOT starts_with(x, '"')),
  ev AS MATERIALIZED (SELECT a.x AS a, b.x AS b, shared, p, way, a.k AS confidence, a.average AS mean FROM cf a JOIN cf b USING (way, shared, p) WHERE a.x < b.x),
  be AS (SELECT DISTINCT ON (a, b, shared) a, b, shared, p, way, confidence, mean FROM ev ORDER BY a, b, shared, confidence DESC, p, way),
  wi AS (SELECT a, b, p, way, (1 - exp(sum(ln(greatest(1 - confidence, 1e-12))))) / any_value(mean) AS c FROM be GROUP BY a, b, p, way),
  sc AS MATERIALIZED (SELECT a, b, round(1 - exp(sum(ln(greatest(1 - c, 1e-12)))), 6) AS score FROM wi GROUP BY a, b)"""


def _sharing(spark, d):
    lists, kinds = entities.sharing(views(spark, d, "quads")[0])
    return lists, entities.list_averages(lists, kinds)


def _scores(spark, d):
    return entities.similarity(*_sharing(spark, d)).withColumn("score", F.round("score", 6))


@BOOK.add("agg_simclass", f"{_SIM} SELECT a, b, shared, p, way, round(confidence, 6) AS confidence FROM ev")
def agg_simclass(spark, d):
    return entities.evidence(*_sharing(spark, d)).withColumn("confidence", F.round("confidence", 6)).drop("mean")


for _name in ("agg_concur", "c_sim"):
    @BOOK.add(_name, f"{_SIM} SELECT a, b, score FROM sc")
    def c_sim(spark, d):
        return _scores(spark, d)


@BOOK.add("topk_conf", f"{_SIM} SELECT * FROM (SELECT 'top' AS part, a, b, score FROM sc ORDER BY score DESC, a, b LIMIT 10) UNION ALL SELECT * FROM (SELECT 'drawn' AS part, a, b, score FROM sc ORDER BY md5(concat(a, ' ', b)), a, b LIMIT 100)")
def topk_conf(spark, d):
    """The 10 pairs of the highest scores, and 100 drawn by hash."""
    scores = written(_scores(spark, d), "scores")
    top = scores.orderBy(F.desc("score"), "a", "b").limit(10).select(F.lit("top").alias("part"), "a", "b", "score")
    return top.union(scores.orderBy(F.md5(F.concat_ws(" ", "a", "b")), "a", "b").limit(100).select(F.lit("drawn"), "a", "b", "score"))


@BOOK.add("agg_sim_stats", f"{_SIM} SELECT CASE WHEN {pld('a')} = 'no_pld' OR {pld('b')} = 'no_pld' THEN 'none' WHEN {pld('a')} = {pld('b')} THEN 'intra' ELSE 'inter' END AS kind, count(*) AS pairs, round(sum(score), 4) AS score_sum FROM sc GROUP BY 1")
def agg_sim_stats(spark, d):
    return stats.similarity_stats(_scores(spark, d)).withColumn("score_sum", F.round("score_sum", 4))


@BOOK.add("agg_sim_trace", f"{_SIM}, top AS (SELECT a, b FROM sc ORDER BY score DESC, a, b LIMIT 10) SELECT a, b, shared, p, way, round(confidence, 6) AS confidence FROM ev SEMI JOIN top USING (a, b)")
def agg_sim_trace(spark, d):
    lists, means = _sharing(spark, d)
    top = written(entities.similarity(lists, means).orderBy(F.desc(F.round("score", 6)), "a", "b").limit(10).select("a", "b"), "top-pairs")
    return entities.evidence(lists, means, top).select("a", "b", "shared", "p", "way", F.round("confidence", 6).alias("confidence"))


# inconsistencies appear once entities are merged: two segments or two names for one customer
_SEG = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PAIRS = [(f"<{V}{a}>", f"<{V}{b}>") for i, a in enumerate(_SEG) for b in _SEG[i + 1 :]]
_LEX = "lower(regexp_replace(regexp_extract({x}, '(?s)^\"(.*)\"', 1), '\\s+', '', 'g'))"
_IRREFLEXIVE, _ASYMMETRIC = [f"<{V}follows>"], [f"<{V}parentOf>", f"<{V}customer>"]
_DISJOINT_PROPERTIES, _ALL_PROPERTIES = [(f"<{V}dislikes>", f"<{V}likes>")], [f"<{V}dislikes>", f"<{V}ignores>", f"<{V}likes>"]
_COMPLEMENTS, _ALL_CLASSES = [(f"<{V}Active>", f"<{V}Inactive>")], [f"<{V}Company>", f"<{V}Person>", f"<{V}Robot>"]
_NONE_OF = [(f"<{V}Hermit>", f"<{V}phone>")]
_NONE_IN, _NONE_AT_ALL = [(f"<{V}Loner>", f"<{V}friend>", f"<{V}Vip>")], [(f"<{V}Solo>", f"<{V}mate>", None)]


def _list(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


def _classes_sql(rule: str, pairs) -> str:
    return f"SELECT '{rule}' AS rule, a.s, a.k AS first, b.k AS second FROM tr a JOIN (VALUES {', '.join(f'({_list(p)})' for p in pairs)}) v(c1, c2) ON a.o = c1 JOIN tr b ON b.s = a.s AND b.o = c2 WHERE a.p = {TYPE} AND b.p = {TYPE}"


def _properties_sql(rule: str, pairs) -> str:
    return f"SELECT '{rule}', a.s, a.k, b.k FROM tr a JOIN (VALUES {', '.join(f'({_list(p)})' for p in pairs)}) v(p1, p2) ON a.p = p1 JOIN tr b ON b.s = a.s AND b.o = a.o AND b.p = p2"


_VIO = f"""{_CONS}, tr AS MATERIALIZED (SELECT DISTINCT s, p, o, concat_ws(' ', s, p, o) AS k FROM cons), nm AS (SELECT s, p, o, k AS st, {_LEX.format(x='o')} AS k FROM tr WHERE p = '{NAME}' AND starts_with(o, '"')),
  vi AS MATERIALIZED ({_classes_sql("cax-dw", _PAIRS)} UNION ALL {_classes_sql("cls-com", _COMPLEMENTS)} UNION ALL {_classes_sql("cax-adc", conflicts.all_disjoint(_ALL_CLASSES))}
  UNION ALL {_properties_sql("prp-pdw", _DISJOINT_PROPERTIES)} UNION ALL {_properties_sql("prp-adp", conflicts.all_disjoint(_ALL_PROPERTIES))}
  UNION ALL SELECT 'dt-fp', a.s, a.st, b.st FROM nm a JOIN nm b ON a.s = b.s AND a.p = b.p WHERE a.o < b.o AND a.k <> b.k
  UNION ALL SELECT CASE WHEN p LIKE '%differentFrom>' THEN 'eq-diff1' ELSE 'prp-irp' END, s, k, k FROM tr WHERE s = o AND p IN ({_list([*_IRREFLEXIVE, "<http://www.w3.org/2002/07/owl#differentFrom>"])})
  UNION ALL SELECT 'prp-asyp', a.s, a.k, b.k FROM tr a JOIN tr b ON a.s = b.o AND a.o = b.s AND a.p = b.p WHERE a.p IN ({_list(_ASYMMETRIC)}) AND a.s <= a.o
  UNION ALL SELECT 'cls-maxc1', a.s, a.k, b.k FROM tr a JOIN tr b ON a.s = b.s WHERE a.p = {TYPE} AND a.o = '{_NONE_OF[0][0]}' AND b.p = '{_NONE_OF[0][1]}'
  UNION ALL SELECT 'cls-maxqc1', a.s, a.k, b.k FROM tr a JOIN tr b ON a.s = b.s JOIN tr c ON c.s = b.o WHERE a.p = {TYPE} AND a.o = '{_NONE_IN[0][0]}' AND b.p = '{_NONE_IN[0][1]}' AND c.p = {TYPE} AND c.o = '{_NONE_IN[0][2]}'
  UNION ALL SELECT 'cls-maxqc2', a.s, a.k, b.k FROM tr a JOIN tr b ON a.s = b.s WHERE a.p = {TYPE} AND a.o = '{_NONE_AT_ALL[0][0]}' AND b.p = '{_NONE_AT_ALL[0][1]}')"""
_RK = ", rc AS (SELECT concat_ws(' ', s, p, o) AS k, max(coalesce(rank, 0.0)) AS rank FROM cons LEFT JOIN ranks r ON cons.c = r.node GROUP BY 1)"


def _violations(spark, d, cons):
    def table(rows, names):
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split())))

    classes, properties = "c1 c2", "p1 p2"
    found = [
        conflicts.disjoint_classes(cons, table(_PAIRS, classes)),
        conflicts.disjoint_classes(cons, table(_COMPLEMENTS, classes), "cls-com"),
        conflicts.disjoint_classes(cons, table(conflicts.all_disjoint(_ALL_CLASSES), classes), "cax-adc"),
        conflicts.disjoint_properties(cons, table(_DISJOINT_PROPERTIES, properties)),
        conflicts.disjoint_properties(cons, table(conflicts.all_disjoint(_ALL_PROPERTIES), properties), "prp-adp"),
        conflicts.differing_values(cons, [NAME]),
        conflicts.irreflexive(cons, _IRREFLEXIVE),
        conflicts.different_from_self(cons),
        conflicts.asymmetric(cons, _ASYMMETRIC),
        conflicts.max_cardinality_zero(cons, table(_NONE_OF, "cls p")),
        conflicts.max_qualified_zero(cons, table(_NONE_IN, "cls p on")),
        conflicts.max_qualified_zero(cons, table(_NONE_AT_ALL, "cls p on"), "cls-maxqc2"),
    ]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return written(out, "violations")


def _flat(rows):
    return rows.withColumn("first", F.concat_ws(" ", "first.s", "first.p", "first.o")).withColumn("second", F.concat_ws(" ", "second.s", "second.p", "second.o"))


def _triple_ranks(spark, d, cons):
    from quadrille.operators.joins import rank_by

    return rank.max_ranks(rank_by(cons.select("s", "p", "o", "c"), views(spark, d, "ranks")[0]))


@BOOK.add("i_rules", f"{_VIO} SELECT rule, s, first, second FROM vi")
def i_rules(spark, d):
    return _flat(_violations(spark, d, _contradictable(spark, d)))


@BOOK.add("i_subject", f"{_VIO} SELECT s, count(*) AS violations FROM vi GROUP BY s")
def i_subject(spark, d):
    return _violations(spark, d, _contradictable(spark, d)).groupBy("s").agg(F.count("*").alias("violations"))


@BOOK.add("i_degree", f"{_VIO}{_RK} SELECT rule, vi.s, first, second, least(coalesce(a.rank, 0.0), coalesce(b.rank, 0.0)) AS degree FROM vi LEFT JOIN rc a ON first = a.k LEFT JOIN rc b ON second = b.k")
def i_degree(spark, d):
    cons = _contradictable(spark, d)
    return _flat(conflicts.degrees(_violations(spark, d, cons), _triple_ranks(spark, d, cons)))


@BOOK.add("agg_incon_stats", f"{_VIO}{_RK} SELECT rule, count(*) AS violations, count(DISTINCT (least(first, second), greatest(first, second))) AS pairs, count(DISTINCT vi.s) AS subjects, max(least(coalesce(a.rank, 0.0), coalesce(b.rank, 0.0))) AS degree_max, round(sum(least(coalesce(a.rank, 0.0), coalesce(b.rank, 0.0))), 6) AS degree_sum FROM vi LEFT JOIN rc a ON first = a.k LEFT JOIN rc b ON second = b.k GROUP BY rule")
def agg_incon_stats(spark, d):
    cons = _contradictable(spark, d)
    return conflicts.rule_stats(conflicts.degrees(_violations(spark, d, cons), _triple_ranks(spark, d, cons))).withColumn("degree_sum", F.round("degree_sum", 6))


@BOOK.add("agg_incon_sets", f"{_VIO} SELECT least(first, second) AS first, greatest(first, second) AS second, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules, count(*) AS n, count(DISTINCT rule) = 1 AS one_rule FROM vi GROUP BY 1, 2")
def agg_incon_sets(spark, d):
    text = _flat(_violations(spark, d, _contradictable(spark, d)))
    g = conflicts.grouped(text)
    return g.select(F.element_at("statements", 1).alias("first"), F.element_at("statements", -1).alias("second"), F.array_join("rules", ",").alias("rules"), "n", (F.size("rules") == 1).alias("one_rule"))


@BOOK.add("i_provenance", f"{_CONS} SELECT s, p, o, array_to_string(list_sort(list(DISTINCT coalesce(s_orig, s))), ' ') AS ids FROM cons GROUP BY s, p, o")
def i_provenance(spark, d):
    return conflicts.alias_evidence(entities.consolidate(_all(spark, d), _pivots(spark, d), aliases=True)).withColumn("ids", F.array_join("ids", " "))


_EV = ", ie AS (SELECT concat_ws(' ', s, p, o) AS k, list(DISTINCT coalesce(s_orig, s)) AS ids FROM cons GROUP BY 1)"
_IIG = f"{_VIO}{_EV}, ig AS (SELECT DISTINCT s, least(u, v) AS a, greatest(u, v) AS b FROM (SELECT s, u, unnest(y) AS v FROM (SELECT vi.s, unnest(list_filter(a.ids, lambda i: NOT list_contains(b.ids, i))) AS u, list_filter(b.ids, lambda i: NOT list_contains(a.ids, i)) AS y FROM vi JOIN ie a ON first = a.k JOIN ie b ON second = b.k)))"


@BOOK.add("i_iig", f"{_IIG} SELECT s, a, b FROM ig WHERE a <> b")
def i_iig(spark, d):
    cons = _contradictable(spark, d)
    return conflicts.incompatible(_violations(spark, d, cons), conflicts.alias_evidence(cons))


def _repaired(spark, d):
    members = written(_pivots(spark, d), "members")
    cons = _contradictable(spark, d, members)
    apart = written(conflicts.incompatible(_violations(spark, d, cons), conflicts.alias_evidence(cons)), "apart").withColumnRenamed("s", "pivot")
    shared = views(spark, d, "q_sameas")[0].select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).where("a <> b").distinct()
    # from the pairs that have evidence to the classes, never all pairs of a class
    evidence = shared.join(members.select("pivot", F.col("node").alias("a")), "a").select("pivot", "a", "b", F.lit(1.0).alias("shared"), F.lit(0.0).alias("score"))
    return members, written(conflicts.repartition_classes(members, apart, evidence), "repaired")


@BOOK.add("i_partition", None)
def i_partition(spark, d):
    return _repaired(spark, d)[1]


@BOOK.add("i_split", None)
def i_split(spark, d):
    return _repaired(spark, d)[1].groupBy("pivot").agg(F.count("*").alias("size")).where("size = 1").select(F.col("pivot").alias("node"))


@BOOK.add("i_rewrite", None)
def i_rewrite(spark, d):
    members, fixed = _repaired(spark, d)
    new = fixed.withColumnRenamed("pivot", "fixed")
    pivots = members.join(new, "node", "left").select("node", F.coalesce("fixed", "pivot").alias("pivot"))
    return entities.consolidate(_all(spark, d), pivots, aliases=True)


_DELTA = f"{_VIO}{_RK}, de AS (SELECT DISTINCT CASE WHEN ra < rb THEN first WHEN rb < ra THEN second ELSE greatest(first, second) END AS k FROM (SELECT first, second, coalesce(a.rank, 0.0) AS ra, coalesce(b.rank, 0.0) AS rb FROM vi LEFT JOIN rc a ON first = a.k LEFT JOIN rc b ON second = b.k))"


@BOOK.add("i_repair_delta", f"{_DELTA}{_CLOSED}, rq AS (SELECT s, p, o, k AS k0, rank FROM tr JOIN rc USING (k)), iv AS ({_infer_sql('cl', ', rank, k0', 'rq')}) SELECT statement, max(rank) AS rank, min(origin) AS origin FROM (SELECT k AS statement, rank, 'asserted' AS origin FROM rc UNION ALL SELECT concat_ws(' ', s, p, o), rank, 'inferred' FROM iv WHERE k0 NOT IN (SELECT k FROM de)) WHERE statement NOT IN (SELECT k FROM de) GROUP BY statement")
def i_repair_delta(spark, d):
    """What is left when the weaker side of every violation goes: asserted statements, and inferences from those that are left."""
    pivots = written(_pivots(spark, d), "pivots")
    few = _contradictable(spark, d, pivots)
    gone = written(conflicts.weakest(_violations(spark, d, few), written(_triple_ranks(spark, d, few), "few-ranks")), "gone")
    every = entities.consolidate(_all(spark, d), pivots, aliases=True)
    left = written(_triple_ranks(spark, d, every).join(gone, ["s", "p", "o"], "left_anti"), "left")
    inferred = reason.infer(left, reason.templates(views(spark, d, "tbox")[0]), ("rank",), once=False)
    return conflicts.repair(left, inferred, gone).select(F.concat_ws(" ", "s", "p", "o").alias("statement"), "rank", "origin")
