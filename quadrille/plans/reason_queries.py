"""Queries on schema extraction and rule reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import reason
from quadrille.plans.book import TYPE, Book, strip
from quadrille.session import written
from quadrille.sources.quads import V, views

BOOK = Book()
_RULE = {"p": "'p'", "t": "'t'"}
_LISTS = f""", li(head, node) AS (SELECT s, s FROM tbox WHERE p = '{reason.FIRST}' UNION SELECT li.head, t.o FROM li JOIN tbox t ON t.s = li.node AND t.p = '{reason.REST}'), lm AS (SELECT DISTINCT li.head, t.o AS member FROM li JOIN tbox t ON t.s = li.node AND t.p = '{reason.FIRST}'),
  te AS MATERIALIZED (SELECT t.s, t.p, coalesce(m.member, t.o) AS o, t.o AS o0 FROM tbox t LEFT JOIN lm m ON t.o = m.head AND t.p IN ({", ".join(f"'{x}'" for x in reason.OF_LISTS)}))"""
_EDGES = _LISTS + ", ed AS (" + " UNION ALL ".join([*(f"SELECT '{k1}' AS k1, {c1} AS n1, '{k2}' AS k2, {c2} AS n2, {turn} AS turn, '{rule}' AS rule FROM te WHERE p = '{p}'" for rule, (p, (k1, c1, k2, c2, turn)) in reason.EDGES.items()), f"SELECT 'p', s, 'p', s, 1, 'prp-symp' FROM te WHERE p = {TYPE} AND o = '{reason.SYMMETRIC}'"]) + ")"
_CLOSED = f"{_EDGES}, cl(k1, n1, k2, n2, turn) AS (SELECT k1, n1, k2, n2, turn FROM ed UNION SELECT cl.k1, cl.n1, ed.k2, ed.n2, (cl.turn + ed.turn) % 2 FROM cl JOIN ed ON cl.k2 = ed.k1 AND cl.n2 = ed.n1)"


def _infer_sql(closed: str, extra: str = "", source: str = "quads") -> str:
    return f"""SELECT DISTINCT * FROM (SELECT CASE WHEN turn = 0 THEN s ELSE o END AS s, CASE WHEN k2 = 't' THEN {TYPE} ELSE n2 END AS p, CASE WHEN k2 = 't' THEN n2 WHEN turn = 0 THEN o ELSE s END AS o{extra}
  FROM {source} q JOIN {closed} e ON e.k1 = CASE WHEN q.p = {TYPE} THEN 't' ELSE 'p' END AND e.n1 = CASE WHEN q.p = {TYPE} THEN q.o ELSE q.p END) WHERE NOT starts_with(s, '"')"""


def _data(spark, d):
    return views(spark, d, "quads", "tbox")


@BOOK.add("r_tbox", "SELECT s, p, o, c FROM tbox")
def r_tbox(spark, d):
    small, tbox = _data(spark, d)
    return reason.schema_of(small.unionByName(tbox))


_FOREIGN = "<http://src1.example.org/doc/0>"  # a document that repeats the whole schema


@BOOK.add("r_auth", f"SELECT s, p, o, c FROM (SELECT *, {strip('s')} AS doc FROM (SELECT * FROM tbox UNION ALL SELECT s, p, o, '{_FOREIGN}' FROM tbox)) x LEFT JOIN redirects r ON doc = r.src WHERE coalesce(r.dst, doc) = c")
def r_auth(spark, d):
    """Of schema statements, those of the documents of their subjects."""
    tbox, redirects = views(spark, d, "tbox", "redirects")
    return reason.authoritative(tbox.unionByName(tbox.withColumn("c", F.lit(_FOREIGN))), redirects).select("s", "p", "o", "c")


for _name in ("r_template", "r_tbox_rec"):
    @BOOK.add(_name, f"{_CLOSED} SELECT k1, n1, k2, n2, turn FROM cl")
    def r_template(spark, d):
        return reason.templates(_data(spark, d)[1])


@BOOK.add("r_stats", f"{_CLOSED} SELECT k1, k2, count(*) AS templates, count(DISTINCT n1) AS heads FROM cl GROUP BY k1, k2")
def r_stats(spark, d):
    return reason.template_stats(reason.templates(_data(spark, d)[1]))


for _name in ("r_abox", "r_local"):
    @BOOK.add(_name, f"{_CLOSED} {_infer_sql('cl')}")
    def r_abox(spark, d):
        small, tbox = _data(spark, d)
        return reason.infer(small, reason.templates(tbox))


@BOOK.add("r_rules", _EDGES + " " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, s, p, o FROM ({_infer_sql(f'''(SELECT * FROM ed WHERE rule = '{rule}')''')})" for rule in [*reason.EDGES, "prp-symp"])
  + f" UNION ALL SELECT DISTINCT 'cls-hv2', s, {TYPE}, '<{V}Finnish>' FROM quads WHERE p = '<{V}nation>' AND starts_with(o, '\"7\"') UNION ALL SELECT DISTINCT 'cls-hv1', s, '<{V}status>', '\"done\"' FROM quads WHERE p = {TYPE} AND o = '<{V}OrderF>' UNION ALL SELECT DISTINCT 'cls-svf2', s, {TYPE}, '<{V}Mailer>' FROM quads WHERE p = '<{V}mbox>'")
def r_rules(spark, d):
    """Every rule for itself, applied once."""
    small, tbox = _data(spark, d)
    out, flat = None, written(reason.unlisted(tbox), "schema")
    for rule in [*reason.EDGES, "prp-symp"]:
        one = reason.infer(small, reason.edges(flat, (rule,), lists=False).select("k1", "n1", "k2", "n2", "turn")).select(F.lit(rule).alias("rule"), "s", "p", "o")
        out = one if out is None else out.union(one)
    seven = '"7"^^<http://www.w3.org/2001/XMLSchema#integer>'
    two = reason.has_value(small, spark.createDataFrame([(f"<{V}Finnish>", f"<{V}nation>", seven)], "cls string, prop string, value string"))
    one = reason.has_value(small, spark.createDataFrame([(f"<{V}OrderF>", f"<{V}status>", '"done"')], "cls string, prop string, value string"))
    some = reason.some_values_from(small, spark.createDataFrame([(f"<{V}Mailer>", f"<{V}mbox>")], "cls string, prop string"))
    for rule, rows in (("cls-hv2", two), ("cls-hv1", one), ("cls-svf2", some)):
        out = out.union(rows.select(F.lit(rule).alias("rule"), "s", "p", "o"))
    return out


_TBOX_RANK = "(1 + length(concat(s, {o})) % 6) / 10.0E0"  # of a schema statement
_RANKED_EDGES = _EDGES.replace(", ed AS (", ", tr_ AS (SELECT *, " + _TBOX_RANK.format(o="o0") + " AS rank FROM te), ed AS (").replace(" AS rule FROM te", " AS rule, rank FROM tr_").replace("'prp-symp' FROM te", "'prp-symp', rank FROM tr_")
_RANKED_CLOSED = f"{_RANKED_EDGES}, cx(k1, n1, k2, n2, turn, \"by\") AS (SELECT k1, n1, k2, n2, turn, rank FROM ed UNION SELECT cx.k1, cx.n1, ed.k2, ed.n2, (cx.turn + ed.turn) % 2, least(cx.by, ed.rank) FROM cx JOIN ed ON cx.k2 = ed.k1 AND cx.n2 = ed.n1), cl AS (SELECT k1, n1, k2, n2, turn, max(\"by\") AS \"by\" FROM cx GROUP BY ALL)"


@BOOK.add("r_annot", f"{_RANKED_CLOSED}, iv AS ({_infer_sql('cl', ', rank, e.by', 'ranked')}) SELECT s, p, o, max(rank) AS rank FROM (SELECT s, p, o, rank FROM ranked UNION ALL SELECT s, p, o, least(rank, \"by\", 0.5) FROM iv) GROUP BY s, p, o")
def r_annot(spark, d):
    """Inferences ranked by their statement, the weakest schema statement of the best way, and the rule."""
    ranked, tbox = views(spark, d, "ranked", "tbox")
    return reason.infer_ranked(ranked, reason.templates(tbox.withColumn("rank", F.expr(_TBOX_RANK.format(o="o"))), rank=True), 0.5)
