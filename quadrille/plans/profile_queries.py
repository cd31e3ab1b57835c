"""Queries that profile quads, vocabularies and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import rank, stats
from quadrille.plans.book import TYPE, Book, datatype, kind, lang, ns, pld, strip, tld
from quadrille.session import written
from quadrille.sources.quads import views

BOOK = Book()
_PS = ", g AS (SELECT s, p, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM quads) GROUP BY s, p), ps AS (SELECT coalesce(p, 'ALL') AS p, count(*) AS occurrences, sum(n)::BIGINT AS triples, sum(n)::DOUBLE / count(*) AS average FROM g GROUP BY ROLLUP (p))"
_ADJ = f"{_PS}, adj AS (SELECT ps.p, (ps.triples + a.triples / n::DOUBLE) / (ps.occurrences + a.occurrences / n::DOUBLE) AS adjusted FROM ps, (SELECT * FROM ps WHERE p = 'ALL') a, (SELECT count(*) AS n FROM ps))"


@BOOK.add("agg_predstats", f"{_PS} SELECT p, occurrences, triples, round(average, 9) AS average FROM ps")
def agg_predstats(spark, d):
    return stats.predicate_stats(views(spark, d, "quads")[0]).withColumn("average", F.round("average", 9))


@BOOK.add("agg_predadj", f"{_ADJ} SELECT p, round(adjusted, 9) AS adjusted FROM adj")
def agg_predadj(spark, d):
    return stats.adjusted_averages(stats.predicate_stats(views(spark, d, "quads")[0])).select("p", F.round("adjusted", 9).alias("adjusted"))


@BOOK.add("topk_preds", f"{_PS}, k AS (SELECT p, average, row_number() OVER (ORDER BY average DESC, p) AS hi, row_number() OVER (ORDER BY average, p) AS lo FROM ps WHERE p <> 'ALL') SELECT p, round(average, 9) AS average, 'top' AS side FROM k WHERE hi <= 3 UNION ALL SELECT p, round(average, 9), 'bottom' FROM k WHERE lo <= 3")
def topk_preds(spark, d):
    rows = stats.predicate_stats(views(spark, d, "quads")[0]).where("p <> 'ALL'").select("p", "average")
    top = rows.orderBy(F.desc("average"), "p").limit(3).withColumn("side", F.lit("top"))
    return top.union(rows.orderBy("average", "p").limit(3).withColumn("side", F.lit("bottom"))).withColumn("average", F.round("average", 9))


@BOOK.add("agg_histogram", "SELECT n, count(*) AS keys FROM (SELECT s, count(*) AS n FROM quads GROUP BY s) GROUP BY n")
def agg_histogram(spark, d):
    return stats.histogram(views(spark, d, "quads")[0], "s")


@BOOK.add("agg_econ_stats", f""", r AS (SELECT s AS term, 0 AS side, s, p, o, c FROM quads UNION ALL SELECT o, 1, s, p, o, c FROM quads WHERE p <> {TYPE} AND NOT starts_with(o, '"')), z AS (SELECT *, {pld('c')} AS pld, {pld('term')} AS own FROM r)
  SELECT term, count(DISTINCT CASE WHEN side = 0 THEN concat(s, ' ', p, ' ', o) END) AS as_subject, count(DISTINCT CASE WHEN side = 1 THEN concat(s, ' ', p, ' ', o) END) AS as_object, count(DISTINCT c) AS documents, count(DISTINCT pld) AS plds, count(DISTINCT CASE WHEN pld <> own THEN pld END) AS external_plds FROM z GROUP BY term""")
def agg_econ_stats(spark, d):
    return stats.term_stats(views(spark, d, "quads")[0])


@BOOK.add("agg_hobo_stats", f", z AS (SELECT *, {pld('c')} AS pld FROM quads) SELECT coalesce(pld, 'ALL_PLDS') AS pld, count(*) AS quads, count(DISTINCT s) AS subjects, count(DISTINCT CASE WHEN starts_with(s, '_:') THEN s END) AS blank_subjects, count(DISTINCT c) AS documents, count(DISTINCT p) AS predicates FROM z GROUP BY ROLLUP (pld)")
def agg_hobo_stats(spark, d):
    return stats.naming_stats(views(spark, d, "quads")[0])


_PROFILE = f""", tr AS (SELECT DISTINCT s, p, o FROM quads), pr AS (
  SELECT 'entities' AS measure, '' AS name, count(DISTINCT s) AS n FROM tr UNION ALL SELECT 'triples', '', count(*) FROM tr UNION ALL SELECT 'predicates', '', count(DISTINCT p) FROM tr
  UNION ALL SELECT 'classes', '', count(DISTINCT CASE WHEN p = {TYPE} THEN o END) FROM tr UNION ALL SELECT 'class', o, count(*) FROM tr WHERE p = {TYPE} GROUP BY o UNION ALL SELECT 'predicate', p, count(*) FROM tr GROUP BY p
  UNION ALL SELECT 'object_kind', {kind('o')}, count(*) FROM tr GROUP BY 2 UNION ALL SELECT 'namespace', {ns('p')}, count(*) FROM (SELECT DISTINCT p FROM tr) GROUP BY 2
  UNION ALL SELECT 'out_degree', CAST(d AS VARCHAR), count(*) FROM (SELECT s, count(*) AS d FROM tr GROUP BY s) GROUP BY d)"""


@BOOK.add("agg_spoc_stats", f"{_PROFILE} SELECT measure, name, n FROM pr")
def agg_spoc_stats(spark, d):
    return stats.dataset_profile(views(spark, d, "quads")[0])


_INT = "'\"', n, '\"^^<http://www.w3.org/2001/XMLSchema#integer> .'"
_VOID = "http://rdfs.org/ns/void#"


@BOOK.add("sink_void", f"""{_PROFILE}, w AS (SELECT * FROM (VALUES ('entities', 'entities'), ('triples', 'triples'), ('predicates', 'properties'), ('classes', 'classes')) v(measure, word)),
  x AS (SELECT *, '_:' || md5(name) AS b, CASE WHEN measure = 'class' THEN 'class' ELSE 'property' END AS k, CASE WHEN measure = 'class' THEN 'entities' ELSE 'triples' END AS u FROM pr WHERE measure IN ('class', 'predicate'))
  SELECT concat('<urn:dataset> <{_VOID}', word, '> ', {_INT}) AS line FROM pr JOIN w USING (measure) UNION ALL SELECT concat('<urn:dataset> <{_VOID}', k, 'Partition> ', b, ' .') FROM x UNION ALL SELECT concat(b, ' <{_VOID}', k, '> ', name, ' .') FROM x UNION ALL SELECT concat(b, ' <{_VOID}', u, '> ', {_INT}) FROM x""")
def sink_void(spark, d):
    return stats.void_lines(stats.dataset_profile(views(spark, d, "quads")[0]), "urn:dataset")


_SPOTS = f"SELECT {strip('c')} AS src, s AS x FROM quads UNION ALL SELECT {strip('c')}, o FROM quads WHERE p <> {TYPE}"
_PLD_LINKS = f", dl AS (SELECT DISTINCT {pld('src')} AS src, {pld('x')} AS dst FROM ({_SPOTS}) WHERE starts_with(x, '<'))"


@BOOK.add("agg_cspo_stats", f"""{_PLD_LINKS} SELECT 'pld' AS measure, {pld('c')} AS name, count(DISTINCT c) AS n FROM quads GROUP BY 2 UNION ALL SELECT 'predicate', p, count(DISTINCT c) FROM quads GROUP BY p UNION ALL SELECT 'class', o, count(DISTINCT c) FROM quads WHERE p = {TYPE} GROUP BY o
  UNION ALL SELECT 'pld_out', src, count(*) FROM dl WHERE src <> dst GROUP BY src UNION ALL SELECT 'pld_in', dst, count(*) FROM dl WHERE src <> dst GROUP BY dst""")
def agg_cspo_stats(spark, d):
    """Documents by domain, predicate and class; domains that each links to and that link to it."""
    quads = views(spark, d, "quads")[0]
    links = written(rank.domain_links(quads), "domain-links")
    out = stats.document_profile(quads).withColumnRenamed("documents", "n")
    for measure, end in (("pld_out", "src"), ("pld_in", "dst")):
        out = out.union(links.groupBy(end).agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), F.col(end).alias("name"), "n"))
    return out


@BOOK.add("agg_classpred", f""", k AS (SELECT c, 'class' AS kind, o AS name FROM quads WHERE p = {TYPE} UNION ALL SELECT c, 'predicate', p FROM quads UNION ALL SELECT c, 'datatype', {datatype('o')} FROM quads WHERE starts_with(o, '"')),
  g AS (SELECT kind, name, c, count(*) AS n FROM k GROUP BY ALL) SELECT kind, name, sum(n)::BIGINT AS n, count(*) AS documents, count(DISTINCT {pld('c')}) AS plds, round(sum(coalesce(rank, 1e-7)), 4) AS rank_sum, max(coalesce(rank, 1e-7)) AS rank_max FROM g LEFT JOIN ranks r ON g.c = r.node GROUP BY kind, name""")
def agg_classpred(spark, d):
    q, r = views(spark, d, "quads", "ranks")
    return stats.ranked_vocabulary(q, r).withColumn("rank_sum", F.round("rank_sum", 4))


@BOOK.add("agg_lang", f"""SELECT 'lang' AS measure, {lang('o')} AS a, '' AS b, count(*) AS n FROM quads WHERE starts_with(o, '"') GROUP BY 2 {''.join(f"UNION ALL SELECT 'tld_{x}', {tld(x)}, '', count(*) FROM quads GROUP BY 2 " for x in 'spoc')}
  UNION ALL SELECT 'tld_type', {tld('o')}, '', count(*) FROM quads WHERE p = {TYPE} GROUP BY 2 UNION ALL SELECT 'lang_tld', {lang('o')}, {tld('c')}, count(*) FROM quads WHERE starts_with(o, '"') GROUP BY 2, 3""")
def agg_lang(spark, d):
    return stats.language_stats(views(spark, d, "quads")[0])


@BOOK.add("agg_dupes", ", t AS (SELECT s, p, o, count(DISTINCT CASE WHEN NOT starts_with(c, '<urn:rule:') THEN c END) AS asserted, count(DISTINCT CASE WHEN starts_with(c, '<urn:rule:') THEN c END) AS inferred FROM (SELECT * FROM q_orders UNION ALL SELECT * FROM q_inferred) GROUP BY s, p, o) SELECT asserted, inferred, count(*) AS triples FROM t GROUP BY ALL")
def agg_dupes(spark, d):
    a, b = views(spark, d, "q_orders", "q_inferred")
    return stats.duplicate_contexts(a.unionByName(b))


@BOOK.add("agg_rdfvocab", f""", tr AS (SELECT DISTINCT s, p, o FROM quads), u AS (SELECT * FROM tr WHERE contains(p, '22-rdf-syntax-ns#') OR contains(o, '22-rdf-syntax-ns#'))
  SELECT 'class' AS kind, o AS name, count(*) AS n FROM u WHERE p = {TYPE} GROUP BY o UNION ALL SELECT 'predicate', p, count(*) FROM u GROUP BY p
  UNION ALL SELECT 'literal_predicate', p, count(*) FROM tr WHERE starts_with(o, '"') GROUP BY p UNION ALL SELECT 'datatype', {datatype('o')}, count(*) FROM tr WHERE starts_with(o, '"') GROUP BY 2""")
def agg_rdfvocab(spark, d):
    """Classes and predicates of statements that use the RDF vocabulary; predicates of literals and datatypes of all."""
    rdf, p, o = "22-rdf-syntax-ns#", F.col("p"), F.col("o")
    used = p.contains(rdf) | o.contains(rdf)
    kinds = (("class", F.when(used & (p == t.RDF_TYPE), o)), ("predicate", F.when(used, p)), ("literal_predicate", F.when(t.is_literal(o), p)), ("datatype", F.when(t.is_literal(o), t.datatype(o))))
    spots = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in kinds)))
    return views(spark, d, "quads")[0].select("s", "p", "o").distinct().select(spots.alias("e")).where("e.name IS NOT NULL").groupBy("e.kind", "e.name").agg(F.count("*").alias("n"))


@BOOK.add("agg_ns", f", x AS (SELECT DISTINCT 'class' AS kind, o AS term FROM quads WHERE p = {TYPE} UNION SELECT 'predicate', p FROM quads) SELECT kind, {ns('term')} AS ns, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT 'all', {ns('term')}, count(*) FROM x GROUP BY 2")
def agg_ns(spark, d):
    q = views(spark, d, "quads")[0]
    x = q.where(F.col("p") == t.RDF_TYPE).select(F.lit("class").alias("kind"), F.col("o").alias("term")).union(q.select(F.lit("predicate"), "p")).distinct()
    both = x.select(F.explode(F.array("kind", F.lit("all"))).alias("kind"), t.namespace(F.col("term")).alias("ns"))
    return both.groupBy("kind", "ns").agg(F.count("*").alias("n"))


@BOOK.add("agg_patterncard", f", te AS (SELECT DISTINCT s AS term FROM tbox), pt AS (SELECT 'predicate' AS kind, term FROM te UNION ALL SELECT 'class', term FROM te) SELECT kind, term, count(q.s) AS n FROM pt LEFT JOIN quads q ON CASE WHEN kind = 'predicate' THEN q.p = term ELSE q.p = {TYPE} AND q.o = term END GROUP BY kind, term")
def agg_patterncard(spark, d):
    """Statements that each pattern with a term of the schema matches: (?, term, ?) and (?, type, term); none count 0."""
    quads, tbox = views(spark, d, "quads", "tbox")
    spots = F.explode(F.array(F.struct(F.lit("predicate").alias("kind"), F.col("p").alias("term")), F.struct(F.lit("class").alias("kind"), F.when(F.col("p") == t.RDF_TYPE, F.col("o")).alias("term"))))
    met = quads.select(spots.alias("e")).groupBy("e.kind", "e.term").agg(F.count("*").alias("n"))
    patterns = tbox.select(F.col("s").alias("term")).distinct().select(F.explode(F.array(F.lit("predicate"), F.lit("class"))).alias("kind"), "term")
    return patterns.join(met, ["kind", "term"], "left").select("kind", "term", F.coalesce("n", F.lit(0)).alias("n"))
