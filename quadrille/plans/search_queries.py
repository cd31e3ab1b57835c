"""Queries on the text index and on look-ups of entities; documents are the subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import search, sets
from quadrille.plans.book import SAME, TYPE, Book, lang, strip
from quadrille.session import fresh_path, written
from quadrille.sources.quads import V, views

BOOK = Book()
KEYWORDS = ["the", "thon", "ea"][1:]
_TEXTS = "SELECT concat('<http://doc.example.org/', doc_id, '>') AS doc, 'text' AS field, text FROM {docs} UNION ALL SELECT concat('<http://doc.example.org/', doc_id, '>'), 'label', substr(text, 1, 40) FROM {docs}"
_STOP = ", ".join(f"'{w}'" for w in search.STOP)
_IX = f"WITH tx AS ({_TEXTS.format(docs='documents')}), wd AS (SELECT doc, field, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM tx WHERE length(text) < {search.MAX_LITERAL}), ix AS (SELECT term, doc, field, count(*) AS tf FROM wd WHERE term NOT IN ({_STOP}) GROUP BY ALL)"
_WORDS = ", ".join(f"'{w}'" for w in KEYWORDS)
_HITS = f"{_IX}, h AS (SELECT * FROM ix WHERE term IN ({_WORDS})), df AS (SELECT term, count(DISTINCT doc) AS df FROM h GROUP BY term), nd AS (SELECT count(*)::DOUBLE AS n FROM documents), sc AS (SELECT doc, round(sum(sqrt(tf) * (1 + ln(n / (df + 1))) ** 2 * CASE WHEN field = 'label' THEN 10.0 ELSE 1.0 END), 6) AS score FROM h JOIN df USING (term), nd GROUP BY doc HAVING count(DISTINCT term) = {len(KEYWORDS)})"


def _texts(spark, d):
    return spark.sql(_TEXTS.format(docs="{docs}"), docs=spark.read.parquet(f"{d}/documents.parquet"))


def _index(spark, d):
    return search.postings(_texts(spark, d))


def _hits(spark, d):
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    return search.search(_index(spark, d), n, KEYWORDS).withColumn("score", F.round("score", 6))


def _set(test: str) -> str:
    return f"coalesce(list_sort(list(DISTINCT o) FILTER ({test})), [])"


_DATE = " OR ".join(f"ends_with(o, '^^<{x}>')" for x in search.DATE_TYPES)
_FIELDS = {"labels": f"starts_with(o, '\"') AND p = '<{V}name>'", "comments": f"starts_with(o, '\"') AND p = '{search.COMMENTS[0]}'", "dates": f"starts_with(o, '\"') AND ({_DATE})", "types": f"p = {TYPE}"}
_OWN = f"({strip('s')}) = ({strip('c')})"
_REST = f"starts_with(o, '\"') AND p NOT IN ('<{V}name>', '{search.COMMENTS[0]}', '{search.LAT}', '{search.LONG}') AND NOT ({_DATE})"


@BOOK.add("txt_build", f""", qt AS (SELECT * FROM quads UNION ALL SELECT * FROM q_text UNION ALL SELECT * FROM q_sameas), sr AS (SELECT s AS node, max(rank) AS rank FROM quads JOIN ranks r ON c = r.node GROUP BY s)
  SELECT qt.s, {', '.join(f'{_set(v)} AS {k}, {_set(f"{v} AND {_OWN}")} AS auth_{k}' for k, v in _FIELDS.items())}, {_set(_REST)} AS texts, {_set(f"p = {SAME}")} AS same_as, {_set("o LIKE '<%.png>'")} AS images,
  min(o) FILTER (p = '{search.LAT}') AS lat, min(o) FILTER (p = '{search.LONG}') AS long, list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(qt.s, '^<[^:]*:/*[^/]*', '')), '[a-z0-9]+'))) AS keywords,
  coalesce(max(sr.rank), 1e-7) AS rank FROM qt LEFT JOIN sr ON qt.s = sr.node GROUP BY qt.s HAVING bool_or(p <> {SAME})""")
def txt_build(spark, d):
    quads, text, same = views(spark, d, "quads", "q_text", "q_sameas")
    said = written(quads.select("s", "c").distinct(), "said")  # far fewer than the quads, for documents and ranks alike
    ranks = views(spark, d, "ranks", given={"contexts": said.select("c").distinct()})[0]
    own = said.join(ranks, said["c"] == ranks["node"]).groupBy("s").agg(F.max("rank").alias("rank")).withColumnRenamed("s", "node")
    return search.subject_documents(quads.unionByName(text).unionByName(same), (f"<{V}name>",), own).drop("host")


for _name in ("txt_tokenize", "src_index_text"):
    @BOOK.add(_name, f"{_IX} SELECT term, doc, field, tf FROM ix", raw=True)
    def txt_tokenize(spark, d, stored=_name == "src_index_text"):
        if not stored:
            return _index(spark, d)
        path = fresh_path(spark, "postings")
        _index(spark, d).repartitionByRange("term").sortWithinPartitions("term", "doc").write.parquet(path)
        return spark.read.parquet(path)


@BOOK.add("txt_query", f"{_HITS} SELECT doc, score FROM sc", raw=True)
def txt_query(spark, d):
    return _hits(spark, d)


@BOOK.add("topk_hits", f"{_HITS} SELECT doc, score FROM sc ORDER BY score DESC, doc OFFSET 2 LIMIT 10", raw=True)
def topk_hits(spark, d):
    return sets.slice_hits(_hits(spark, d), 3, 12)


@BOOK.add("merge_results", f"{_HITS} SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS place FROM (SELECT * FROM sc ORDER BY score DESC, doc LIMIT 50)", raw=True)
def merge_results(spark, d):
    from pyspark.sql import Window

    top = _hits(spark, d).orderBy(F.desc("score"), "doc").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc")).cast("long"))


for _name in ("qry_keyword", "txt_snippet"):
    @BOOK.add(_name, f"{_HITS}, top AS (SELECT * FROM sc ORDER BY score DESC, doc LIMIT 10) SELECT doc AS s, 'hit' AS p, 'KeywordHit' AS o FROM top UNION ALL SELECT doc, 'label', '\"' || text || '\"' FROM top JOIN tx USING (doc) WHERE field = 'label' UNION ALL SELECT doc, 'type', '<{V}Text>' FROM top", raw=True)
    def qry_keyword(spark, d):
        hits = written(sets.slice_hits(_hits(spark, d), 1, 10), "hits")
        labels = _texts(spark, d).where("field = 'label'").select(F.col("doc").alias("s"), F.array(F.concat(F.lit('"'), "text", F.lit('"'))).alias("labels"))
        docs = labels.join(hits.select(F.col("doc").alias("s")), "s", "left_semi").select("s", "labels", F.array(F.lit(f"<{V}Text>")).alias("types"), F.array().cast("array<string>").alias("same_as"))
        return search.snippets(docs, hits)


_LEX = "regexp_extract(o, '(?s)^\"(.*)\"', 1)"


for _name in ("txt_pick", "fn_pref_lit"):
    @BOOK.add(_name, f"""SELECT s, o AS literal FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY (length({_LEX}) > 0) DESC, ({lang('o')} = 'no_lang' OR starts_with('de', {lang('o')})) DESC, c LIKE '%src1%' DESC, length({_LEX}), o) AS k FROM q_name WHERE starts_with(o, '"')) WHERE k = 1""")
    def txt_pick(spark, d):
        q = views(spark, d, "q_name")[0].where(t.is_literal(F.col("o")))
        return search.pick_literal(q.select("s", F.col("o").alias("literal"), F.col("c").like("%src1%").alias("auth")), "de")


HUB = "<http://o1.example.org/order/1>"


@BOOK.add("qry_focus", f", f AS (SELECT s, p, o FROM quads WHERE s = '{HUB}') SELECT DISTINCT s, p, o FROM (SELECT * FROM f UNION ALL SELECT '{HUB}', {TYPE}, '<urn:Focus>' UNION ALL SELECT s, p, o FROM q_name WHERE s IN (SELECT o FROM f))")
def qry_focus(spark, d):
    from quadrille.operators.joins import neighbourhood

    q, labels = views(spark, d, "quads", "q_name")
    mark = spark.createDataFrame([(HUB, t.RDF_TYPE, "<urn:Focus>")], "s string, p string, o string")
    return neighbourhood(q, HUB, labels).select("s", "p", "o").union(mark).distinct()


for _name in ("qry_entity", "qry_entities"):
    @BOOK.add(_name, ", w AS (SELECT o AS node, count(*) / 100.0 AS rank FROM q_orders GROUP BY o) SELECT n.s, min(n.o) AS label, max(coalesce(rank, 1e-7)) AS rank FROM q_name n LEFT JOIN w ON n.s = w.node WHERE n.p = '<http://ex.org/v#name>' AND " + ("n.s = '<http://c1.example.net/cust/1>'" if _name == "qry_entity" else "n.s LIKE '%cust/1%'") + " GROUP BY n.s")
    def qry_entity(spark, d, one=_name == "qry_entity"):
        names, orders = views(spark, d, "q_name", "q_orders")
        mine = names.where(F.col("p") == f"<{V}name>").where(F.col("s") == "<http://c1.example.net/cust/1>" if one else F.col("s").like("%cust/1%"))
        r = orders.groupBy(F.col("o").alias("s")).agg((F.count("*") / 100.0).alias("rank"))
        return mine.join(r, "s", "left").groupBy("s").agg(F.min("o").alias("label"), F.max(F.coalesce("rank", F.lit(t.MIN_RANK))).alias("rank"))
