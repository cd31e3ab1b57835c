"""Queries on sources, exchanges, scalar functions, joins, sets, orders and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import joins, sets
from quadrille.operators.entities import JUNK
from quadrille.plans.book import SAME, TYPE, Book, datatype, host, kind, lang, ns, pld, strip, tld
from quadrille.session import fresh_path
from quadrille.sources import quads as src
from quadrille.sources.quads import TYPE as RDF_TYPE
from quadrille.sources.quads import V, views

BOOK = Book()
Q = ("s", "p", "o", "c")
HUB = "<http://o1.example.org/order/1>"


def _round_trip(spark, d):
    path = fresh_path(spark, "nquads")
    src.write_nquads(views(spark, d, "quads")[0], path)
    return path


@BOOK.add("src_nq", "SELECT s, p, o, c FROM quads")
def src_nq(spark, d):
    return src.read_nquads(spark, _round_trip(spark, d))


@BOOK.add("sink_nq", "SELECT concat(s, ' ', p, ' ', o, ' ', c, ' .') AS line FROM quads")
def sink_nq(spark, d):
    return spark.read.text(_round_trip(spark, d)).select(F.col("value").alias("line"))


def _block(spark, d):
    path = fresh_path(spark, "block")
    src.write_block(views(spark, d, "quads")[0], path)
    return src.read_block(spark, path)


@BOOK.add("sink_block", "SELECT s, p, o, c FROM quads")
def sink_block(spark, d):
    return _block(spark, d).select(*Q)


@BOOK.add("src_block", "SELECT p, count(*) AS n FROM quads GROUP BY p")
def src_block(spark, d):
    return _block(spark, d).groupBy("p").agg(F.count("*").alias("n"))


@BOOK.add("src_lookup", f"SELECT s, p, o, c FROM quads WHERE s = '{HUB}'")
def src_lookup(spark, d):
    return src.lookup(_block(spark, d), s=HUB).select(*Q)


@BOOK.add("src_seeds", "SELECT DISTINCT url FROM pages", raw=True)
def src_seeds(spark, d):
    path = fresh_path(spark, "seeds")
    spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit(" "), "url").alias("value")).write.text(path, compression="gzip")
    return src.read_seeds(spark, path)


@BOOK.add("src_redirects", 'SELECT src AS "from", dst AS "to" FROM redirects')
def src_redirects(spark, d):
    path = fresh_path(spark, "redirects")
    views(spark, d, "redirects")[0].select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    return src.read_redirects(spark, path)


@BOOK.add("part_hash", "SELECT count(DISTINCT s) AS keys, CAST(0 AS BIGINT) AS split_keys FROM quads")
def part_hash(spark, d):
    placed = views(spark, d, "quads")[0].repartition(8, "s").withColumn("part", F.spark_partition_id())
    per = placed.groupBy("s").agg(F.count_distinct("part").alias("parts"))
    return per.agg(F.count("*").alias("keys"), F.coalesce(F.sum((F.col("parts") > 1).cast("long")), F.lit(0)).cast("long").alias("split_keys"))


@BOOK.add("scatter_gather", "SELECT s, p, o, c FROM quads")
def scatter_gather(spark, d):
    return views(spark, d, "quads")[0].repartition("s").sortWithinPartitions(*Q)


@BOOK.add("scatter_filtered", f"SELECT o, p, s, c FROM quads WHERE p <> {TYPE}")
def scatter_filtered(spark, d):
    return views(spark, d, "quads")[0].where(F.col("p") != RDF_TYPE).select("o", "p", "s", "c").repartition("o").sortWithinPartitions("o", "p", "s", "c")


@BOOK.add("prj_reorder", "SELECT c, s, p, o FROM quads")
def prj_reorder(spark, d):
    return views(spark, d, "quads")[0].select("c", "s", "p", "o")


@BOOK.add("prj_append", "SELECT s, p, o, c, '0' AS side FROM quads UNION ALL SELECT o, p, s, c, '1' FROM quads")
def prj_append(spark, d):
    q = views(spark, d, "quads")[0]
    return q.withColumn("side", F.lit("0")).union(q.select("o", "p", "s", "c", F.lit("1")))


@BOOK.add("flt_pred", f"SELECT s, p, o, c FROM quads WHERE p IN ('<{V}customer>', '<{V}name>')")
def flt_pred(spark, d):
    return views(spark, d, "quads")[0].where(F.col("p").isin(f"<{V}customer>", f"<{V}name>"))


@BOOK.add("flt_pattern", f"SELECT s, p, o, c FROM quads WHERE (p = {TYPE} AND o = '<{V}OrderF>') OR s = '{HUB}' OR p = '<{V}mbox>'")
def flt_pattern(spark, d):
    return joins.matching(views(spark, d, "quads")[0], [(None, RDF_TYPE, f"<{V}OrderF>"), (HUB, None, None), (None, f"<{V}mbox>", None)])


_JUNK = ", ".join(f"'{x}'" for x in ("<mailto:3.7@example.org>", *JUNK))


@BOOK.add("flt_blacklist", f"SELECT s, p, o, c FROM quads WHERE o NOT IN ({_JUNK}) AND p <> '<{V}nation>'")
def flt_blacklist(spark, d):
    return views(spark, d, "quads")[0].where(~F.col("o").isin("<mailto:3.7@example.org>", *JUNK) & (F.col("p") != f"<{V}nation>"))


_BAD = " OR ".join([*(f"ends_with(lower(url), '{x}')" for x in t.BAD_SUFFIXES), *(f"contains(lower(url), '{x}')" for x in t.BAD_PARTS)])


@BOOK.add("flt_link", f"SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'http://') AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#>]+([^?#>]*)', 1) <> '' AND NOT ({_BAD})", raw=True)
def flt_link(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").where(t.admissible_link(F.col("url"))).select("page_id", "url")


@BOOK.add("fn_norm_url", """SELECT page_id, h || CASE WHEN starts_with(r, '/') OR h = '' THEN r ELSE '/' || r END AS url FROM (
  SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS h, regexp_replace(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', '') AS r FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))""", raw=True)
def fn_norm_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.normal_url(F.col("url")).alias("url"))


def _scalar(name, expr, sql, view="quads"):
    @BOOK.add(name, f"SELECT DISTINCT o AS term, {sql} AS value FROM {view}")
    def run(spark, d):
        return views(spark, d, view)[0].select(F.col("o").alias("term"), expr(F.col("o")).alias("value")).distinct()


_scalar("fn_strip_frag", t.strip_fragment, strip("o"))
_scalar("fn_pld", t.pay_level_domain, pld("o"))
_scalar("fn_tld", t.top_level_domain, tld("o"))
_scalar("fn_ns", t.namespace, ns("o"))
_scalar("fn_lang", t.language, lang("o"))
_scalar("fn_dt", t.datatype, datatype("o"))
_scalar("fn_kind", t.kind, kind("o"))
_scalar("fn_img", t.is_image, "regexp_matches(lower(o), '\\.(jpg|jpeg|png|gif|svg)>?$')")
_scalar("fn_fixcard", t.fix_cardinality, "CASE WHEN starts_with(o, '\"') AND regexp_extract(o, '^\"(.*?)\"', 1) = '1' THEN '\"1\"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger>' ELSE o END")


@BOOK.add("fn_tokenize", f"SELECT DISTINCT s AS term, {host('s')} AS host, regexp_extract(s, '^<?[A-Za-z][A-Za-z0-9+.-]*://[^/?#>]*([^?#>]*)', 1) AS path FROM quads")
def fn_tokenize(spark, d):
    return views(spark, d, "quads")[0].select(F.col("s").alias("term"), t.host(F.col("s")).alias("host"), t.path(F.col("s")).alias("path")).distinct()


@BOOK.add("fn_rank_scale", "SELECT node, round(1e-7 + (1 - 1e-7) * rank, 9) AS value FROM ranks")
def fn_rank_scale(spark, d):
    return views(spark, d, "ranks")[0].select("node", F.round(t.scale_rank(F.col("rank")), 9).alias("value"))


@BOOK.add("join_rank_ctx", "SELECT q.*, coalesce(r.rank, 0.0) AS rank FROM quads q LEFT JOIN ranks r ON q.c = r.node")
def join_rank_ctx(spark, d):
    q, r = views(spark, d, "quads", "ranks")
    return joins.rank_by(q, r)


@BOOK.add("part_rewrite_bcast", "SELECT q.*, coalesce(r.rank, 0.0) AS rank FROM q_orders q LEFT JOIN ranks r ON q.c = r.node")
def part_rewrite_bcast(spark, d):
    q, r = views(spark, d, "q_orders", "ranks")
    size = r.count()  # a row for each document: broadcast only while it is small
    return joins.rank_by(q, F.broadcast(r) if size <= 1_000_000 else r)


@BOOK.add("join_rank_subj", f", w AS (SELECT {strip('o')} AS node, count(*) / 100.0 AS rank FROM q_ref GROUP BY 1) SELECT q.*, coalesce(w.rank, 1e-7) AS rank FROM quads q LEFT JOIN w ON q.s = w.node")
def join_rank_subj(spark, d):
    q, ref = views(spark, d, "quads", "q_ref")
    r = ref.groupBy(t.strip_fragment(F.col("o")).alias("node")).agg((F.count("*") / 100.0).alias("rank"))
    return joins.rank_by(q, r, "s", t.MIN_RANK)


_PIV = ", piv AS (SELECT o AS node, min(s) AS pv FROM q_sameas GROUP BY o)"


def _pivots(spark, d):
    return views(spark, d, "q_sameas")[0].groupBy(F.col("o").alias("node")).agg(F.min("s").alias("pivot"))


@BOOK.add("join_rewrite", f"{_PIV} SELECT coalesce(v.pv, q.s) AS s, q.p, q.o, q.c, CASE WHEN v.pv <> q.s THEN q.s END AS s_orig FROM (SELECT * FROM quads UNION ALL SELECT * FROM q_sameas) q LEFT JOIN piv v ON q.s = v.node WHERE q.p <> {SAME}")
def join_rewrite(spark, d):
    q, same = views(spark, d, "quads", "q_sameas")
    return joins.rewrite(q.unionByName(same), _pivots(spark, d), "s", "filter", "s_orig")


@BOOK.add("join_rewrite_sort", f"{_PIV}, r AS (SELECT q.s, q.p, coalesce(v.pv, q.o) AS o, q.c FROM q_orders q LEFT JOIN piv v ON q.o = v.node) SELECT * FROM r UNION ALL SELECT o, p, s, c FROM r")
def join_rewrite_sort(spark, d):
    r = joins.rewrite(views(spark, d, "q_orders")[0], _pivots(spark, d), "o")
    return r.union(r.select("o", "p", "s", "c")).sortWithinPartitions(*Q)


@BOOK.add("join_hash_rewrite", f"""{_PIV} SELECT 's' AS position, count(*) AS possible, count(pv) AS indexed, coalesce(sum(CASE WHEN pv <> s THEN 1 ELSE 0 END), 0)::BIGINT AS rewritten FROM quads q LEFT JOIN piv v ON q.s = v.node WHERE q.p <> {SAME}
  UNION ALL SELECT 'o', count(*), count(pv), coalesce(sum(CASE WHEN pv <> o THEN 1 ELSE 0 END), 0)::BIGINT FROM quads q LEFT JOIN piv v ON q.o = v.node WHERE q.p NOT IN ({SAME}, {TYPE}) AND NOT starts_with(o, '"')""")
def join_hash_rewrite(spark, d):
    return joins.rewrite_counts(views(spark, d, "quads")[0], _pivots(spark, d))


@BOOK.add("join_selfpair", ", v AS (SELECT DISTINCT p, o, s FROM q_name), k AS (SELECT p, o FROM v GROUP BY p, o HAVING count(*) BETWEEN 2 AND 38) SELECT a.p, a.o, a.s AS a, b.s AS b FROM k JOIN v a USING (p, o) JOIN v b USING (p, o) WHERE a.s < b.s")
def join_selfpair(spark, d):
    return joins.shared_value_pairs(views(spark, d, "q_name")[0])


@BOOK.add("join_rule_body", f"SELECT DISTINCT a.s, a.o AS customer, b.o AS part FROM q_orders a JOIN q_line b ON a.s = b.s WHERE b.p = '<{V}part>'")
def join_rule_body(spark, d):
    a, b = views(spark, d, "q_orders", "q_line")
    return a.select("s", F.col("o").alias("customer")).join(b.where(F.col("p") == f"<{V}part>").select("s", F.col("o").alias("part")), "s").distinct()


@BOOK.add("join_semi_nodes", ", n AS (SELECT o AS node FROM q_sameas) SELECT DISTINCT s, p, o, c FROM quads WHERE s IN (SELECT node FROM n) OR p IN (SELECT node FROM n) OR o IN (SELECT node FROM n)")
def join_semi_nodes(spark, d):
    q, same = views(spark, d, "quads", "q_sameas")
    return joins.touching(q, same.select(F.col("o").alias("node")))


@BOOK.add("join_rankset", "SELECT sum(CASE WHEN rank IN (SELECT rank FROM ranks WHERE node LIKE '%src1%') THEN 1 ELSE 0 END)::BIGINT AS within, sum(CASE WHEN rank IN (SELECT rank FROM ranks WHERE node LIKE '%src1%') THEN 0 ELSE 1 END)::BIGINT AS without FROM ranked")
def join_rankset(spark, d):
    rows, ranks = views(spark, d, "ranked", "ranks")
    known = ranks.where("node LIKE '%src1%'").select("rank").distinct().withColumn("hit", F.lit(1))
    hit = F.col("hit").isNotNull()
    return rows.join(known, "rank", "left").agg(F.sum(hit.cast("long")).alias("within"), F.sum((~hit).cast("long")).alias("without"))


@BOOK.add("join_focus_entities", f", f AS (SELECT s, p, o, c FROM quads WHERE s = '{HUB}') SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT s, p, o, c FROM q_name WHERE s IN (SELECT p FROM f UNION ALL SELECT o FROM f))")
def join_focus_entities(spark, d):
    q, labels = views(spark, d, "quads", "q_name")
    return joins.neighbourhood(q, HUB, labels)


@BOOK.add("win_first_per_key", "SELECT s, min(o) AS o FROM q_line GROUP BY s")
def win_first_per_key(spark, d):
    return sets.first_per_key(views(spark, d, "q_line")[0], ["s"], ["o", "p", "c"]).select("s", "o")


@BOOK.add("win_active_group", ", r AS (SELECT s, p, o, c, CASE WHEN s IN (SELECT o FROM q_sameas) THEN s END AS alias FROM q_name) SELECT * FROM r WHERE s IN (SELECT s FROM r WHERE alias IS NOT NULL)")
def win_active_group(spark, d):
    q, same = views(spark, d, "q_name", "q_sameas")
    known = same.select(F.col("o").alias("s")).distinct().withColumn("alias", F.col("s"))
    return sets.active_groups(q.join(known, "s", "left").select(*Q, "alias"), "s", "alias")


@BOOK.add("srt_ext", "SELECT o, p, s, c, row_number() OVER (ORDER BY o, p, s, c) AS pos FROM q_name")
def srt_ext(spark, d):
    return sets.numbered(views(spark, d, "q_name")[0].select("o", "p", "s", "c"), ["o", "p", "s", "c"])


@BOOK.add("srt_merge", "SELECT * FROM q_name UNION ALL SELECT * FROM q_sameas")
def srt_merge(spark, d):
    a, b = views(spark, d, "q_name", "q_sameas")
    return a.unionByName(b).repartitionByRange("s").sortWithinPartitions(*Q)


@BOOK.add("srt_check", "SELECT CAST(0 AS BIGINT) AS unsorted")
def srt_check(spark, d):
    return sets.unsorted_rows(_block(spark, d), Q).agg(F.coalesce(F.sum("unsorted"), F.lit(0)).cast("long").alias("unsorted"))


@BOOK.add("lim_pld", f"SELECT url, n FROM (SELECT *, row_number() OVER (PARTITION BY {pld('url')} ORDER BY n DESC, url) AS k FROM (SELECT o AS url, count(*) AS n FROM q_line GROUP BY o)) WHERE k <= 10")
def lim_pld(spark, d):
    links = views(spark, d, "q_line")[0].groupBy(F.col("o").alias("url")).agg(F.count("*").alias("n"))
    return sets.per_key_limit(links.withColumn("pld", t.pay_level_domain(F.col("url"))), "pld", [F.desc("n"), "url"], 10).select("url", "n")


@BOOK.add("set_union", "SELECT * FROM q_orders UNION ALL SELECT * FROM q_inferred")
def set_union(spark, d):
    a, b = views(spark, d, "q_orders", "q_inferred")
    return a.unionByName(b)


@BOOK.add("set_distinct", "SELECT DISTINCT s, p, o, c FROM q_line")
def set_distinct(spark, d):
    return views(spark, d, "q_line")[0].distinct()


@BOOK.add("set_reasoned_dupes", ", u AS (SELECT *, starts_with(c, '<urn:rule:') AS i FROM (SELECT * FROM q_orders UNION ALL SELECT * FROM q_inferred)), w AS (SELECT *, bool_or(NOT i) OVER (PARTITION BY s, p, o) AS a, row_number() OVER (PARTITION BY s, p, o ORDER BY i, c) AS k FROM u) SELECT s, p, o, c FROM w WHERE CASE WHEN a THEN NOT i ELSE k = 1 END")
def set_reasoned_dupes(spark, d):
    a, b = views(spark, d, "q_orders", "q_inferred")
    return sets.drop_inferred_duplicates(a.unionByName(b))


@BOOK.add("set_minus_old", "SELECT s, p, o FROM q_inferred EXCEPT SELECT s, p, o FROM q_orders")
def set_minus_old(spark, d):
    a, b = views(spark, d, "q_inferred", "q_orders")
    return a.select("s", "p", "o").subtract(b.select("s", "p", "o"))


@BOOK.add("set_intersect", "SELECT s, p, o FROM q_inferred INTERSECT SELECT s, p, o FROM q_orders")
def set_intersect(spark, d):
    a, b = views(spark, d, "q_inferred", "q_orders")
    return a.select("s", "p", "o").intersect(b.select("s", "p", "o"))


@BOOK.add("set_diff_debug", "SELECT s, p, o, 'left' AS side FROM (SELECT s, p, o FROM q_inferred EXCEPT ALL SELECT s, p, o FROM q_orders) UNION ALL SELECT s, p, o, 'right' FROM (SELECT s, p, o FROM q_orders EXCEPT ALL SELECT s, p, o FROM q_inferred)")
def set_diff_debug(spark, d):
    a, b = views(spark, d, "q_inferred", "q_orders")
    return sets.difference(a.select("s", "p", "o"), b.select("s", "p", "o"))
