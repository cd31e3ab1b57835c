"""Operators on small tables whose results were worked out by hand."""

from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import conflicts, entities, joins, rank, reason, search, sets, stats
from quadrille.operators.graph import components
from quadrille.session import bucketed
from quadrille.sources import quads as src

RANKED = "s string, p string, o string, c string, rank double"
QUADS = "s string, p string, o string, c string"


def _bnodes(spark, text):
    rows = [line.split() for line in text.strip().splitlines()]
    return spark.createDataFrame([(*(f"_:{x}" for x in r[:4]), float(r[4])) for r in rows], RANKED)


SUMS = """a b c x1 0.1
a b c x2 0.1
a b c x3 0.2
a b c x4 0.3
c d e x1 0.4
c d f x1 0.5
c d g x1 0.2
c d g x2 0.2
h k m x1 0.3
h k m x2 0.2"""


def test_rank_sums_reach_every_row_of_a_triple(spark):
    got = sorted((r.s[2:] + r.p[2:] + r.o[2:], r.c, round(r["rank"], 6)) for r in rank.sum_ranks(_bnodes(spark, SUMS)).collect())
    total = {"abc": 0.7, "cde": 0.4, "cdf": 0.5, "cdg": 0.4, "hkm": 0.5}
    assert len(got) == 10 and all(v == total[k] for k, _, v in got)


def test_greatest_rank_of_each_triple(spark):
    got = {r.s[2:] + r.p[2:] + r.o[2:]: r["rank"] for r in rank.max_ranks(_bnodes(spark, SUMS)).collect()}
    assert got == {"abc": 0.3, "cde": 0.4, "cdf": 0.5, "cdg": 0.2, "hkm": 0.3}


def _iri(name):
    head, _, frag = name.partition("#")
    return f"<http://{head}.net/{'#' + frag if frag else ''}>"


def test_links_of_documents_with_and_without_schema(spark):
    rows = [
        (_iri("a"), _iri("p"), _iri("c"), _iri("d1")), (_iri("d1"), _iri("p"), _iri("d1"), _iri("d1")),
        (_iri("b"), t.RDF_TYPE, _iri("c"), _iri("d2")), (_iri("c"), _iri("p"), "_:x", _iri("d3")),
        (_iri("g"), _iri("q"), '"text"', _iri("d3")), (_iri("h#f"), _iri("r#f"), _iri("m"), _iri("d4")),
        ("_:y", _iri("u"), "_:z", _iri("d4")),
    ]
    quads = spark.createDataFrame(rows, QUADS)
    plain = {tuple(r) for r in rank.extract_links(quads).collect()}
    assert plain == {(_iri(a), _iri(b)) for a, b in [("d1", "a"), ("d1", "c"), ("d2", "b"), ("d3", "c"), ("d3", "g"), ("d4", "h"), ("d4", "m")]}
    more = {tuple(r) for r in rank.extract_links(quads, schema_too=True).collect()} - plain
    assert more == {(_iri(a), _iri(b)) for a, b in [("d1", "p"), ("d2", "c"), ("d3", "p"), ("d3", "q"), ("d4", "r"), ("d4", "u")]} | {(_iri("d2"), "<http://www.w3.org/1999/02/22-rdf-syntax-ns>")}


def test_inferred_duplicates_give_way_to_asserted_quads(spark):
    text = "abc:1,2,Ra,Rb,8,9 ade:1,Rd adf:Re adg:Rf,Rg hij:Rh,9 hkl:1 hkm:Rg"
    rows = [(*(f"_:{x}" for x in spo), f"<urn:rule:{c[1:]}>" if c[0] == "R" else f"<http://{c}>") for spo, cs in (x.split(":") for x in text.split()) for c in cs.split(",")]
    got = {(r.s[2:] + r.p[2:] + r.o[2:], r.c) for r in sets.drop_inferred_duplicates(spark.createDataFrame(rows, QUADS)).collect()}
    assert len(rows) == 15 and len(got) == 10
    assert {c for k, c in got if k == "abc"} == {"<http://1>", "<http://2>", "<http://8>", "<http://9>"}
    assert ("adg", "<urn:rule:f>") in got and ("adf", "<urn:rule:e>") in got and ("hij", "<http://9>") in got


def test_authoritative_literal_is_picked(spark):
    rows = spark.createDataFrame([("s", '"depiction"', True), ("s", '"Bild"', False), ("u", '""', True), ("u", '"x"@fr', False)], "s string, literal string, auth boolean")
    assert {r.s: r.literal for r in search.pick_literal(rows, "en").collect()} == {"s": '"depiction"', "u": '"x"@fr'}


def test_cardinality_one_merges_values_in_two_rounds(spark):
    text = "a p1 s1|a p1 s2|a pa t1|a pa t2|a pa t3|a T ca1|s1 p1 u1|s2 p1 u2|s1 pa v1|s2 pa v2|s1 pa v3|s1 T ca2"
    rows = [(f"_:{s}", t.RDF_TYPE if p == "T" else f"<{p}>", f"<{o}>" if o[:2] == "ca" else f"_:{o}", "_:x") for s, p, o in (x.split() for x in text.split("|"))]
    limits = spark.createDataFrame([(f"<{c}>", f"<{p}>") for c in ("ca1", "ca2") for p in ("p1", "pa")], "cls string, p string")
    got = {(r.pivot[2:], r.node[2:]) for r in entities.fixpoint(spark.createDataFrame(rows, QUADS), [], [], limits).collect() if r.node != r.pivot}
    assert got == {("s1", "s2"), ("t1", "t2"), ("t1", "t3"), ("u1", "u2"), ("v1", "v2"), ("v1", "v3")}


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_page_rank_keeps_its_mass(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r["rank"] for r in rank.page_rank(links, nodes).collect()}
    assert abs(sum(got.values()) - 1) < 1e-12 and min(got, key=got.get) == "e"


def test_terms(spark):
    row = spark.createDataFrame([("<http://a.b.co.uk:80/x#y>", '"a\\"b"@en', '"1"^^<http://int>', "_:z", "<http://EX.org/d/>")], "i string, l string, d string, b string, j string")
    got = row.select(t.pay_level_domain(F.col("i")), t.strip_fragment(F.col("i")), t.lexical(F.col("l")), t.language(F.col("l")), t.datatype(F.col("d")), t.pay_level_domain(F.col("b")), t.host(F.col("j")), t.top_level_domain(F.col("b")), t.namespace(F.col("i"))).first()
    assert tuple(got) == ("b.co.uk", "<http://a.b.co.uk:80/x>", 'a"b', "en", "http://int", "no_pld", "ex.org", "bnode", "http://a.b.co.uk:80/x#")


def test_nquads_survive_a_round_trip_and_bad_lines_are_left_out(spark, tmp_path):
    rows = [("<http://a>", "<http://p>", '"x \\"y\\" ."@en', "<http://c>"), ("_:b", "<http://p>", '"1"^^<http://i>', "<http://c>")]
    src.write_nquads(spark.createDataFrame(rows, QUADS), f"file://{tmp_path}/q")
    assert sorted(map(tuple, src.read_nquads(spark, f"file://{tmp_path}/q").collect())) == sorted(rows)
    (tmp_path / "bad.nq").write_text("# note\n<http://a> <http://p> .\n")
    assert src.read_nquads(spark, f"file://{tmp_path}/bad.nq").count() == 0


def test_contradicting_members_part():
    ids = ["a", "b", "c", "d"]
    got = conflicts.partition_class(ids, {("a", "c"), ("b", "c")}, [("a", "b", 2.0, 0.0), ("b", "c", 1.0, 0.0), ("c", "d", 1.0, 0.0), ("a", "d", 0.5, 0.0)])
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_similarity_scores_by_hand(spark):
    """Both ways: of a shared value the greatest confidence counts, noisy-or within predicate and way, by 1 / mean, then across."""
    from quadrille.operators import entities

    rows = [("<a>", "<p>", "<v>"), ("<b>", "<p>", "<v>"), ("<a>", "<p>", "<w>"), ("<b>", "<p>", "<w>"), ("<c>", "<p>", "<w>"), ("<a>", "<q>", '"x"'), ("<b>", "<q>", '"x"'), ("<v>", "<r>", "<a>"), ("<v>", "<r>", "<b>"), ("<v>", "<r>", '"y"')]
    quads = spark.createDataFrame([(*r, "<doc>") for r in rows], "s string, p string, o string, c string")

    def stats(way):
        groups = {}
        for s, p, o in rows:
            groups.setdefault((p, s if way == "s" else o), set()).add(o if way == "s" else s)
        by = {}
        for (p, _), g in groups.items():
            by.setdefault(p, []).append(len(g))
        n, occ, tri = len(by) + 1, sum(map(len, by.values())), sum(map(sum, by.values()))
        return groups, {p: ((sum(g) + tri / n) / (len(g) + occ / n), sum(g) / len(g)) for p, g in by.items()}

    best = {}
    for way in "so":
        groups, means = stats(way)
        for (p, shared), g in groups.items():
            able = sorted(x for x in g if not x.startswith('"'))
            for i, a in enumerate(able):
                for b in able[i + 1 :]:
                    best.setdefault((a, b), {}).setdefault(shared, []).append((-1 / (means[p][0] * len(g)), p, way, means[p][1]))
    want = {}
    for pair, values in best.items():
        within = {}
        for c, p, way, mean in map(min, values.values()):
            within.setdefault((p, way, mean), []).append(-c)
        left = 1.0
        for (_, _, mean), confidences in within.items():
            miss = 1.0
            for c in confidences:
                miss *= 1 - c
            left *= 1 - (1 - miss) / mean
        want[pair] = 1 - left
    got = {(r.a, r.b): r.score for r in entities.aggregate_similarity(entities.concurrence(quads, entities.averages(quads))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_repair_rescues_what_other_premises_derive(spark):
    ranked = spark.createDataFrame([("a", "p", "x", 0.5), ("b", "p", "x", 0.4), ("c", "p", "x", 0.9)], "s string, p string, o string, rank double")
    inferred = spark.createDataFrame([("t", "q", "y", 0.5, "a", "p", "x"), ("t", "q", "y", 0.4, "b", "p", "x"), ("u", "q", "y", 0.5, "a", "p", "x"), ("c", "p", "x", 0.2, "b", "p", "x")], "s string, p string, o string, rank double, s0 string, p0 string, o0 string")
    gone = spark.createDataFrame([("a", "p", "x")], "s string, p string, o string")
    got = sorted(tuple(r) for r in conflicts.repair(ranked, inferred, gone).collect())
    assert got == [("b", "p", "x", 0.4, "asserted"), ("c", "p", "x", 0.9, "asserted"), ("t", "q", "y", 0.4, "inferred")]


def test_collections_and_ranked_templates(spark):
    from quadrille.operators import reason

    first, rest, inter, sub = reason.FIRST, reason.REST, reason.OF_LISTS[0], f"<{reason.RDFS}subClassOf>"
    schema = spark.createDataFrame([("<A>", inter, "<l1>", 0.5), ("<l1>", first, "<B>", 1.0), ("<l1>", rest, "<l2>", 1.0), ("<l2>", first, "<C>", 1.0), ("<l2>", rest, "<nil>", 1.0), ("<C>", sub, "<D>", 0.3), ("<A>", sub, "<E>", 0.2), ("<E>", sub, "<D>", 0.9)], "s string, p string, o string, rank double")
    assert sorted(tuple(r) for r in reason.list_members(schema).collect() if r.head == "<l1>") == [("<l1>", "<B>"), ("<l1>", "<C>")]
    got = {(r.n1, r.n2): r["rank"] for r in reason.templates(schema, rank=True).collect()}
    assert got == {("<A>", "<B>"): 0.5, ("<A>", "<C>"): 0.5, ("<C>", "<D>"): 0.3, ("<A>", "<E>"): 0.2, ("<E>", "<D>"): 0.9, ("<A>", "<D>"): 0.3}


def test_components_with_a_hub(spark):
    from quadrille.operators.graph import components

    edges = [(0, k) for k in range(1, 200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(200)}, **{1000 + k: 1000 for k in range(41)}}


def test_places_in_an_order(spark):
    rows = [(k % 3, k, "x" * (k % 5)) for k in range(60)] + [(1, 7, "y")] * 3
    got = sorted((r.pos, r.a, r.b, r.c) for r in sets.numbered(spark.createDataFrame(rows, "a int, b int, c string").repartition(4), ["a"]).collect())
    assert [p for p, *_ in got] == list(range(1, 64)) and [a for _, a, *_ in got] == sorted(r[0] for r in rows)


def test_similarity_of_lists_is_that_of_all_evidence(spark):
    """Members that pair in several lists of a value count by the best; a pair's evidence moves with the lists, not as rows of its own."""
    import random

    draw = random.Random(3)
    names = [f"<n{k}>" for k in range(25)] + ['"x"', '"y"']
    rows = [(f"<n{draw.randrange(25)}>", f"<p{draw.randrange(4)}>", draw.choice(names), f"<d{k % 2}>") for k in range(400)]
    quads = spark.createDataFrame(rows + [(f"<m{k}>", "<p0>", "<n3>", "<d>") for k in range(60)], QUADS)
    lists, kinds = entities.sharing(quads)
    means = entities.list_averages(lists, kinds)
    assert lists.where("clash").count() and all(len(x.xs) <= entities.LIMIT for r in lists.collect() for x in r.lists)
    want = {(r.a, r.b): r.score for r in entities.aggregate_similarity(entities.evidence(lists, means)).collect()}
    scores = entities.similarity(lists, means)
    got = {(r.a, r.b): r.score for r in scores.collect()}
    assert got.keys() == want.keys() and len(want) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = scores.limit(3)
    assert entities.evidence(lists, means, top).count() == entities.evidence(lists, means).join(top, ["a", "b"], "left_semi").count() > 2


AWKWARD = ["<http://a.b.org/x#y>", "<http://h.org#me>", "<http://h.org>", "<https://u:p@H.co.uk:80/x>", "<http://u#x@h.org/>", "<http:///p>", "<http://a.org?q=/b>", "<mailto:x@y.org>", "<urn:a://b.org/c>", "<a/b://c.org/d>", "<>", "<#a>", "<http#x://y.org/z>", "_:b/c/d/e", "_:x://y.org/z", '"see http://x.org/y/z"@en', '"x', '"a"@de-CH', '"@en', "http://x.org/y", "<ftp://F.net/a>", "<http://x.com/a://b>"]


def test_authorities_tell_hosts_and_domains(spark):
    rows = spark.createDataFrame([(x,) for x in AWKWARD], "x string")
    x, pattern = F.col("x"), r"^<?[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@>]*@)?([^/:?#>]+)"
    for a, term in ((t.authority(x), x), (t.document_authority(x), F.when(t.is_iri(x), F.regexp_replace(x, r"#[^>]*>$", ">")).otherwise(x))):
        for r in rows.select("x", *(f(y) for f in (t.host, t.pay_level_domain, t.top_level_domain, t.kind) for y in (a, term)), F.lower(F.regexp_extract(term, pattern, 1))).collect():
            assert r[1] == r[2] == r[9] and r[3] == r[4] and r[5] == r[6] and r[7] == r[8], r


def test_domains_and_tags_of_awkward_terms(spark):
    """Counted by authorities, as they would be term by term; a term's path is never a key of its own."""
    from quadrille.operators import stats

    rows = [(a, p, b, c) for k, a in enumerate(AWKWARD) for b, c in ((AWKWARD[k - 3], AWKWARD[k - 5]), (AWKWARD[k - 7], "<http://d.org/x>")) for p in ("<http://p.org/p>", t.RDF_TYPE)]
    quads = spark.createDataFrame(rows, QUADS)
    raw = rank.extract_links(quads)
    want = {tuple(r) for r in raw.select(t.pay_level_domain(F.col("src")), t.pay_level_domain(F.col("dst"))).collect() if r[0] != r[1]}
    links = rank.domain_links(quads)
    assert {tuple(r) for r in links.collect()} == want
    o, lit = F.col("o"), t.is_literal(F.col("o"))
    got = {(r.measure, r.a, r.b): r.n for r in stats.language_stats(quads).collect()}
    for measure, a, b in (("lang", F.when(lit, t.language(o)), F.lit("")), ("lang_tld", F.when(lit, t.language(o)), t.top_level_domain(F.col("c"))), ("tld_o", t.top_level_domain(o), F.lit("")), ("tld_type", F.when(F.col("p") == t.RDF_TYPE, t.top_level_domain(o)), F.lit(""))):
        one = {(measure, r.a, r.b): r.n for r in quads.select(a.alias("a"), b.alias("b")).where("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
        assert one == {k: n for k, n in got.items() if k[0] == measure}
    names = {r.pld: tuple(r)[1:] for r in stats.naming_stats(quads).collect()}
    assert names["ALL_PLDS"] == (len(rows), len({r[0] for r in rows}), len({r[0] for r in rows if r[0].startswith("_:")}), len({r[3] for r in rows}), 2)
    d_org = [r for r in rows if r[3] == "<http://d.org/x>"]
    assert names["d.org"] == (len(d_org), len({r[0] for r in d_org}), len({r[0] for r in d_org if r[0].startswith("_:")}), 1, 2)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[plan.rindex("Aggregate") :]  # no domain is taken before quads are reduced


def test_only_quads_that_a_class_touches_are_joined(spark):
    from quadrille.operators import joins

    rows = [(f"<n{k % 40}>", ("<p>", t.RDF_TYPE, t.SAME_AS)[k % 3], f"<n{k * 7 % 50}>" if k % 5 else '"x"', f"<d{k % 4}>") for k in range(300)] + [(f"<far{k}>", "<p>", f"<off{k}>", "<d>") for k in range(200)] + [("<n1>", "<p>", None, "<d>")]
    quads = spark.createDataFrame(rows, QUADS)
    pivots = spark.createDataFrame([(f"<n{k}>", f"<n{k - k % 4}>") for k in range(20)], "node string, pivot string")
    asked, rest = joins.among(quads, pivots)
    far = {r.s for r in rest.collect()}
    assert asked.count() + rest.count() == len(rows) and sum(x.startswith("<far") for x in far) > 190 and not far & {f"<n{k}>" for k in range(20)}
    for mode in ("rewrite", "filter", "buffer"):
        want = joins.rewrite(joins.rewrite(quads, pivots, "s", mode, "s_orig"), pivots, "o", mode, "o_orig")
        got = entities.consolidate(quads, pivots, aliases=True, mode=mode)
        assert sorted(map(tuple, want.collect()), key=repr) == sorted(map(tuple, got.select(want.columns).collect()), key=repr)


def test_violations_need_only_statements_that_rules_read(spark):
    from quadrille.plans import entity_queries as q

    data = "/root/testdata/sf0.001"
    few, every = q._contradictable(spark, data), q._consolidated(spark, data)
    assert 0 < few.count() * 3 < every.count()
    found = [sorted(map(tuple, q._flat(q._violations(spark, data, x)).collect())) for x in (few, every)]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 12


def test_rows_out_of_order_are_counted_where_they_are(spark):
    rows = [("a", "b"), ("a", "a"), (None, "z"), ("a", None), ("b", "a"), ("b", "a"), ("a", "c")]
    one = spark.createDataFrame(rows * 40, "x string, y string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = sets.unsorted_rows(one, ("x", "y"))
        assert found.first()[0] == 4 * 40 - 1 and sets.unsorted_rows(one.sortWithinPartitions("x", "y"), ("x", "y")).first()[0] == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Exchange" not in found._jdf.queryExecution().sparkPlan().toString()


def test_links_to_documents_pass_over_quads_that_name_none(spark):
    rows = [
        ("<http://x/1>", "<http://p>", "<http://d/1#f>", "<http://d/2>"), ("<http://d/2>", t.RDF_TYPE, "<http://d/1>", "<http://d/1#g>"), ("<http://d/9#h>", "<http://p>", '"text"', "<http://d/2>"),
        (None, "<http://p>", "<http://d/1>", "<http://d/4>"), ("<http://x/1>", None, "<http://d/2>", "<http://d/4>"), ("<http://d/1>", "<http://p>", None, None), *((f"<http://x/{i}>", "<http://p>", f"<http://y/{i}>", "<http://d/1>") for i in range(2000)),
    ]
    quads = spark.createDataFrame(rows, QUADS)
    documents, redirects = quads.select("c").distinct(), spark.createDataFrame([("<http://d/9>", "<http://d/1>"), ("<http://d/8>", "<http://d/2>")], "src string, dst string")
    few, every = rank.extract_links(quads, ends=documents.select(F.col("c").alias("node")).union(redirects.select("src"))), rank.extract_links(quads)
    assert few.count() * 3 < every.count() and few.exceptAll(every).isEmpty()
    found = [sorted(map(tuple, x.collect())) for x in (rank.document_links(quads, documents, redirects), joins.within(joins.redirect(every, redirects), documents))]
    assert found[0] == found[1] == [("<http://d/1>", "<http://d/2>"), ("<http://d/2>", "<http://d/1>"), ("<http://d/4>", "<http://d/1>")]


def test_few_links_make_few_buckets(spark):
    table, name = bucketed(spark.range(1000).select(F.col("id").alias("src")), "buckets", "src", 1)
    assert table.rdd.getNumPartitions() == 1 and table.count() == 1000
    spark.sql(f"DROP TABLE {name}")


def test_terms_are_profiled_alike_whether_triples_come_again_or_not(spark):
    s, o = [f"<http://a{i}.x.co.uk/1>" for i in range(3)], [f"<http://b.y.org/{i}>" for i in range(3)]
    rows = [(s[i % 3], f"<p{i % 2}>", o[i % 2], f"<http://d{i % 4}.x.co.uk/{i % 5}>") for i in range(60)] + [(s[0], t.RDF_TYPE, o[2], o[0]), (s[1], "<q>", '"l"', s[1]), (s[1], "<q>", '"m"', s[1]), (o[1], "<q>", s[2], None), ("_:b", "<q>", "_:b", "<urn:d>")]
    rows += [(f"<http://one/{i}>", "<q>", f"<http://two/{i}>", "<http://z.example.org/d>") for i in range(50)]
    want = {}
    for term in {r[k] for r in rows for k in (0, 2)}:
        as_s, as_o = [r for r in rows if r[0] == term], [r for r in rows if r[2] == term and r[1] != t.RDF_TYPE and term[0] != '"']
        if as_s or as_o:
            docs = {r[3] for r in as_s + as_o if r[3]}

            def pld(x):
                host = x.split("/")[2] if "//" in x else ""
                return ".".join(host.rstrip(">").split(".")[-3 if ".co.uk" in host else -2 :]) if host else "no_pld"

            plds = {pld(x) for x in docs}
            want[term] = (len({r[:3] for r in as_s}), len({r[:3] for r in as_o}), len(docs), len(plds), len(plds - {pld(term)}))
    quads = spark.createDataFrame(rows, QUADS)
    columns = ("as_subject", "as_object", "documents", "plds", "external_plds")
    for data in (quads, quads.repartition(7)):
        assert {r.term: tuple(r[c] for c in columns) for r in stats.term_stats(data).collect()} == want
    assert stats.term_stats(quads.limit(0)).count() == 0


def test_values_of_subjects_move_once_with_their_fields(spark):
    name, comment, date = "<urn:name>", search.COMMENTS[0], '"2001-01-01"^^<http://www.w3.org/2001/XMLSchema#date>'
    rows = [
        ("<http://h/x>", name, '"b"', "<http://h/x#f>"), ("<http://h/x>", name, '"b"', "<urn:d>"), ("<http://h/x>", name, '"a"', "<urn:d>"), ("<http://h/x>", name, date, "<urn:d>"), ("<http://h/x>", comment, '"c"', "<urn:d>"), ("<http://h/x>", "<urn:p>", '"t"', "<urn:d>"),
        ("<http://h/x>", "<urn:p>", date, "<urn:d>"), ("<http://h/x>", t.RDF_TYPE, "<urn:C>", "<http://h/x>"), ("<http://h/x>", t.RDF_TYPE, '"lit"', "<urn:d>"), ("<http://h/x>", t.SAME_AS, "<urn:y>", "<urn:d>"), ("<http://h/x>", "<urn:p>", "<http://h/i.JPEG>", "<urn:d>"), ("<http://h/x>", "<urn:p>", "<http://h/i.png.txt>", "<urn:d>"),
        ("<http://h/x>", search.LAT, '"2"', "<urn:d>"), ("<http://h/x>", search.LAT, '"1"', "<urn:d>"), ("<http://h/x>", "<urn:p>", None, "<urn:d>"), ("<urn:same>", t.SAME_AS, "<urn:y>", "<urn:d>"), ("<urn:bare>", "<urn:p>", "<urn:z>", None), ("<urn:long>", name, '"' + "x" * search.MAX_LITERAL + '"', "<urn:d>"),
    ]
    ranks = spark.createDataFrame([("<http://h/x>", 0.5)], "node string, rank double")
    found = search.subject_documents(spark.createDataFrame(rows, QUADS), (name,), ranks)
    got = {r.s: r.asDict() for r in found.collect()}
    assert sorted(got) == ["<http://h/x>", "<urn:bare>", "<urn:long>"] and sorted(r.s for r in search.described(spark.createDataFrame(rows, QUADS)).collect()) == sorted(got)
    want = {"labels": [date, '"a"', '"b"'], "comments": ['"c"'], "dates": [date], "types": ['"lit"', "<urn:C>"], "auth_labels": ['"b"'], "auth_comments": [], "auth_dates": [], "auth_types": ["<urn:C>"], "texts": ['"lit"', '"t"'], "same_as": ["<urn:y>"], "images": ["<http://h/i.JPEG>"], "lat": '"1"', "long": None, "host": "h", "keywords": ["x"], "rank": 0.5}
    assert {k: sorted(v) if isinstance(v, list) else v for k, v in got["<http://h/x>"].items() if k != "s"} == {k: sorted(v) if isinstance(v, list) else v for k, v in want.items()}
    assert all(list(v) == sorted(v) for r in got.values() for v in r.values() if isinstance(v, list))
    assert not any(v for r in ("<urn:bare>", "<urn:long>") for k, v in got[r].items() if k not in ("s", "host", "keywords", "rank"))
    assert "collect_set" not in found._jdf.queryExecution().sparkPlan().toString()


def test_triples_that_no_template_leads_to_are_not_regrouped(spark):
    rows = [("a", "p", "b", 0.5), ("a", "q", "b", 0.2), ("b", "q", "a", 0.9), ("a", "r", "b", 0.4), (None, "r", "b", 0.1), ("a", None, "b", 0.3), ("a", t.RDF_TYPE, "C", 0.1), ("b", t.RDF_TYPE, "D", 0.7), ("a", "p", '"l"', 0.6), ("a", "is", "E", 0.8)]
    closed = spark.createDataFrame([("p", "p", "p", "q", 0), ("p", "p", "t", "C", 1), ("t", "C", "t", "D", 0), ("p", "is", "p", t.RDF_TYPE, 0)], "k1 string, n1 string, k2 string, n2 string, turn int")
    ranked = spark.createDataFrame(rows, "s string, p string, o string, rank double")
    few, every = reason.infer_ranked(ranked, closed, unique=True), reason.infer_ranked(ranked, closed)
    found = [sorted(map(tuple, x.collect()), key=repr) for x in (few, every)]
    assert found[0] == found[1] and {("a", "q", "b", 0.5), ("b", t.RDF_TYPE, "C", 0.5), ("a", t.RDF_TYPE, "D", 0.1), ("a", t.RDF_TYPE, "E", 0.8), ("a", None, "b", 0.3)} <= set(found[0])
