"""Profiles of quads, ranks, equivalences, similarities, violations and crawl logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as t
from quadrille.operators import joins
from quadrille.session import written


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """(n, keys): how many keys have n rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


def predicate_stats(quads: DataFrame, key: str = "s", value: str = "o") -> DataFrame:
    """(p, occurrences, triples, average): groups (key, p) and distinct triples, with a row ALL."""
    groups = quads.select(key, "p", value).distinct().groupBy(key, "p").agg(F.count("*").alias("n"))
    by = groups.rollup("p").agg(F.count("*").alias("occurrences"), F.sum("n").alias("triples"))
    return by.where("occurrences > 0").select(F.coalesce("p", F.lit("ALL")).alias("p"), "occurrences", "triples", (F.col("triples") / F.col("occurrences")).alias("average"))


def adjusted_averages(stats: DataFrame) -> DataFrame:
    """(p, adjusted): averages drawn towards the overall one, the more so the rarer the predicate."""
    total = stats.where("p = 'ALL'").select(F.col("occurrences").alias("__o"), F.col("triples").alias("__t"))
    n = stats.agg(F.count("*").alias("__n"))
    rows = stats.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n))
    return rows.select("p", ((F.col("triples") + F.col("__t") / F.col("__n")) / (F.col("occurrences") + F.col("__o") / F.col("__n"))).alias("adjusted"))


def term_stats(quads: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Per term: triples as subject and as object (rdf:type objects don't count), documents, domains.

    Triples whose hash no other quad has are counted where they are read, with the documents of their terms; only the others are compared.
    """
    kept = (quads.where(~F.col("p").isin(*skip)) if skip else quads).select("s", "p", "o", "c", F.xxhash64("s", "p", "o").alias("node"))
    again = written(kept.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "hashes-again")
    rows = joins.marked(kept, again, ("node",))
    able = (F.col("p") != t.RDF_TYPE) & ~t.is_literal(F.col("o"))
    spots = F.posexplode(F.array("s", F.when(able, F.col("o")))).alias("side", "term")

    def sides(n) -> list:
        return [F.sum(F.when(F.col("side") == side, n).otherwise(0).cast("long")).alias(name) for side, name in ((0, "as_subject"), (1, "as_object"))]

    met = rows.select("c", (~F.col("__may")).cast("int").alias("n"), spots).where("term IS NOT NULL").groupBy("term", "c").agg(*sides(F.col("n")))
    # a level for each distinct count, in place of copies of every row for each of them; domains are dear, and taken of what hosts are left
    totals = [F.sum(x).alias(x) for x in ("as_subject", "as_object", "documents")]
    by_host = met.groupBy("term", t.authority(F.col("c")).alias("at")).agg(F.count("c").alias("documents"), *totals[:2])
    by_pld = by_host.groupBy("term", t.pay_level_domain(F.col("at")).alias("pld")).agg(*totals)
    compared = rows.where("__may").select("s", "p", "o").distinct().select(spots).where("term IS NOT NULL").groupBy("term").agg(*sides(F.lit(1)))
    every = by_pld.unionByName(compared.select("*", F.lit(None).cast("string").alias("pld"), F.lit(0).cast("long").alias("documents")))
    outside = F.coalesce(F.col("pld") != t.pay_level_domain(F.col("term")), F.lit(False)).cast("long")
    return every.groupBy("term").agg(*totals, F.count("pld").alias("plds"), F.sum(outside).alias("external_plds"))


def naming_stats(quads: DataFrame) -> DataFrame:
    """Per domain of the document, and ALL_PLDS: quads, subjects, subjects named by blanks, documents, predicates."""
    pld = t.pay_level_domain(F.col("at")).alias("pld")
    rows = quads.select(t.authority(F.col("c")).alias("at"), "s", "p", "c")
    # a distinct count at a time, each after its own grouping, in place of copies of every quad for each of them and for each level
    subjects = written(rows.groupBy("at", "s").agg(F.count("*").alias("n")).select(pld, "s", "n").groupBy("pld", "s").agg(F.sum("n").alias("n")), "naming-subjects")
    said = written(rows.select("at", "c", "p").distinct(), "naming-documents")
    documents, predicates = said.select("at", "c").distinct().groupBy("at").agg(F.count("c").alias("n")).select(pld, "n"), said.select("at", "p").distinct().select(pld, "p").distinct()

    def level(key) -> DataFrame:
        per = subjects.select(key, "s", "n").groupBy("pld", "s").agg(F.sum("n").alias("n")) if key is not own else subjects
        by = per.groupBy("pld").agg(F.sum("n").alias("quads"), F.count("s").alias("subjects"), F.count(F.when(t.is_blank(F.col("s")), 1)).alias("blank_subjects"))
        return by.join(documents.select(key, "n").groupBy("pld").agg(F.sum("n").alias("documents")), "pld").join(predicates.select(key, "p").groupBy("pld").agg(F.count_distinct("p").alias("predicates")), "pld")

    own = F.col("pld")
    return level(own).union(level(F.lit("ALL_PLDS").alias("pld")))


def dataset_profile(quads: DataFrame) -> DataFrame:
    """(measure, name, n): entities, triples, predicates, classes, kinds of objects, out-degrees."""
    triples = written(quads.select("s", "p", "o").distinct(), "profile-triples")
    kinds = (("class", F.when(F.col("p") == t.RDF_TYPE, F.col("o"))), ("predicate", F.col("p")), ("object_kind", t.kind(F.col("o"))))
    spots = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("name")) for m, v in kinds)))
    parts = written(triples.select(spots.alias("e")).where("e.name IS NOT NULL").groupBy("e.measure", "e.name").agg(F.count("*").alias("n")), "profile-parts")
    degrees = written(triples.groupBy("s").agg(F.count("*").alias("d")).groupBy(F.col("d").cast("string").alias("name")).agg(F.count("*").alias("n")), "profile-degrees")

    def total(measure: str, rows: DataFrame, n) -> DataFrame:
        return rows.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit(measure).alias("measure"), F.lit("").alias("name"), "n")

    predicates, classes = parts.where("measure = 'predicate'"), parts.where("measure = 'class'")
    out = total("entities", degrees, F.sum("n")).union(total("triples", predicates, F.sum("n"))).union(total("predicates", predicates, F.count("*"))).union(total("classes", classes, F.count("*")))
    spaces = predicates.groupBy(t.namespace(F.col("name")).alias("name")).agg(F.count("*").alias("n"))
    return out.union(parts).union(spaces.select(F.lit("namespace").alias("measure"), "name", "n")).union(degrees.select(F.lit("out_degree").alias("measure"), "name", "n"))


def void_lines(profile: DataFrame, dataset: str) -> DataFrame:
    """N-Triples lines of a VoID description of a dataset profile."""
    void = "http://rdfs.org/ns/void#"
    names = {"entities": "entities", "triples": "triples", "predicates": "properties", "classes": "classes"}
    value = F.concat(F.lit('"'), F.col("n"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer> .'))
    parts = [profile.where(F.col("measure") == m).select(F.concat(F.lit(f"<{dataset}> <{void}{v}> "), value).alias("line")) for m, v in names.items()]
    for m, link, names_it in (("class", "classPartition", "class"), ("predicate", "propertyPartition", "property")):
        rows = profile.where(F.col("measure") == m)
        node = F.concat(F.lit("_:"), F.md5("name"))
        both = F.array(F.concat(F.lit(f"<{dataset}> <{void}{link}> "), node, F.lit(" .")), F.concat(node, F.lit(f" <{void}{names_it}> "), F.col("name"), F.lit(" .")), F.concat(node, F.lit(f" <{void}{'entities' if m == 'class' else 'triples'}> "), value))
        parts.append(rows.select(F.explode(both).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def document_profile(quads: DataFrame) -> DataFrame:
    """(measure, name, documents): documents by domain, predicate and class."""
    said = quads.select("c", "p", F.when(F.col("p") == t.RDF_TYPE, F.col("o")).alias("class")).distinct()  # fewer than the quads, and all that is asked
    kinds = (("pld", t.pay_level_domain(F.col("c"))), ("predicate", F.col("p")), ("class", F.col("class")))
    spots = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("name")) for m, v in kinds))
    each = said.select("c", F.explode(spots).alias("e")).select("e.measure", "e.name", "c").where("name IS NOT NULL").distinct()
    return each.groupBy("measure", "name").agg(F.count("c").alias("documents"))


def ranked_vocabulary(quads: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per class, predicate and datatype: statements, documents, domains, sum and greatest of documents' ranks."""
    kinds = (("class", F.when(F.col("p") == t.RDF_TYPE, F.col("o"))), ("predicate", F.col("p")), ("datatype", F.when(t.is_literal(F.col("o")), t.datatype(F.col("o")))))
    spots = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in kinds))
    per_doc = quads.select("c", F.explode(spots).alias("e")).where("e.name IS NOT NULL").groupBy("e.kind", "e.name", "c").agg(F.count("*").alias("n"))
    r = ranks.select(F.col("node").alias("c"), "rank")
    rows = per_doc.join(r, "c", "left").withColumn("rank", F.coalesce("rank", F.lit(t.MIN_RANK))).withColumn("pld", t.pay_level_domain(F.col("c")))
    return rows.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.count("*").alias("documents"), F.count_distinct("pld").alias("plds"), F.sum("rank").alias("rank_sum"), F.max("rank").alias("rank_max"))


def language_stats(quads: DataFrame) -> DataFrame:
    """(measure, a, b, n): language tags, top-level domains by position, and language by document's domain.

    Quads are counted by their authorities and by what follows a literal's last quote; tags and domains are taken from those.
    """
    tail = F.substring_index(F.col("o"), '"', -1)
    tag = F.when(t.is_literal(F.col("o")), F.concat(F.lit('"'), F.when(tail.startswith("@"), tail).otherwise(""))).alias("tag")
    met = quads.select(*(t.authority(F.col(x)).alias(x) for x in "spoc"), tag, (F.col("p") == t.RDF_TYPE).alias("type")).groupBy(*"spoc", "tag", "type").agg(F.count("*").alias("n"))
    lang = F.when(F.col("tag").isNotNull(), t.language(F.col("tag")))
    spots = [("lang", lang, F.lit("")), *((f"tld_{x}", t.top_level_domain(F.col(x)), F.lit("")) for x in "spoc"), ("tld_type", F.when(F.col("type"), t.top_level_domain(F.col("o"))), F.lit("")), ("lang_tld", lang, t.top_level_domain(F.col("c")))]
    e = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), a.alias("a"), b.alias("b")) for m, a, b in spots)))
    return met.select(e.alias("e"), "n").where("e.a IS NOT NULL").groupBy("e.measure", "e.a", "e.b").agg(F.sum("n").alias("n"))


def rank_distribution(ranks: DataFrame) -> DataFrame:
    """(measure, bin, n, rank_sum, rank_max, node_max): one row for all ranks, and one for each power of ten that ranks lie under."""
    bins = F.explode(F.array(F.struct(F.lit("all").alias("measure"), F.lit(0).alias("bin")), F.struct(F.lit("log10").alias("measure"), F.when(F.col("rank") > 0, F.floor(F.log10("rank")).cast("int")).alias("bin"))))
    per = ranks.select(bins.alias("e"), "node", "rank").select("e.*", "node", "rank").groupBy("measure", "bin")
    return per.agg(F.count("*").alias("n"), F.sum("rank").alias("rank_sum"), F.max("rank").alias("rank_max"), F.min_by("node", F.struct(-F.col("rank"), "node")).alias("node_max"))


def duplicate_contexts(quads: DataFrame, inferred: str = "<urn:rule:") -> DataFrame:
    """(asserted, inferred, triples): how many triples have so many asserted and inferred contexts."""
    is_inf = F.col("c").startswith(inferred)
    per = quads.select("s", "p", "o", "c").distinct().groupBy("s", "p", "o").agg(F.sum((~is_inf).cast("long")).alias("asserted"), F.sum(is_inf.cast("long")).alias("inferred"))
    return per.groupBy("asserted", "inferred").agg(F.count("*").alias("triples"))


def class_stats(members: DataFrame) -> DataFrame:
    """(measure, n, classes): sizes of equivalence classes and their numbers of domains; members is (node, component)."""
    per = members.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct(t.pay_level_domain(F.col("node"))).alias("plds"))
    e = F.explode(F.array(F.struct(F.lit("size").alias("measure"), F.col("size").alias("n")), F.struct(F.lit("plds").alias("measure"), F.col("plds").alias("n"))))
    return per.select(e.alias("e")).groupBy("e.measure", "e.n").agg(F.count("*").alias("classes"))


def similarity_stats(scores: DataFrame) -> DataFrame:
    """(kind, pairs, score_sum): pairs within a domain, across domains, and with no domain."""
    a, b = t.pay_level_domain(F.col("a")), t.pay_level_domain(F.col("b"))
    k = F.when((a == "no_pld") | (b == "no_pld"), "none").when(a == b, "intra").otherwise("inter")
    hosts = scores.groupBy(t.authority(F.col("a")).alias("a"), t.authority(F.col("b")).alias("b")).agg(F.count("*").alias("pairs"), F.sum("score").alias("score_sum"))
    return hosts.groupBy(k.alias("kind")).agg(F.sum("pairs").alias("pairs"), F.sum("score_sum").alias("score_sum"))


def crawl_log(events: DataFrame) -> DataFrame:
    """Per hour: responses, domains, domains not seen in an earlier hour, successes; events is (ts, pld, status)."""
    hour = F.date_trunc("hour", "ts")
    first = F.min(hour).over(Window.partitionBy("pld"))
    rows = events.withColumn("hour", hour).withColumn("first", first)
    return rows.groupBy("hour").agg(F.count("*").alias("responses"), F.count_distinct("pld").alias("plds"), F.count_distinct(F.when(F.col("first") == F.col("hour"), F.col("pld"))).alias("new_plds"), F.sum((F.col("status") == 200).cast("long")).alias("successes"))


def log_sessions(events: DataFrame, gap: int = 3600) -> DataFrame:
    """(pld, session, first, last, n): runs of a domain's events without a gap of more than `gap` seconds."""
    w = Window.partitionBy("pld").orderBy("ts", "id")
    far = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap * 1_000_000).cast("int"), F.lit(0))
    rows = events.withColumn("far", far).withColumn("session", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.groupBy("pld", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


def status_counts(responses: DataFrame) -> DataFrame:
    """Per domain, useful and useless responses; redirects count as neither, robots.txt isn't counted."""
    useful = (F.col("status") == 200) & (F.col("content") == "application/rdf+xml")
    moved = F.col("status").isin(301, 302, 303)
    rows = responses.where(~F.col("url").endswith("/robots.txt"))
    return rows.groupBy("pld").agg(F.sum(useful.cast("long")).alias("useful"), F.sum((~useful & ~moved).cast("long")).alias("useless"))


def domain_scores(counts: DataFrame) -> DataFrame:
    """(pld, score): smoothed share of useful responses."""
    return counts.select("pld", ((F.col("useful") + 10) / (F.col("useful") + F.col("useless") + 10)).alias("score"))
