"""Keyword search over subjects, entity and focus look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as t

LABEL_BOOST, MAX_LITERAL = 10.0, 100_000
STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def postings(texts: DataFrame, stop: tuple[str, ...] = STOP) -> DataFrame:
    """(term, doc, field, tf) of texts (doc, field, text); literals of MAX_LITERAL characters or more are left out."""
    rows = texts.where(F.length("text") < MAX_LITERAL).select("doc", "field", F.explode(t.words(F.col("text"))).alias("term"))
    return rows.where(~F.col("term").isin(*stop)).groupBy("term", "doc", "field").agg(F.count("*").alias("tf"))


def search(index: DataFrame, n_docs: int, keywords: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """(doc, score) of documents that hold every keyword in some field.

    Score: sum over keywords and fields of sqrt(tf) * idf**2 * boost, idf = 1 + ln(N / (df + 1)), times the document's rank.
    """
    wanted = sorted(set(keywords))
    hits = index.where(F.col("term").isin(*wanted))
    df = hits.select("term", "doc").distinct().groupBy("term").agg(F.count("*").alias("df"))
    boost = F.when(F.col("field") == "label", LABEL_BOOST).otherwise(1.0)
    idf = 1 + F.log(F.lit(float(n_docs)) / (F.col("df") + 1))
    scored = hits.join(F.broadcast(df), "term").groupBy("doc").agg(F.count_distinct("term").alias("found"), F.sum(F.sqrt("tf") * idf * idf * boost).alias("score")).where(F.col("found") == len(wanted)).select("doc", "score")
    if ranks is None:
        return scored
    return scored.join(ranks.withColumnRenamed("node", "doc"), "doc", "left").select("doc", (F.col("score") * F.coalesce("rank", F.lit(t.MIN_RANK))).alias("score"))


def pick_literal(literals: DataFrame, preferred: str, key: str = "s") -> DataFrame:
    """(key, literal): of (key, literal, auth): not empty, of the preferred language, authoritative, short, then smallest."""
    lex, lang = t.lexical(F.col("literal")), t.language(F.col("literal"))
    match = (lang == "no_lang") | F.lit(preferred).startswith(lang)
    w = Window.partitionBy(key).orderBy(F.desc((F.length(lex) > 0).cast("int")), F.desc(match.cast("int")), F.desc(F.col("auth").cast("int")), F.length(lex), "literal")
    return literals.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, "literal")


COMMENTS = ("<http://www.w3.org/2000/01/rdf-schema#comment>",)
LAT, LONG = (f"<http://www.w3.org/2003/01/geo/wgs84_pos#{x}>" for x in ("lat", "long"))
DATE_TYPES = ("http://www.w3.org/2001/XMLSchema#date", "http://www.w3.org/2001/XMLSchema#dateTime")


def described(quads: DataFrame) -> DataFrame:
    """(s) of the subjects that have documents: those with more than sameAs statements."""
    return quads.groupBy("s").agg(F.max((F.col("p") != t.SAME_AS).cast("int")).alias("__more")).where("__more = 1").select("s")


def subject_documents(quads: DataFrame, label: tuple[str, ...], ranks: DataFrame | None = None) -> DataFrame:
    """One row for each subject: labels, comments, dates and types (each also as far as the subject's own document states them), other literals,
    sameAs, images, latitude, longitude (the smallest of several), keywords from its IRI, and its rank, which boosts the document.

    Subjects with sameAs statements only have none. Literals of MAX_LITERAL characters or more are left out. ranks is (node, rank).
    Each value moves once, with the fields that it is of as bits; statements that are of none count for their subject where they are read.
    """
    p, o, own = F.col("p"), F.col("o"), t.strip_fragment(F.col("s")) == t.strip_fragment(F.col("c"))
    lit = t.is_literal(o) & (F.length("o") < MAX_LITERAL)
    fields = {"labels": lit & p.isin(*label), "comments": lit & p.isin(*COMMENTS), "dates": lit & t.datatype(o).isin(*DATE_TYPES), "types": p == t.RDF_TYPE}
    fields |= {f"auth_{name}": test & own for name, test in fields.items()}
    fields |= {"texts": lit & ~p.isin(*label, *COMMENTS, LAT, LONG) & ~t.datatype(o).isin(*DATE_TYPES), "same_as": p == t.SAME_AS, "images": t.is_iri(o) & t.is_image(o), "lat": lit & (p == LAT), "long": lit & (p == LONG)}
    bits = {name: 1 << i for i, name in enumerate(fields)}
    mask, more = F.lit(0), 1 << len(bits)
    for name, test in fields.items():
        mask = mask + F.when(test, bits[name]).otherwise(0)
    able = o.isNotNull() & ((p == t.RDF_TYPE) | (p == t.SAME_AS) | t.is_literal(o) | (t.is_iri(o) & t.is_image(o)))
    rows = quads.select("s", F.when(able, o).alias("o"), (F.when(able, mask).otherwise(0) + F.when(p != t.SAME_AS, more).otherwise(0)).alias("of"))
    each = rows.groupBy("s", "o").agg(F.bit_or("of").alias("of"))
    rows = each.groupBy("s").agg(F.array_sort(F.collect_list(F.when(F.col("o").isNotNull(), F.struct("o", "of")))).alias("values"), F.bit_or("of").alias("of")).where(F.col("of").bitwiseAND(more) != 0)

    def values(name):
        found = F.transform(F.filter("values", lambda v: v["of"].bitwiseAND(bits[name]) != 0), lambda v: v["o"])
        return F.when(F.col("of").bitwiseAND(bits[name]) == 0, F.array().cast("array<string>")).otherwise(found)  # most subjects have few of the fields

    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("s", r"^<[^:]*:/*[^/]*", "")), F.lit("([a-z0-9]+)"), 1)))
    rows = rows.select("s", *((F.get(values(name), F.lit(0)) if name in ("lat", "long") else values(name)).alias(name) for name in fields), t.host(F.col("s")).alias("host"), words.alias("keywords"))
    if ranks is None:
        return rows.withColumn("rank", F.lit(t.MIN_RANK))
    return rows.join(ranks.select(F.col("node").alias("s"), "rank"), "s", "left").withColumn("rank", F.coalesce("rank", F.lit(t.MIN_RANK)))


def snippets(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """(s, p, o) rows that describe each hit (doc, score): its rank, types and labels."""
    rows = hits.join(documents, hits["doc"] == documents["s"])
    parts = [
        rows.select("s", F.lit("hit").alias("p"), F.lit("KeywordHit").alias("o")),
        rows.select("s", F.lit("type").alias("p"), F.explode("types").alias("o")),
        rows.select("s", F.lit("label").alias("p"), F.explode("labels").alias("o")),
        rows.select("s", F.lit("sameAs").alias("p"), F.explode("same_as").alias("o")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
