"""Quads from N-Quads text or sorted Parquet, and back; quad views over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("s", "p", "o", "c")
_TERM = r'(<[^>]*>|_:[^ ]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s+{_TERM}\s*\.\s*$"


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Quads text, plain or gzip; lines that aren't quads are left out."""
    line = spark.read.text(path)
    return line.where(F.col("value").rlike(_LINE)).select(*(F.regexp_extract("value", _LINE, i + 1).alias(c) for i, c in enumerate(COLUMNS)))


def write_nquads(quads: DataFrame, path: str) -> None:
    quads.select(F.concat(F.concat_ws(" ", *COLUMNS), F.lit(" .")).alias("value")).write.text(path, compression="gzip")


def write_block(quads: DataFrame, path: str, by: tuple[str, ...] = COLUMNS) -> None:
    """Sorted Parquet: ranges of the first column by file, so that footers act as a sparse index."""
    quads.repartitionByRange(*by[:1]).sortWithinPartitions(*by).write.parquet(path)


def read_block(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(block: DataFrame, **bound: str) -> DataFrame:
    """Quads with the given terms; the filter reaches the scan and skips files and row groups."""
    for column, term in bound.items():
        block = block.where(F.col(column) == term)
    return block


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''").distinct()


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """(from, to) of lines that hold two terms."""
    return spark.read.text(path).select(F.split("value", r"\s+").alias("x")).where(F.size("x") >= 2).select(F.col("x")[0].alias("from"), F.col("x")[1].alias("to"))


V = "http://ex.org/v#"
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_CUST = "concat('<http://c', {k} % 3, '.example.net/cust/', {k}, '>')"
_DOC = "concat('<http://src', ({k}) % 7, '.example.org/doc/', CAST(floor(({k}) / 97) AS BIGINT), '>')"  # documents grow with the tables
_ORDER = "concat('<http://o', o_orderkey % 5, '.example.org/order/', o_orderkey, '>')"
_LINE_ORDER = "concat('<http://o', l_orderkey % 5, '.example.org/order/', l_orderkey, '>')"

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_RDFS, _OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
_SCHEMA = (
    ("OrderF", f"{_RDFS}subClassOf", "ClosedOrder"), ("OrderO", f"{_RDFS}subClassOf", "OpenOrder"), ("OrderP", f"{_RDFS}subClassOf", "OpenOrder"),
    ("ClosedOrder", f"{_RDFS}subClassOf", "Order"), ("OpenOrder", f"{_RDFS}subClassOf", "Order"), ("Order", f"{_OWL}equivalentClass", "Purchase"),
    ("BUILDING", f"{_RDFS}subClassOf", "Customer"), ("Customer", f"{_OWL}equivalentClass", "Client"), ("Purchase", f"{_OWL}intersectionOf", "l1"), ("Party", f"{_OWL}unionOf", "l3"),
    *((a, f"{_RDF}{b}", o) for a, b, o in (("l1", "first", "Event"), ("l1", "rest", "l2"), ("l2", "first", "Paid"), ("l2", "rest", f"{_RDF}nil"), ("l3", "first", "Client"), ("l3", "rest", "l4"), ("l4", "first", "Firm"), ("l4", "rest", f"{_RDF}nil"))),
    ("customer", f"{_RDFS}subPropertyOf", "agent"), ("agent", f"{_RDFS}domain", "Event"), ("agent", f"{_RDFS}range", "Customer"), ("customer", f"{_OWL}inverseOf", "orders"),
    ("seeAlso", f"{_RDFS}subPropertyOf", "relatedTo"), ("relatedTo", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", f"{_OWL}SymmetricProperty"), ("name", f"{_OWL}equivalentProperty", "title"),
    *((p, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", f"{_OWL}{kind}Property") for p, kind in (("mbox", "InverseFunctional"), ("customer", "Functional"), ("supplier", "Functional"))),
)

#: Views in SQL that Spark and DuckDB read alike; later ones use earlier ones.
VIEWS = {
    "q_orders": f"SELECT {_ORDER} AS s, '<{V}customer>' AS p, {_CUST.format(k='o_custkey')} AS o, {_DOC.format(k='o_orderkey')} AS c FROM orders",
    "q_type": f"SELECT {_ORDER} AS s, '{TYPE}' AS p, concat('<{V}Order', o_orderstatus, '>') AS o, {_DOC.format(k='o_orderkey')} AS c FROM orders UNION ALL SELECT {_CUST.format(k='c_custkey')}, '{TYPE}', concat('<{V}', c_mktsegment, '>'), {_DOC.format(k='c_custkey')} FROM customer",
    "q_line": f"SELECT {_LINE_ORDER} AS s, '<{V}part>' AS p, concat('<http://parts.example.com/part/', l_partkey, '>') AS o, {_DOC.format(k='l_orderkey')} AS c FROM lineitem UNION ALL SELECT {_LINE_ORDER}, '<{V}supplier>', concat('<http://s', l_suppkey % 4, '.example.co.uk/supp/', l_suppkey, '#me>'), {_DOC.format(k='l_orderkey')} FROM lineitem",
    "q_name": f"""SELECT {_CUST.format(k='c_custkey')} AS s, '<{V}name>' AS p, concat('"', c_name, '"', CASE WHEN c_custkey % 3 = 0 THEN '@en' WHEN c_custkey % 3 = 1 THEN '@de' ELSE '' END) AS o, {_DOC.format(k='c_custkey')} AS c FROM customer UNION ALL SELECT {_CUST.format(k='c_custkey')}, '<{V}mbox>', concat('<mailto:', c_nationkey, '.', c_custkey % 20, '@example.org>'), {_DOC.format(k='c_custkey')} FROM customer UNION ALL SELECT {_CUST.format(k='c_custkey')}, '<{V}nation>', concat('"', c_nationkey, '"^^<http://www.w3.org/2001/XMLSchema#integer>'), {_DOC.format(k='c_custkey + 1')} FROM customer""",
    "q_ref": f"SELECT {_ORDER} AS s, '<{V}seeAlso>' AS p, concat('<http://src', (o_orderkey * 3) % 7, '.example.org/doc/', CAST(floor(o_orderkey / 291) AS BIGINT), CASE WHEN o_orderkey % 4 = 0 THEN '#frag>' ELSE '>' END) AS o, {_DOC.format(k='o_orderkey')} AS c FROM orders",
    "q_inferred": f"SELECT {_ORDER} AS s, '<{V}customer>' AS p, {_CUST.format(k='o_custkey')} AS o, concat('<urn:rule:', o_orderkey % 4, '>') AS c FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT {_ORDER}, '<{V}buyer>', {_CUST.format(k='o_custkey')}, concat('<urn:rule:', o_orderkey % 4, '>') FROM orders WHERE o_orderkey % 3 <> 1 UNION ALL SELECT {_ORDER}, '<{V}buyer>', {_CUST.format(k='o_custkey')}, '<urn:rule:9>' FROM orders WHERE o_orderkey % 6 = 0",
    "q_sameas": f"SELECT {_CUST.format(k='c_custkey')} AS s, '<http://www.w3.org/2002/07/owl#sameAs>' AS p, {_CUST.format(k='(c_custkey + 1)')} AS o, {_DOC.format(k='c_custkey')} AS c FROM customer WHERE c_custkey % 10 < 3",
    # statements that contradict each other once customers k .. k + 3 (k % 10 = 0) are one
    "q_social": " UNION ALL ".join(f"SELECT {_CUST.format(k=f'(c_custkey + {a})')} AS s, {p} AS p, {o} AS o, {_DOC.format(k='c_custkey')} AS c FROM customer WHERE c_custkey % 10 = 0" for a, p, o in (
        *((a, f"'<{V}{p}>'", _CUST.format(k=f"(c_custkey + {b})")) for a, p, b in ((0, "follows", 1), (0, "parentOf", 5), (5, "parentOf", 1), (0, "likes", 5), (1, "dislikes", 5), (2, "ignores", 5), (1, "friend", 5), (2, "mate", 5))),
        *((a, f"'{TYPE}'", f"'<{V}{c}>'") for a, c in ((0, "Active"), (1, "Inactive"), (0, "Person"), (1, "Company"), (0, "Hermit"), (0, "Loner"), (5, "Vip"), (0, "Solo"))),
        (1, f"'<{V}phone>'", "concat('\"', c_custkey, '\"')"), (0, "'<http://www.w3.org/2002/07/owl#differentFrom>'", _CUST.format(k="(c_custkey + 1)")),
    )),
    "q_text": " UNION ALL ".join(f"SELECT {_CUST.format(k='c_custkey')} AS s, '<{p}>' AS p, {o} AS o, {c} AS c FROM customer" for p, o, c in (
        (f"{_RDFS}comment", "concat('\"segment ', lower(c_mktsegment), '\"@en')", _DOC.format(k="c_custkey")), (f"{_RDFS}comment", "concat('\"nation ', c_nationkey, '\"')", _CUST.format(k="c_custkey")),
        (f"{V}name", "concat('\"', lower(c_name), '\"')", _CUST.format(k="c_custkey")), ("http://purl.org/dc/terms/date", "concat('\"20', 10 + c_nationkey, '-01-01\"^^<http://www.w3.org/2001/XMLSchema#date>')", _DOC.format(k="c_custkey")),
        ("http://www.w3.org/2003/01/geo/wgs84_pos#lat", "concat('\"', c_nationkey, '.5\"')", _DOC.format(k="c_custkey")), ("http://www.w3.org/2003/01/geo/wgs84_pos#long", "concat('\"-', c_nationkey, '.25\"')", _DOC.format(k="c_custkey")),
        ("http://xmlns.com/foaf/0.1/img", "concat('<http://img.example.org/', c_custkey, '.png>')", _DOC.format(k="c_custkey")),
    )),
    "tbox": "SELECT s, p, o, c FROM (VALUES " + ", ".join(f"('<{V}{a}>', '<{b}>', '<{V if not o.startswith('http') else ''}{o}>', '<{V[:-1]}>')" for a, b, o in _SCHEMA) + ") AS t(s, p, o, c)",
    "quads": "SELECT * FROM q_orders UNION ALL SELECT * FROM q_type UNION ALL SELECT * FROM q_line UNION ALL SELECT * FROM q_name UNION ALL SELECT * FROM q_ref",
    "contexts": "SELECT DISTINCT c FROM quads",
    "docs_n": "SELECT c, CAST(regexp_extract(c, '/doc/([0-9]+)', 1) AS INT) AS n FROM contexts",
    "ranks": "SELECT c AS node, (1 + n) / 100.0E0 AS rank FROM docs_n WHERE n % 10 <> 3",
    "redirects": "SELECT c AS src, concat(regexp_extract(c, '^(<.*/doc/)', 1), n + 1, '>') AS dst FROM docs_n WHERE n % 11 = 0",
    "ranked": "SELECT q.s, q.p, q.o, q.c, coalesce(r.rank, 0.0E0) AS rank FROM q_orders q LEFT JOIN ranks r ON q.c = r.node UNION ALL SELECT s, p, o, c, 0.25E0 FROM q_inferred",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


def views(spark: SparkSession, sf_dir: str, *names: str, given: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """The named views over the tables of sf_dir, without leaving temporary views behind; those in `given` are at hand and not made again."""
    made: dict[str, DataFrame] = dict(given or {})

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in _TABLES:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                sql = VIEWS[name]
                used = {x: get(x) for x in (*_TABLES, *VIEWS) if x != name and f" {x} " in f"{sql} ".replace("\n", " ")}
                for x in used:
                    for word in ("FROM", "JOIN"):
                        sql = f"{sql} ".replace(f"{word} {x} ", f"{word} {{{x}}} ")
                made[name] = spark.sql(sql, **{x: d for x, d in used.items() if f"{{{x}}}" in sql})
        return made[name]

    return [get(n) for n in names]


def prelude() -> str:
    """WITH clauses of all views, for DuckDB."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in VIEWS.items())
