"""Column expressions over terms in N3 form: <iri>, _:blank, "literal"@lang or "literal"^^<datatype>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
SAME_AS = "<http://www.w3.org/2002/07/owl#sameAs>"
MIN_RANK = 1e-7
#: Two-label suffixes under which a domain has three labels; others have two. The public ones in common use, and the tests' example.net.
SUFFIXES = tuple(
    f"{second}.{top}"
    for top, seconds in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi kiwi maori net org school", "jp": "ac ad co ed go gr lg ne or",
        "br": "art blog com edu eng gov ind inf jus leg mil net org tv", "cn": "ac com edu gov mil net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "kr": "ac co go ne or pe re",
        "in": "ac co edu firm gen gov ind net nic org res", "za": "ac co edu gov law net nom org school web", "il": "ac co gov k12 muni net org", "tr": "av bel com edu gen gov info k12 mil net org", "mx": "com edu gob net org",
        "ar": "com edu gob gov int mil net org tur", "co": "com edu gov mil net nom org", "sg": "com edu gov net org per", "my": "com edu gov mil net org", "th": "ac co go in mi net or", "id": "ac co desa go mil my net or sch web",
        "at": "ac co gv or", "pl": "com edu gov info net org", "ru": "com edu gov msk net org spb", "ua": "com edu gov in kiev kyiv net org", "hu": "co info org", "pt": "com edu gov org", "es": "com edu gob nom org", "fr": "asso com gouv nom prd tm", "it": "edu gov", "gr": "com edu gov net org",
        "ph": "com edu gov net org", "vn": "ac com edu gov net org", "eg": "com edu gov net org", "ng": "com edu gov net org", "ke": "ac co go ne or sc", "sa": "com edu gov med net org", "pk": "com edu gov net org", "bd": "com edu gov net org", "pe": "com edu gob net org", "ve": "co com edu gob net org",
    }.items()
    for second in seconds.split()
) + ("example.net",)


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def kind(t: Column) -> Column:
    return F.when(is_iri(t), "iri").when(is_blank(t), "bnode").when(is_literal(t), "literal")


def strip_fragment(t: Column) -> Column:
    """An IRI without #fragment; other terms as they are."""
    return F.when(is_iri(t) & t.contains("#"), F.regexp_replace(t, r"#[^>]*>$", ">")).otherwise(t)


def host(t: Column) -> Column:
    """Host of an IRI in lower case, with or without angle brackets; empty if it has none."""
    start = F.substring_index(t, "/", 3)
    name = F.substring_index(start, "/", -1)
    plain = (start.startswith("<http://") | start.startswith("<https://")) & ~name.rlike("[@:?#>]")  # one look at the name, which is cut anew for each
    # what most IRIs look like is cut without a pattern
    return F.lower(F.when(plain, name).otherwise(F.regexp_extract(t, r"^<?[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@>]*@)?([^/:?#>]+)", 1)))


def authority(t: Column) -> Column:
    """What tells a term's kind, host and domains, and is the same for all terms of a host: rows are counted by it before hosts are taken from it."""
    return F.when(is_literal(t), '"').when(t.contains("://"), F.substring_index(t, "/", 3)).otherwise(F.substring(t, 1, 2))


def document_authority(t: Column) -> Column:
    """authority of the term without its fragment."""
    a = authority(t)
    return F.when(a.contains("#"), authority(strip_fragment(t))).otherwise(a)


def path(t: Column) -> Column:
    return F.regexp_extract(t, r"^<?[A-Za-z][A-Za-z0-9+.-]*://[^/?#>]*([^?#>]*)", 1)


def pay_level_domain(t: Column) -> Column:
    """Registered domain of an IRI, or no_pld."""
    h = host(t)
    two = F.substring_index(h, ".", -2)
    return F.when(~is_iri(t) | (h == ""), "no_pld").when(two.isin(*SUFFIXES), F.substring_index(h, ".", -3)).otherwise(two)


def top_level_domain(t: Column) -> Column:
    last = F.regexp_extract(host(t), r"([^.]+)$", 1)
    return F.when(is_literal(t), "literal").when(is_blank(t), "bnode").when(last != "", last).otherwise("noTLD")


def namespace(t: Column) -> Column:
    ns = F.regexp_extract(t, r"^<(.*[#/])[^#/>]*>$", 1)
    return F.when(is_iri(t) & (ns != ""), ns).otherwise("no_ns")


def lexical(t: Column) -> Column:
    """Lexical form of a literal, with \\" and \\n unescaped; null for other terms."""
    body = F.regexp_extract(t, r'(?s)^"(.*)"', 1)
    return F.when(is_literal(t), F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))


def language(t: Column) -> Column:
    tag = F.regexp_extract(t, r'"@([A-Za-z0-9-]+)$', 1)
    return F.when(is_literal(t) & (tag != ""), tag).otherwise("no_lang")


def datatype(t: Column) -> Column:
    dt = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    return F.when(is_literal(t) & t.contains('"^^<') & (dt != ""), dt).otherwise("no-dt")


def normal_url(u: Column) -> Column:
    """Scheme and host in lower case, without fragment; an empty path becomes /."""
    u = F.regexp_replace(u, r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    return F.concat(head, F.when(rest.startswith("/") | (head == ""), rest).otherwise(F.concat(F.lit("/"), rest)))


BAD_SUFFIXES = (".jpg", ".png", ".gif", ".css", ".js", ".zip", ".pdf", ".mp3")
BAD_PARTS = ("mailto:", "javascript:", "?sid=")


def admissible_link(u: Column) -> Column:
    """Whether a crawler follows the URL: http, a host, a path, no blacklisted ending or part."""
    n = F.lower(u)
    bad = F.lit(False)
    for s in BAD_SUFFIXES:
        bad = bad | n.endswith(s)
    for p in BAD_PARTS:
        bad = bad | n.contains(p)
    return n.startswith("http://") & (host(u) != "") & (path(u) != "") & ~bad


def is_image(t: Column) -> Column:
    return F.lower(F.substring(t, -8, 8)).rlike(r"\.(jpg|jpeg|png|gif|svg)>?$")  # no match is longer, with a line's end


def fix_cardinality(t: Column) -> Column:
    """Any literal of lexical form 1 in its normal form."""
    return F.when(is_literal(t) & F.regexp_extract(t, r'^"(.*?)"', 1).isin("1"), '"1"^^<http://www.w3.org/2001/XMLSchema#nonNegativeInteger>').otherwise(t)


def scale_rank(r: Column) -> Column:
    return F.lit(MIN_RANK) + F.lit(1 - MIN_RANK) * r


def words(t: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), 1)
