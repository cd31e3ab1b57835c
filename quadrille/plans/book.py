"""A register of queries and their SQL, and SQL fragments that mirror the term functions."""

from __future__ import annotations

from collections.abc import Callable

from quadrille.functions.terms import RDF_TYPE, SAME_AS, SUFFIXES
from quadrille.sources.quads import prelude

TYPE, SAME = f"'{RDF_TYPE}'", f"'{SAME_AS}'"


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, raw: bool = False):
        """Registers a function; sql follows the views' WITH clauses unless raw. A leading comma adds more."""

        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql if raw else prelude() + ("\n" if not sql.lstrip().startswith(",") else "") + sql
            return f

        return keep


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^<?[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@>]*@)?([^/:?#>]+)', 1))"


def pld(x: str) -> str:
    labels, known = f"string_split({host(x)}, '.')", ", ".join(f"'{s}'" for s in SUFFIXES)

    def last(n: int) -> str:
        return f"array_to_string({labels}[greatest(1, len({labels}) - {n - 1}):], '.')"

    return f"CASE WHEN NOT starts_with({x}, '<') OR {host(x)} = '' THEN 'no_pld' WHEN {last(2)} IN ({known}) THEN {last(3)} ELSE {last(2)} END"


def tld(x: str) -> str:
    last = f"regexp_extract({host(x)}, '([^.]+)$', 1)"
    return f"CASE WHEN starts_with({x}, '\"') THEN 'literal' WHEN starts_with({x}, '_:') THEN 'bnode' WHEN {last} <> '' THEN {last} ELSE 'noTLD' END"


def ns(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '<') AND regexp_extract({x}, '^<(.*[#/])[^#/>]*>$', 1) <> '' THEN regexp_extract({x}, '^<(.*[#/])[^#/>]*>$', 1) ELSE 'no_ns' END"


def strip(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '<') THEN regexp_replace({x}, '#[^>]*>$', '>') ELSE {x} END"


def lang(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '\"') AND regexp_extract({x}, '\"@([A-Za-z0-9-]+)$', 1) <> '' THEN regexp_extract({x}, '\"@([A-Za-z0-9-]+)$', 1) ELSE 'no_lang' END"


def datatype(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '\"') AND regexp_extract({x}, '\"\\^\\^<([^>]*)>$', 1) <> '' THEN regexp_extract({x}, '\"\\^\\^<([^>]*)>$', 1) ELSE 'no-dt' END"


def kind(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '<') THEN 'iri' WHEN starts_with({x}, '_:') THEN 'bnode' ELSE 'literal' END"
