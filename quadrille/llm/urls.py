"""URL filter: glob rules packed into multiword Shift-And masks, all simulated at once over each URL.

Every rule is a glob over the whole canonical URL ("*" any run of characters, "?" any one). Its characters
become states of a nondeterministic automaton, one bit each, and a star is a loop on the state before it.
All rules lie end to end in words of 64 bits: reading a byte shifts the state vector (carrying between
words), keeps the bits whose character matches, and adds the states that loop. Batches of URLs advance
together, position by position, so one step costs a few vector operations for all rules and URLs.

Canonical form: scheme and host in lower case, no fragment, no default port, an empty path as "/", tracking
parameters (utm_*, gclid, fbclid, ref) dropped, white space trimmed; non-ASCII bytes percent-encoded.

Of the rules that match, the first in the list decides. Results: (page_id, canonical_url, rule, action),
one row for each input row; rule is null and action "keep" where nothing matches. A null URL has a null
canonical form and action "drop" by rule "null"; an empty one is "drop" by rule "empty". Repeated rows are
judged one by one. URLs of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import vec

U64 = np.uint64
RULES = (
    ("allow_docs", "*://docs.*/*", "keep"),
    ("ads_host", "*://ads.*", "drop"),
    ("tracker_host", "*://*.track??.*/*", "drop"),
    ("mobile_twin", "*://m.*", "drop"),
    ("login", "*/login*", "drop"),
    ("cart", "*/cart/*", "drop"),
    ("session", "*?sid=*", "drop"),
    ("print_view", "*/print/*", "drop"),
    ("archive", "*.zip", "drop"),
    ("image", "*.jp?g", "drop"),
    ("feed", "*/feed*", "drop"),
    ("html_page", "*://*.example.com/*.html", "drop"),
    ("deep_page", "*?page=*", "drop"),
    ("blog_org", "*://blog.*.example.org/*", "drop"),
    ("shop", "*://shop.*", "drop"),
    ("calendar", "*/calendar/????/??*", "drop"),
)


def canonical(url: Column) -> Column:
    """The canonical form, by built-in expressions."""
    u = F.regexp_replace(url, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    u = F.regexp_replace(u, r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(rest, r"(^|[?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    return F.concat(head, F.when((head != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest))


class Matcher:
    """Masks of a list of globs."""

    def __init__(self, globs: list[str]):
        parts = []
        for g in globs:
            chars, loops = [], set()
            for c in g.encode():
                if c == ord("*"):
                    loops.add(len(chars))
                else:
                    chars.append(c)
            parts.append((chars, loops))
        bits = sum(len(c) + 1 for c, _ in parts)
        self.words = -(-bits // 64) or 1
        self.eat = np.zeros((256, self.words), U64)  # bit set: this byte leads into this state
        self.loop = np.zeros(self.words, U64)
        self.start = np.zeros(self.words, U64)
        self.accept = []
        at = 0
        for chars, loops in parts:
            self._set(self.start, at)
            for k in loops:
                self._set(self.loop, at + k)
            for k, c in enumerate(chars, 1):
                for byte in range(256) if c == ord("?") else (c,):
                    self._set(self.eat[byte], at + k)
            at += len(chars)
            self.accept.append((at // 64, U64(at % 64)))
            at += 1

    @staticmethod
    def _set(words, bit):
        words[bit // 64] |= U64(1 << bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text (row) matches each glob (column)."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        base = np.cumsum(size) - size
        state = np.repeat(self.start[None], len(texts), 0)
        carry = np.zeros_like(state)
        for t in range(int(size.max()) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))  # texts longer than t
            now = state[:live]
            step = now << U64(1)
            if self.words > 1:
                carry[:live, 1:] = now[:, :-1] >> U64(63)
                step |= carry[:live]
            state[:live] = (step & self.eat[flat[base[:live] + t]]) | (now & self.loop)
        out = np.empty((len(texts), len(self.accept)), bool)
        for k, (w, b) in enumerate(self.accept):
            out[order, k] = (state[:, w] >> b) & U64(1) == 1
        return out


def _ascii(url: str) -> bytes:
    raw = url.encode("utf-8", "surrogatepass")
    return raw if raw.isascii() else b"".join(b"%%%02X" % c if c > 127 else bytes((c,)) for c in raw)


def screen(pages: DataFrame, column: str = "url", id_column: str = "page_id", rules=RULES) -> DataFrame:
    """The decision on each URL."""
    names, actions = [r[0] for r in rules], [r[2] for r in rules]
    globs = [r[1] for r in rules]
    kind = pages.schema[id_column].dataType.simpleString()

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(globs)
        for b in batches:
            urls = b.column(1).to_pylist()
            texts = [_ascii(u) if u else b"" for u in urls]
            hits = matcher.match(texts)
            first = hits.argmax(1)
            some = hits.any(1)
            rule = ["null" if u is None else "empty" if not u else names[k] if s else None for u, s, k in zip(urls, some.tolist(), first.tolist(), strict=True)]
            action = ["drop" if not u else actions[k] if s else "keep" for u, s, k in zip(urls, some.tolist(), first.tolist(), strict=True)]
            shown = pa.array([None if u is None else t.decode() for u, t in zip(urls, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), shown, pa.array(rule, pa.string()), pa.array(action, pa.string())], names=["page_id", "canonical_url", "rule", "action"])

    return pages.select(F.col(id_column).alias("page_id"), canonical(F.col(column)).alias("url")).mapInArrow(run, f"page_id {kind}, canonical_url string, rule string, action string")


def duckdb_sql(table: str = "pages", rules=RULES) -> str:
    """The same over ASCII URLs, by DuckDB's GLOB."""
    arms = " ".join(f"WHEN c GLOB '{g}' THEN '{n}'" for n, g, _ in rules)
    act = " ".join(f"WHEN c GLOB '{g}' THEN '{a}'" for _, g, a in rules)
    return f"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '#.*$', '') AS u FROM {table}),
b AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS h, u FROM a),
d AS (SELECT page_id, regexp_replace(regexp_replace(h, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') AS h,
  regexp_replace(substr(u, length(h) + 1), '(^|[?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '\\1', 'g') AS r FROM b),
e AS (SELECT page_id, h, regexp_replace(replace(regexp_replace(r, '&&+', '&', 'g'), '?&', '?'), '[?&]+$', '') AS r FROM d),
f AS (SELECT page_id, h || CASE WHEN h <> '' AND NOT starts_with(r, '/') THEN '/' || r ELSE r END AS c FROM e)
SELECT page_id, c AS canonical_url, CASE WHEN c IS NULL THEN 'null' WHEN c = '' THEN 'empty' {arms} END AS rule,
  CASE WHEN c IS NULL OR c = '' THEN 'drop' {act} ELSE 'keep' END AS action FROM f"""
