"""Personal data by anchor expansion: Aho-Corasick finds cues, local parsers find and check the bounds.

Anchors: "@"; the schemes "mailto:", "tel:" and "://" (of which only addresses with a user name count);
cue words of accounts; ends of street names; pairs of digits, digits before a dot, colons before hexadecimal digits. From an anchor a deterministic parser
extends to both sides as far as the characters of its kind go, and only then accepts or rejects what it has: e-mail addresses (label rules), IP addresses (octets; groups of
version 6), card numbers (Luhn; where a longer run of digits fails, also the shorter numbers between its separators), IBANs (modulo 97; in one piece also
in lower case), social security and telephone numbers (grouping), account numbers (after a
cue, 6 to 34 digits), street addresses (number, capitalized names, kind of street). What fails its check isn't reported; nothing is cut to fit a window.

Results: (doc_id, kind, start, end, value), one row for each match, in the order of the text, offsets in
characters. Where two overlap the one that starts first (then the longer, then the kind first in the alphabet) stays. Null or empty texts have none; repeated
rows report their own matches each; a null doc_id stays null. Texts are searched whole. Extra columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrille.llm import vec

_LOCAL = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_.%+\-]*[A-Za-z0-9_%+\-])?")
_DOMAIN_RUN = re.compile(r"[\w.\-]*")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_NUMBERS = (
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", re.A)),
    ("card", re.compile(r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-]|\.\d)", re.A)),
    ("ssn", re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", re.A)),
    ("phone", re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w])", re.A)),
    ("phone", re.compile(r"(?<![\w.+])\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}(?![\w])", re.A)),
)
_CARD_RUN = re.compile(r"\d+(?:[ \-]\d+){0,37}", re.A)
_CARD_SIZE = re.compile(r"\d(?:[ \-]?\d){12}", re.A)
_CARD_START, _CARD_END = re.compile(r"(?<![\w.])(?:(?<!-)|(?<=[0-9]-))", re.A), re.compile(r"(?![\w\-]|\.\d)|[ \-]\d", re.A)
_CARD_LAYOUT = re.compile(r"[2-6]\d{12,18}|[2-6]\d{3}([ \-])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|3\d{3}([ \-])\d{6}\2\d{4,5}", re.A)
_IBANS = (
    re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A),
    re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}(?![A-Za-z0-9])", re.A),
)
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?:(?:\d{1,3}\.){3}\d{1,3})?(?![\w:]|\.\w)")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:no\.?|number|nr\.?|id|#))?[ \t]*[:=#]?[ \t]*([0-9](?:[ \-]{0,2}[0-9])*)(?!\w)", re.I)
_STREET = re.compile(r"(?<!\w)\d{1,5}[a-z]? (?:[A-Z][\w'\-]* ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b\.?")
_AUTHORITY = re.compile(r"[^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@(?:[A-Za-z0-9\-]+\.)*[A-Za-z0-9\-]+[^\s\"'<>]*")
_TEL = re.compile(r"\+?[0-9](?:[ .\-()]{0,2}[0-9])*(?!\w)")
#: Characters that matches of these kinds consist of: no match crosses the bounds of a run of them.
_DIGITS, _NUMBER, _IBAN = (frozenset(x) for x in ("0123456789", "0123456789 .()+-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
_UPPER, _HEX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "), frozenset("0123456789abcdefABCDEF:.")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if kind == "iban":
        s = value.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"
    if kind == "phone":
        return 8 <= len(re.sub(r"\D", "", value)) <= 15
    if kind == "ip6":
        try:
            return ipaddress.IPv6Address(value).packed.count(0) < 15  # neither :: nor ::1
        except ValueError:
            return False
    return True


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    for scheme in ("mailto:", "tel:", "://"):
        a.add_word(scheme, (scheme, len(scheme)))
    for cue in ("account", "acct", "konto", "compte", "cuenta"):
        for word in (cue, cue.capitalize(), cue.upper()):
            a.add_word(word, ("account", len(word)))
    for end in ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Lane", "Ln", "Drive", "Dr"):
        a.add_word(f" {end}", ("street", len(end) + 1))
    for h in "0123456789abcdefABCDEF:":
        a.add_word(f":{h}", ("colon", 2))
    for i in range(10):
        a.add_word(f"{i}.", ("digits", 2))
        for j in range(10):
            a.add_word(f"{i}{j}", ("digits", 2))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset) -> tuple[int, int]:
    """Bounds of the run of such characters that holds the place."""
    lo = hi = at
    while lo > 0 and text[lo - 1] in chars:
        lo -= 1
    while hi < len(text) and text[hi] in chars:
        hi += 1
    return lo, hi


def _email(text: str, at: int):
    lo = at
    while lo > 0 and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-"):
        lo -= 1
    while lo < at and text[lo] in ".-+%":
        lo += 1
    local = text[lo:at]
    end = _DOMAIN_RUN.match(text, at + 1).end()
    while text[end - 1] in ".-":
        end -= 1
    if len(local) > 64 or ".." in local or not _LOCAL.fullmatch(local) or end - at > 254 or not _DOMAIN.fullmatch(text, at + 1, end):
        return None
    return "email", lo, end


def _card_within(text: str, at: int):
    """A card number from the start of the digits at `at` to a later separator, where the whole run is none.

    The usual grouping goes first, then the longest; an unusual one yields to a usual one that it would overlap."""
    while at > 0 and text[at - 1] in "0123456789":
        at -= 1
    if not _CARD_SIZE.match(text, at):
        return None
    groups = [m.span() for m in re.finditer(r"[0-9]+", _CARD_RUN.match(text, at).group())]
    groups = [(at + a, at + b) for a, b in groups]

    def valid(k: int) -> list[tuple[int, int]]:
        start, count, out = groups[k][0], 0, []
        if not _CARD_START.match(text, start):
            return out
        for a, b in groups[k:]:
            count += b - a
            if count > 19:
                break
            if count >= 13 and _CARD_END.match(text, b) and _valid("card", text[start:b]):
                out.append((start, b))
        return sorted(out[::-1], key=usual, reverse=True)

    def usual(span: tuple[int, int]) -> bool:
        return _CARD_LAYOUT.fullmatch(text, *span) is not None

    own = valid(0)
    if not own:
        return None
    if not usual(own[0]) and any(usual(x) for k in range(1, len(groups)) if groups[k][0] < own[0][1] for x in valid(k)[:1]):
        return None
    return "card", *own[0]


def _numbers(text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    """Valid numbers in a run of their characters, and card numbers among digits that belong to none."""
    out = []
    for kind, pattern in _NUMBERS:
        for m in pattern.finditer(text, lo, hi + 2):  # two characters behind the run are all that a pattern looks at
            if _valid(kind, m.group()):
                out.append((kind, m.start(), m.end()))
    taken = lo
    for m in re.finditer(r"[0-9]+", text[lo:hi]):
        at = lo + m.start()
        if at >= taken and not any(s <= at < e for _, s, e in out) and (card := _card_within(text, at)):
            out.append(card)
            taken = card[2]
    return out


def _street_run(text: str, at: int) -> tuple[int, int]:
    lo = hi = at
    while lo > 0 and (text[lo - 1].isalnum() or text[lo - 1] in "_'- "):
        lo -= 1
    while hi < len(text) and (text[hi].isalnum() or text[hi] in "_'- "):
        hi += 1
    return lo, hi


def _within(kind: str, pattern: re.Pattern, text: str, lo: int, hi: int) -> Iterator[tuple[str, int, int]]:
    for m in pattern.finditer(text, lo, hi + 2):
        if _valid(kind, m.group()):
            yield kind, m.start(), m.end()


def _after(text: str, cue: str, start: int, end: int):
    """What begins behind a cue."""
    if cue == "account":
        m = _ACCOUNT.match(text, end)
        return ("account", m.start(1), m.end(1)) if m and 6 <= sum(c in _DIGITS for c in m.group(1)) <= 34 else None
    if cue == "://":
        lo = start
        while lo > 0 and text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "+.-"):
            lo -= 1
        while lo < start and not text[lo].isalpha():
            lo += 1
        rest = _AUTHORITY.match(text, end) if start - lo >= 2 else None
        return ("url_user", lo, rest.end()) if rest else None
    m = _TEL.match(text, end) if cue == "tel:" else None  # mailto: its "@" is an anchor of its own
    return ("phone", m.start(), m.end()) if m and 6 <= sum(c in _DIGITS for c in m.group()) <= 15 else None


def _settled(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of matches that overlap, the one that starts first, then the longer."""
    out: list[tuple[str, int, int]] = []
    for m in sorted(set(found), key=lambda m: (m[1], -m[2], m[0])):
        if not out or m[1] >= out[-1][2]:
            out.append(m)
    return out


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Matches of one text as (kind, start, end), none of which overlap."""
    found: list[tuple[str, int, int]] = []
    number = iban = upper = colon = street = -1  # ends of the runs that have been searched
    for last, (cue, size) in anchors.iter(text):
        start = last - size + 1
        if cue == "digits":
            if start >= number:
                lo, number = _run(text, start, _NUMBER)
                found += _numbers(text, lo, number)
            if start >= upper:
                lo, upper = _run(text, start, _UPPER)
                if upper - lo >= 15:
                    found += _within("iban", _IBANS[0], text, lo, upper)
            if start >= iban:
                lo, iban = _run(text, start, _IBAN)
                if iban - lo >= 15:
                    found += _within("iban", _IBANS[1], text, lo, iban)
        elif cue == "colon":
            if start >= colon:
                lo, colon = _run(text, start, _HEX)
                found += _within("ip6", _IP6, text, lo, colon)
        elif cue == "street":
            if start >= street:
                lo, street = _street_run(text, start)
                found += _within("address", _STREET, text, lo, street)
        elif hit := _email(text, start) if cue == "@" else _after(text, cue, start, last + 1):
            found.append(hit)
    return _settled(found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value) of all matches."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            row, kinds, starts, ends, values = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for kind, s, e in find(text, anchors) if text else ():
                    row.append(i)
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
                    values.append(text[s:e])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
