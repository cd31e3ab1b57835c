"""Secrets by character Markov models: random strings against ordinary identifiers.

Each class of random string (hexadecimal, upper-case with digits, letters with digits, base 64) and each of ordinary text (identifiers, numbers) has a
first-order Markov model over the characters of candidates, trained from labelled samples with additive
smoothing. `labelled_samples` makes the default sample: seeded random strings of each alphabet, and
identifiers put together from words in the usual styles, with numbers and dates. A run is a maximal string of letters, digits
and "_+/-" with up to two "=" behind, whatever its first character. Its candidates are the whole (without "_", "-" and "/" in front), each
of its pieces between those three, and for each random class the stretch of pieces whose log-likelihood ratio sums highest,
all of MIN_LENGTH or more. A candidate's score is the log-likelihood of the likeliest random class minus that of the likeliest
ordinary one; the best of a run is a secret at THRESHOLD or more, and what lies before and behind it is searched again.
A single "_", "-" or "/" between a quote or "=" and the secret belongs to it.

Results: (doc_id, start, end, length, score), offsets in characters, one row for each secret. Null or empty
texts have none; repeated rows report their own secrets each; a null doc_id stays null; texts are scanned
whole. Candidates touching other letters (as é) are cut there. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrille.llm import vec

MIN_LENGTH, THRESHOLD, SMOOTHING = 16, 12.0, 0.5
ORDINARY = ("identifier", "number")
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/-="
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{%d,}={0,2}" % MIN_LENGTH)
PIECE = re.compile(r"[A-Za-z0-9+]+=*")
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in CHARS]] = np.arange(len(CHARS))
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alnum": CHARS[:62],
    "base64": CHARS[:62] + "+/-_",
}
_WORDS = (
    "the of and to in that is was for with on are this have from not but they his her which one you were all their there been many some "
    "account address admin agent alias array async auth backup base batch block body broker buffer build bundle cache call channel chart check class "
    "client clone cluster code column commit config connect content context control cookie core count create cursor data date debug default delete "
    "deploy device digest domain driver element email entry error event export extend feature field file filter fetch flag folder font format frame "
    "function gateway global graph group handle handler header health heap hidden history hook host image import index info init input insert instance "
    "integer internal item iterator job join key label language layer layout length level library limit line link list listener loader local lock "
    "logger lookup loop machine main manager map mapper matrix memory menu merge message meta method metric migration mode model module monitor name "
    "network node number object offset open option order origin output owner package packet page panel param parent parse parser partition password patch path "
    "pattern payload peer pending permission pipeline plan plugin point pool port prefix process producer product profile project property protocol provider "
    "proxy public query queue random range reader record region register release remote render replica report request reset resource response result retry "
    "return role root route router rule runner runtime sample scale schedule schema scope score script search second section secret security segment select "
    "sender serial server service session setting setup shard share signal single size slice socket sort source space split stack stage start state static "
    "status step storage store stream string structure style submit subscribe suffix summary support switch symbol sync system table target task template "
    "temporary tenant test text theme thread throttle time timeout title token topic trace track transaction transfer transform tree trigger type unique unit "
    "update upload user utility validate value variable vector version view visible volume watch weight widget width window worker wrapper writer zone "
    "haus strasse zeit arbeit verein schule gesellschaft entwicklung verwaltung leben mit nicht werden maison travail entreprise gouvernement "
    "toujours avec pour dans casa trabajo empresa desarrollo gobierno tiempo para como siempre ciudad"
).split()


def labelled_samples(n: int = 4000, seed: int = 17) -> list[tuple[str, str]]:
    """(text, class) for each class of random string, n numbers, and 4 * n identifiers."""
    rng = random.Random(seed)
    out = []
    for kind, alphabet in _ALPHABETS.items():
        for _ in range(n):
            s = "".join(rng.choices(alphabet, k=rng.randint(MIN_LENGTH, 64)))
            out.append((s + rng.choice(["", "", "", "=", "=="]) if kind == "base64" else s, kind))
    for _ in range(n):
        digits = "".join(rng.choices("0123456789", k=rng.randint(MIN_LENGTH, 32)))
        out.append((digits if rng.random() < 0.7 else "-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "number"))
    for _ in range(4 * n):
        parts = [rng.choice(_WORDS) for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.25:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(["1", "2", "3", "10", "v1", "v2", "utf8", "2023", "2024", "2025-01-31", "20240229", "i18n", "x86", "base64", "sha256", "0001"]))
        style = rng.randrange(7)
        s = ("_".join(parts), "".join(p.capitalize() for p in parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "-".join(parts), "_".join(parts).upper(), "/".join(parts), "".join(parts))[style]
        out.append((s, "identifier"))
    return out


class Model:
    """Log probabilities of each class: of the first character, and of each next one given the last."""

    def __init__(self, samples: Iterable[tuple[str, str]]):
        k = len(CHARS)
        count: dict[str, np.ndarray] = {}
        for text, kind in samples:
            c = encode(text)
            table = count.setdefault(kind, np.zeros((k + 1, k)))
            np.add.at(table, (np.concatenate([[k], c[:-1]]), c), 1)
        self.table = {kind: np.log((x + SMOOTHING) / (x + SMOOTHING).sum(1, keepdims=True)) for kind, x in count.items()}
        self.ordinary = sorted({*ORDINARY} & set(self.table))
        self.random = sorted(set(self.table) - {*ORDINARY})

    def scores(self, candidates: list[str]) -> np.ndarray:
        """Log-likelihood of the likeliest random class less that of the likeliest ordinary one."""
        if not candidates:
            return np.zeros(0)
        size = np.fromiter(map(len, candidates), np.int64, len(candidates))
        code = encode("".join(candidates))
        first = np.cumsum(size) - size
        last = np.concatenate([[0], code[:-1]])
        last[first] = len(CHARS)
        total = {kind: np.add.reduceat(t[last, code], first) for kind, t in self.table.items()}
        return np.max([total[r] for r in self.random], 0) - np.max([total[r] for r in self.ordinary], 0)


    def stretches(self, run: str, pieces: list[tuple[int, int]], least: int) -> set[tuple[int, int]]:
        """For each random class, the stretch of pieces of `least` characters or more with the highest sum of log-likelihood ratios, a piece's ordinary class being its likeliest."""
        code = encode(run)
        start, end = np.array(pieces).T
        last = np.concatenate([[len(CHARS)], code[:-1]])
        # a piece with the separators before it
        total = {kind: np.add.reduceat(t[last, code], np.concatenate([[0], end[:-1]]))[: len(pieces)] for kind, t in self.table.items()}
        plain = np.max([total[o] for o in self.ordinary], 0)
        able = np.searchsorted(start, end - least, "right")  # starts that leave enough characters, for each end
        out = set()
        for r in self.random:
            sums = np.concatenate([[0], np.cumsum(total[r] - plain)])
            low = np.minimum.accumulate(sums[:-1])
            gain = np.where(able > 0, sums[1:] - low[np.maximum(able, 1) - 1], -np.inf)
            j = int(gain.argmax())
            if able[j]:
                out.add((int(sums[: able[j]].argmin()), j))
        return out

    def secrets(self, run: str, quoted: bool, threshold: float) -> list[tuple[int, int, float]]:
        """(start, end, score) of the secrets in one run; `quoted`: a quote or "=" stands before it."""
        pieces = [m.span() for m in PIECE.finditer(run)]
        if not pieces:
            return []
        first = pieces[0][0]
        out, todo = [], [(0, len(pieces))]
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            ends = [e for _, e in pieces[lo:hi]]
            if hi == len(pieces):
                ends[-1] = len(run)  # "-" and "_" may end a secret
            own = [(s, e) for (s, _), e in zip(pieces[lo:hi], ends, strict=True)]
            lead = int(quoted and lo == 0 and first == 1)
            if own[-1][1] - own[0][0] + lead < MIN_LENGTH:
                continue
            spans = {(0, hi - lo - 1)}
            if hi - lo > 1:
                spans |= {(i, i) for i, (s, e) in enumerate(own)} | self.stretches(run[own[0][0] : own[-1][1]], [(s - own[0][0], e - own[0][0]) for s, e in own], MIN_LENGTH)
            spans = [(i, j) for i, j in sorted(spans) if own[j][1] - own[i][0] + (lead and i == 0) >= MIN_LENGTH]
            if not spans:
                continue
            score = self.scores([run[own[i][0] : own[j][1]] for i, j in spans])
            best = int(score.argmax())
            if score[best] < threshold:
                continue
            i, j = spans[best]
            out.append((own[i][0] - (lead if i == 0 else 0), own[j][1], float(score[best])))
            todo += [(lo, lo + i), (lo + j + 1, hi)]
        return sorted(out)


def encode(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def scan(docs: DataFrame, samples: Iterable[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, length, score) of all secrets."""
    model = docs.sparkSession.sparkContext.broadcast(Model(samples if samples is not None else labelled_samples()))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "length")), T.StructField("score", T.DoubleType())])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, found = [], [], []
            parts = []  # (row, start, end, score) in runs of several pieces
            for i, text in enumerate(b.column("text").to_pylist()):
                for m in CANDIDATE.finditer(text) if text else ():
                    whole = m.group()
                    if PIECE.fullmatch(whole):
                        row.append(i)
                        start.append(m.start())
                        found.append(whole)
                    else:
                        quoted = m.start() > 0 and text[m.start() - 1] in "\"'`="
                        parts += [(i, m.start() + s, m.start() + e, x) for s, e, x in model.value.secrets(whole, quoted, threshold)]
            score = model.value.scores(found)
            parts += [(row[k], start[k], start[k] + len(found[k]), score[k]) for k in np.flatnonzero(score >= threshold).tolist()]
            parts.sort()
            at, end = (np.array([p[k] for p in parts], np.int32) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.array([p[0] for p in parts], np.int64))), pa.array(at), pa.array(end), pa.array(end - at), pa.array(np.array([p[3] for p in parts], np.float64))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
