"""Text as code-point arrays: word boundaries and 64-bit word hashes for whole batches at once.

A block is many documents laid end to end as uint32 code points. Every step is a pass over the
block in NumPy, so the cost per character is a few nanoseconds whatever the vocabulary is.
"""

from __future__ import annotations

import ctypes
import functools
import time
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LETTER, NUMBER, SPACE = 1, 2, 4
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


@functools.cache
def char_flags() -> np.ndarray:
    """For every code point: LETTER (L*), NUMBER (N*), SPACE (Unicode White_Space) bits."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0x32400 <= c < 0xE0000 or c >= 0xE0200:
            continue  # unassigned, or private use
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE
    return out


@functools.cache
def lower_table() -> np.ndarray:
    """Lower case of each code point, for those whose lower case is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        step = np.full(size, base, U64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(step, dtype=U64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finalizer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by U+0000; and where each text starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "\0".join(texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    return cps, starts


TIDY_SECONDS = 2.0


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over batches that hands back to the system, now and then and at the end of a task, memory that is free in its worker."""

    @functools.wraps(run)
    def tidied(batches):
        since = time.monotonic()
        try:
            for out in run(batches):
                yield out
                del out
                if time.monotonic() - since > TIDY_SECONDS:
                    _hand_back()
                    since = time.monotonic()
        finally:
            _hand_back()

    return tidied


def each(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts of a column, of which few at a time become Python strings."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def blocks(texts: pa.Array | list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `size` characters, at most 2**16: index of the first, and the texts (null as empty)."""
    at, run, chars = 0, [], 0
    for i, t in enumerate(each(texts) if isinstance(texts, pa.Array) else texts):
        t = t or ""
        if run and (chars + len(t) > size or len(run) == 1 << 16):
            yield at, run
            at, run, chars = i, [], 0
        run.append(t)
        chars += len(t) + 1
    if run:
        yield at, run


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


class Prefix:
    """Hashes of any span of a code-point array, from one pass over it."""

    def __init__(self, cps: np.ndarray):
        n = len(cps)
        self.inv = powers(BASE_INV, n + 1)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum((cps.astype(U64) + U64(0x1F3D)) * powers(BASE, n), out=self.sum[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, and start and end of each run of letters and numbers."""
    start, end = runs((char_flags()[cps] & (LETTER | NUMBER)) != 0)
    return lower_table()[cps], start, end


def owner(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(starts, at, "right") - 1
