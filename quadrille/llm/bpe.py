"""Byte-pair encoding: merge ranks in a priority queue over a doubly linked list of symbols.

`merge_word` encodes one pretoken: its bytes are symbols of a linked list, every adjacent pair that
is in the vocabulary is queued by its rank, and popped entries whose symbols have changed since are
skipped as stale. Decoding concatenates the vocabulary's byte strings.

A batch of documents is cut into pretokens by the GPT-2 rule in NumPy, each distinct pretoken of the
batch is encoded once (a cache of at most 2 * CACHE_WORDS short ones keeps them between batches, some 40 MB), and the ids are put back in
order. Equal 64-bit hashes are compared character by character before they share an encoding. Callers that only store or count ids
leave the merges to a compiled library, which gets all distinct pretokens of a block in one call.

Nulls: a null text has null ids and null counts. An empty text has an empty list. Repeated rows,
ties and extra columns pass through; an extra column that bears the name of an output column raises
ValueError. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadrille.llm import vec

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_WORDS, CACHED_LENGTH = 100_000, 24  # pretokens in each half of a worker's cache, and their greatest length


class Vocabulary:
    """A rank file: each line a token in base 64 and its id, which is also its merge rank."""

    def __init__(self, raw: bytes):
        rows = [line.split() for line in raw.splitlines() if line]
        self.token = {int(rank): base64.b64decode(word) for word, rank in rows}
        self.size = max(self.token) + 1
        ids = {word: rank for rank, word in self.token.items()}
        self.byte = [ids[bytes([b])] for b in range(256)]
        #: left id * 2**24 + right id -> id of the joined token, whose value is the merge's rank
        self.pair = {}
        for word, rank in ids.items():
            for cut in range(1, len(word)):
                left, right = ids.get(word[:cut]), ids.get(word[cut:])
                if left is not None and right is not None:
                    self.pair[left << 24 | right] = rank
        self.whole = ids
        #: ids (int32, as bytes) by pretoken: those met of late, and those before them, which stay while they are met
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = np.zeros(self.size, np.int64)
        for rank, word in self.token.items():
            size[rank] = len(word)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(self.size)), np.uint8)

    def merge_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pretoken."""
        known = self.whole.get(word)
        if known is not None:
            return (known,)
        byte, pair = self.byte, self.pair
        sym = [byte[b] for b in word]
        n = len(sym)
        heap = [(rank << 40 | i) for i in range(n - 1) if (rank := pair.get(sym[i] << 24 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            rank, i = top >> 40, top & 0xFFFFFFFFFF
            left = sym[i]
            if left < 0:
                continue  # stale: this symbol was joined to the one before it
            j = after[i]
            if j >= n or pair.get(left << 24 | sym[j]) != rank:
                continue  # stale: one of the two has grown since
            sym[i], sym[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair.get(rank << 24 | sym[k])) is not None:
                    push(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := pair.get(sym[h] << 24 | rank)) is not None:
                push(heap, r << 40 | h)
        return tuple(s for s in sym if s >= 0)

    def ids_of(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pretoken as the bytes of an int32 array."""
        old = self.old
        out = list(map(self.young.get, pretokens))
        for i in [i for i, got in enumerate(out) if got is None]:
            p = pretokens[i]
            got = old.get(p)
            if got is None:
                got = array("i", self.merge_word(p.encode("utf-8", "surrogatepass"))).tobytes()
            if len(p) <= CACHED_LENGTH:
                if len(self.young) >= CACHE_WORDS:
                    self.old, self.young = self.young, {}
                    old = self.old
                self.young[p] = got
            out[i] = got
        return out

    @functools.cached_property
    def library(self):
        """A compiled encoder over the same ranks, to which U+0000 parts pretokens."""
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=r"[^\x00]+", mergeable_ranks=self.whole, special_tokens={"\0": self.size})

    def by_merges(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of spans of cps, each a pretoken, in one array; where those of each span start in it, and how many they are."""
        text = cps.tobytes().decode("utf-32-le", "surrogatepass")
        lists = self.ids_of([text[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
        n = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        return np.frombuffer(b"".join(lists), np.int32), np.cumsum(n) - n, n

    def by_library(self, cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by the library, in one call for all; U+0000 and surrogates, which it doesn't take, are left to `by_merges`."""
        odd = np.flatnonzero((cps == 0) | (cps >> 11 == 0xD800 >> 11))
        held = np.searchsorted(odd, begin) != np.searchsorted(odd, end)
        if held.any():
            ids, at, n = self.by_merges(cps, begin[held], end[held])
            more, start, size = (self.by_library(cps, begin[~held], end[~held]) if not held.all() else (ids[:0], at[:0], n[:0]))
            every, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
            every[held], every[~held], count[held], count[~held] = at, start + len(ids), n, size
            return np.concatenate([ids, more]), every, count
        stop = np.cumsum(end - begin + 1)
        chars = cps[np.arange(stop[-1]) + np.repeat(end + 1 - stop, end - begin + 1)]
        chars[stop - 1] = 0
        ids = self.library.encode_to_numpy(chars[:-1].tobytes().decode("utf-32-le"), allowed_special={"\0"}).view(np.int32)
        stop = np.append(np.flatnonzero(ids == self.size), len(ids))
        at = np.concatenate([[0], stop[:-1] + 1])
        return ids, at, stop - at

    def decode(self, ids) -> bytes:
        """The concatenated byte strings of the ids."""
        return b"".join(map(self.token.__getitem__, ids))

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and the number of bytes before each id and at the end."""
        size = self.start[ids + 1] - self.start[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends


def pretoken_starts(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each pretoken of a block starts (the U+0000 after each text starts one of its own).

    The rule is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ L N]+|s+(?!S)|s+ with L letters, N numbers.
    """
    n = len(cps)
    flags = vec.char_flags()[cps]
    ends = np.zeros(n, bool)
    ends[starts[1:] - 1] = True
    ends[n - 1] = True
    flags = np.where(ends, np.uint8(8), flags)
    prev = np.concatenate([[np.uint8(8)], flags[:-1]])
    nxt = np.concatenate([flags[1:], [np.uint8(8)]])
    space = flags == vec.SPACE
    begin = flags != prev
    # of a run of white space that something follows, the last character stands apart ...
    last = space & ~(nxt == vec.SPACE) & (nxt != 8)
    begin |= last
    # ... and takes what follows with it if it is U+0020
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (cps[:-1] == 0x20)
    begin &= ~joined
    # contractions: an apostrophe that starts a pretoken
    quote = np.flatnonzero((cps == 0x27) & begin & ~ends)
    if len(quote):
        # a run of other signs that starts before, or goes on behind, isn't a contraction
        pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        stop_one, stop_two = quote[one] + 2, quote[two] + 3
        begin[quote[one] + 1] = False
        begin[quote[two] + 1] = False
        # what follows in the same run of letters, or after it, starts anew unless white space claims it
        begin[stop_one[stop_one < n]] = True
        begin[stop_two[stop_two < n]] = True
    begin[ends] = True
    begin[0] = True
    after_end = np.flatnonzero(ends) + 1
    begin[after_end[after_end < n]] = True
    return np.flatnonzero(begin)


def _pretokens(texts: list[str], vocab: Vocabulary, compiled: bool):
    """Ids of the block's distinct pretokens in one array, where those of each start in it and how many they are; which of them each pretoken is, and the text that holds it."""
    cps, starts = vec.code_points(texts)
    begin = pretoken_starts(cps, starts)
    end = np.append(begin[1:], len(cps))
    is_end = np.zeros(len(cps), bool)
    is_end[starts[1:] - 1] = True
    is_end[-1] = True
    real = ~is_end[begin]
    begin, end = begin[real], end[real]
    if not len(begin):
        return np.zeros(0, np.int32), begin, begin, begin, begin
    # numbered in the order in which they are met first
    inverse = pa.array(vec.Prefix(cps).span(begin, end)).dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1))
    size = end - begin
    same = (size == size[first][inverse]).all()
    if same:
        # all characters of the block that belong to pretokens, against the first pretoken of the same hash
        where = np.arange(len(cps))
        where[begin[0] :] += np.repeat(begin[first][inverse] - begin, np.diff(begin, append=len(cps)))
        same = ((cps == cps[where]) | is_end).all()
    if not same:  # two pretokens share a hash: every pretoken stands for itself
        inverse = first = np.arange(len(begin))
    found = (vocab.by_library if compiled else vocab.by_merges)(cps, begin[first], end[first])
    return *found, inverse, vec.owner(starts, begin)


def encode_block(texts: list[str], vocab: Vocabulary, compiled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of ids before each text and at the end."""
    flat, at, size, inverse, own = _pretokens(texts, vocab, compiled)
    counts = np.zeros(len(texts) + 1, np.int64)
    if not len(inverse):
        return np.zeros(0, np.int32), counts
    n = size[inverse]
    total = np.cumsum(n)
    ids = flat[np.repeat(at[inverse] - (total - n), n) + np.arange(total[-1])]
    counts[1:] = np.cumsum(np.bincount(own, weights=n, minlength=len(texts)).astype(np.int64))
    return ids, counts


def count_block(texts: list[str], vocab: Vocabulary, compiled: bool = False) -> np.ndarray:
    """The number of ids of each text."""
    _, _, size, inverse, own = _pretokens(texts, vocab, compiled)
    return np.bincount(own, weights=size[inverse], minlength=len(texts)).astype(np.int64)


@functools.lru_cache(2)
def _parsed(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def encode_texts(texts: list[str | None], vocab: Vocabulary, compiled: bool = False, check: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Ids as an Arrow list column, null for null; and, if asked, whether decoding gave back each text's bytes."""
    ids, offsets, exact = [], [0], []
    for _, run in vec.blocks(texts):
        flat, ends = encode_block(run, vocab, compiled)
        if check:
            raw, at = vocab.decode_flat(flat)
            raw = raw.tobytes()
            cut = at[ends].tolist()
            exact += [raw[a:b] == t.encode("utf-8", "surrogatepass") for a, b, t in zip(cut, cut[1:], run, strict=False)]
        offsets += (ends[1:] + offsets[-1]).tolist()
        ids.append(flat)
    values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
    null = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=null), np.array(exact, bool)


def load(spark, path: str = VOCABULARY):
    """The vocabulary file, sent once to each executor (under 2 MB, whatever the data are)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY, compiled: bool = False, round_trip: bool = True, keep: bool = True) -> DataFrame:
    """docs with token_ids array<int>, n_tokens int, and, if asked, round_trip: decoding gives the text back.

    `compiled` leaves the merges to a compiled library; ids are the same. Without `keep`, the text doesn't come back from the workers.
    """
    made = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())][: 3 if round_trip else 2]
    if clash := {f.name for f in made} & set(docs.columns):
        raise ValueError(f"docs already has {sorted(clash)}")
    raw = load(docs.sparkSession, vocabulary)
    kept = [f for f in docs.schema.fields if keep or f.name != column]
    schema = T.StructType([*kept, *made])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _parsed(raw.value)
        for whole in batches:
            for at, texts in vec.blocks(whole.column(column)):
                batch = whole.slice(at, len(texts))
                null = batch.column(column).is_null().to_numpy(zero_copy_only=False)
                ids, exact = encode_texts([None if gone else t for gone, t in zip(null, texts, strict=True)], vocab, compiled, round_trip)
                n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int32), mask=null)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), ids, n, *([pa.array(exact, mask=null)] if round_trip else [])], names=schema.names)

    return docs.mapInArrow(run, schema)


def count(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens long in place of the text: as many as `encode` gives, 0 for a null or empty text."""
    if "n_tokens" in docs.columns:
        raise ValueError("docs already has n_tokens")
    raw = load(docs.sparkSession, vocabulary)
    kept = [f for f in docs.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType())])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _parsed(raw.value)
        for batch in batches:
            n = [count_block(texts, vocab, True) for _, texts in vec.blocks(batch.column(column))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, column: str = "token_ids", output: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """tokens with the text of its ids; bytes that aren't UTF-8 become U+FFFD, null stays null."""
    if output in tokens.columns:
        raise ValueError(f"tokens already has {output}")
    raw = load(tokens.sparkSession, vocabulary)
    schema = T.StructType([*tokens.schema.fields, T.StructField(output, T.StringType())])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _parsed(raw.value)
        for batch in batches:
            text = [None if ids is None else vocab.decode(ids).decode("utf-8", "replace") for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, output])

    return tokens.mapInArrow(run, schema)
