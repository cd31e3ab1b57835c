"""N-gram Jaccard self-join by adaptive multi-match prefixes.

A text's set is its word n-grams (words are runs of letters and numbers, in lower case), each kept as a
48-bit hash. All sets share one token order: rare before frequent, then by hash. Frequencies are summed over
the whole corpus from windows of WINDOW_TOKENS tokens, each of which reports what it repeats; the HEAVY
most frequent tokens carry their counts, others count as rare (this guides the order only, any order is right). With |x| tokens and threshold t, two sets of Jaccard t or more share at least
l tokens among their first |x| - ceil(t |x|) + l: the l-prefix. Each document picks its own l: a longer
prefix costs more postings, but candidates must then share l tokens, so fewer are verified. The cost of
l is estimated from those counts: S postings met, and at most S / l candidates of that many matches, each
`VERIFY` times a posting. A pair needs min(l_a, l_b) shared prefix tokens, then the sets are intersected.

Documents of equal sets are one class representative, the smallest doc_id, which alone sends tokens. Exchanges:
packed blocks of prefix entries by token bucket, each set once from every task; posting lists by a leading member, so that
the lists of a group of near copies meet, a large group in cells of a grid; sets of candidates only, by cells of at most about
CELL_PAIRS pairs and CELL_TOKENS tokens. Each cell gives what it found in a row or two for each of its sets (links counted, and the
group within the cell), so that groups of any size leave a task without all their pairs. No list, partner or candidate is capped.

Results. `classes`: (doc_id, class_id, links) for each document with a link: a link is another document whose set reaches the
threshold, copies included and counted one by one; class_id is the smallest doc_id that links lead to. `pairs`: (doc_a, doc_b, jaccard), doc_a < doc_b,
between representatives, and each other document of a set with its representative. Null texts, texts without words and rows
with a null doc_id have no links. A text of fewer than n words is one shorter gram. Rows that repeat a doc_id and text count once;
a doc_id of several texts has the links of each of them, is in one class, and isn't paired with itself in `pairs`. Texts are hashed whole whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import vec
from quadrille.llm.common import forget, written
from quadrille.operators.graph import components

U64 = np.uint64
N, THRESHOLD = 3, 0.5
WINDOW_TOKENS, HEAVY = 4_000_000, 2_000_000
LONGEST, VERIFY = 8, 40.0
BUCKET_ENTRIES = 1_500_000
BROADCAST_ROWS = 500_000  # of 32 bytes; beyond that a shuffle join
LIST_PAIRS = 8_000_000  # of one leader's lists in one task
CELL_PAIRS, CELL_TOKENS = 50_000, 2_000_000
FILTER_BITS = 1 << 26
TOKEN, SHORT = U64((1 << 48) - 1), U64((1 << 40) - 1)


def token_sets(texts: pa.Array | list[str | None], n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, each text's offset, and tokens, sorted within each text."""
    for at, run in vec.blocks(texts):
        cps, starts = vec.code_points(run)
        low, begin, end = vec.words(cps)
        own = vec.owner(starts, begin)
        words = np.bincount(own, minlength=len(run)) if len(own) else np.zeros(len(run), np.int64)
        h = vec.Prefix(low).span(begin, end)
        gram = h.copy()
        live = np.ones(len(h), bool)
        with np.errstate(over="ignore"):
            for k in range(1, n):
                same = np.zeros(len(h), bool)
                same[:-k or None] = own[k:] == own[: len(own) - k] if len(own) > k else False
                step = gram * U64(0x9E3779B97F4A7C15)
                step[:-k or None] += h[k:] if len(own) > k else U64(0)
                # a text of fewer than n words: its first word gathers what there is
                gram = np.where(same, step, gram * U64(0x2545F4914F6CDD1D))
                live &= same
        first = np.cumsum(words) - words
        short = (words > 0) & (words < n)
        live[first[short]] = True
        gram, own = vec.mix(gram[live]), own[live]
        # one sort by text and token; blocks hold fewer than 2**16 texts at a time
        parts, sizes = [], []
        for a in range(0, len(run), 1 << 16):
            lo, hi = np.searchsorted(own, [a, a + (1 << 16)])
            key = (own[lo:hi] - a).astype(U64) << U64(48) | (gram[lo:hi] & TOKEN)
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            parts.append(key & TOKEN)
            sizes.append(np.bincount((key >> U64(48)).astype(np.int64), minlength=min(len(run) - a, 1 << 16)))
        offset = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        yield at, offset, np.concatenate(parts)


def set_keys(offset: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A key of each set: 61 bits, then three zero bits that prefix entries use for l - 1 (0 for an empty set)."""
    total = np.zeros(len(tokens) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(vec.mix(tokens ^ U64(0x5851F42D4C957F2D)), out=total[1:])
        key = vec.mix(total[offset[1:]] - total[offset[:-1]] + np.diff(offset).astype(U64))
    key &= ~U64(7)
    return np.where(np.diff(offset) > 0, np.where(key == 0, U64(8), key), U64(0))


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: (doc_id, key, size), and (token, count) of tokens that a window of documents repeats."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("token", T.LongType()), T.StructField("count", T.IntegerType())])

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        token = np.concatenate(held)
        held.clear()
        token.sort()
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(edge, len(token)))
        token, count = token[edge[count > 1]], count[count > 1]
        none = pa.nulls(len(token))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], names=schema.names)

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            ids = b.column("doc_id")
            for at, offset, tokens in token_sets(b.column("text"), n):
                size = np.diff(offset)
                real = ids.slice(at, len(size)).is_valid().to_numpy(zero_copy_only=False) & (size > 0)
                key = set_keys(offset, tokens).view(np.int64)
                none = pa.nulls(int(real.sum()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(size)).cast(pa.int64()).filter(pa.array(real)), pa.array(key[real]), pa.array(size[real].astype(np.int32)), none.cast(pa.int64()), none.cast(pa.int32())], names=schema.names)
                held.append(tokens)
                total += len(tokens)
                if total > WINDOW_TOKENS:
                    yield repeated(held)
                    held, total = [], 0
        if total:
            yield repeated(held)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Frequent:
    """Counts of the most frequent tokens, at most HEAVY of them; all others count as rare."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order].astype(np.float64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.tokens >> U64(26)).astype(np.int64)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens))
        if len(self.tokens):
            some = np.flatnonzero(self.maybe[(tokens >> U64(26)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.tokens, tokens[some]), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens[some]
            out[some[hit]] = self.counts[at[hit]]
        return out


def _frequent(survey: DataFrame) -> Frequent:
    """Sums the windows' counts; the driver gets at most HEAVY tokens (16 bytes each), the most frequent ones."""
    sums = written(survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).where("count >= 4"), "near-counts")
    level = F.floor(F.log2("count") * 4).cast("int")
    least, total = 8, 0
    for r in sorted(sums.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        total += r["n"]
        if total > HEAVY:
            break
        least = r["level"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().tobytes()], pa.binary())], names=["tokens", "counts"])

    rows = sums.where(level >= least).mapInArrow(pack, "tokens binary, counts binary").collect()
    forget(sums)
    return Frequent(np.concatenate([np.zeros(0, U64), *(np.frombuffer(r[0], U64) for r in rows)]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[1], np.int64) for r in rows)]))


def prefixes(offset: np.ndarray, tokens: np.ndarray, frequent: Frequent, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's l, the index of the set of each prefix token, and those tokens."""
    size = np.diff(offset)
    freq = frequent.of(tokens)
    rank = np.clip(np.log2(freq) * 4, 0, 255).astype(U64)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.argsort((doc.astype(U64) << U64(48)) | (rank << U64(40)) | (tokens & SHORT))
    shortest = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    met = np.zeros(len(tokens) + 1)
    np.cumsum(freq[order], out=met[1:])
    lengths = np.minimum(shortest[:, None] + np.arange(LONGEST), size[:, None])
    postings = met[offset[:-1, None] + lengths] - met[offset[:-1], None]
    asked = np.arange(1, LONGEST + 1)
    cost = postings * (1 + VERIFY / asked)
    cost[shortest[:, None] + asked - 1 > size[:, None]] = np.inf
    cost[:, 0] = np.where(size > 0, postings[:, 0] * (1 + VERIFY), 0)
    ell = cost.argmin(1) + 1
    take = np.where(size > 0, lengths[np.arange(len(size)), ell - 1], 0)
    first = np.arange(len(tokens)) - np.repeat(offset[:-1], size) < np.repeat(take, size)
    return ell, doc[first], tokens[order][first]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, all lowest bytes first: bytes that agree lie together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :width] = x.T
    return out.view("<u8").reshape(-1)


def _entries(docs: DataFrame, counts, buckets: int, n: int, threshold: float) -> DataFrame:
    """Packed prefix entries (bucket, tokens, keys, repeats): each set's key once, before its run of tokens.

    A task sends a set once, however many of its documents have it (8 bytes are kept for each set of the task)."""

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = counts.value, np.zeros(0, U64)
        for b in batches:
            real_ids = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for at, offset, tokens in token_sets(b.column("text"), n):
                size, key = np.diff(offset), set_keys(offset, tokens)
                able = np.flatnonzero(real_ids[at : at + len(key)] & (key != 0))
                names, first = np.unique(key[able], return_index=True)
                if len(seen):
                    fresh = seen[np.minimum(np.searchsorted(seen, names), len(seen) - 1)] != names
                    names, first = names[fresh], first[fresh]
                if not len(names):
                    continue
                keep = np.zeros(len(key), bool)
                keep[able[first]] = True
                seen = np.concatenate([seen, names])
                seen.sort()
                tokens, key, offset = tokens[np.repeat(keep, size)], key[keep], np.concatenate([[0], np.cumsum(size[keep])])
                ell, doc, token = prefixes(offset, tokens, frequent, threshold)
                key = key | (ell - 1).astype(U64)
                token = token & SHORT
                bucket = (vec.mix(token) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # a set's entries stay together
                bucket, token, doc = bucket[order], token[order], doc[order]
                edge = np.ones(len(bucket), bool)
                edge[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
                run_at = np.flatnonzero(edge)
                run_size = np.diff(np.append(run_at, len(bucket)))
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cut[1:], len(bucket))
                ra, rz = np.searchsorted(run_at, cut), np.searchsorted(run_at, ends)
                keys = key[doc[run_at]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[cut].astype(np.int32)),
                    pa.array([_planes(token[x:y], 5) for x, y in zip(cut, ends, strict=True)], pa.binary()),
                    pa.array([_planes(keys[x:y], 8) for x, y in zip(ra, rz, strict=True)], pa.binary()),
                    pa.array([_planes(run_size[x:y], 4) for x, y in zip(ra, rz, strict=True)], pa.binary()),
                ], names=["bucket", "tokens", "keys", "repeats"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, tokens binary, keys binary, repeats binary")


def _postings(entries: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Lists of two or more sets that share a prefix token: (leader, members as keys), and (key, home) of leaders that hand over."""

    def lists(tokens: list[bytes], keys: list[bytes], repeats: list[bytes]) -> pa.RecordBatch:
        token = np.concatenate([_unplanes(x, 5) for x in tokens])
        key = np.concatenate([np.repeat(_unplanes(k, 8), _unplanes(r, 4).astype(np.int64)) for k, r in zip(keys, repeats, strict=True)])
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key = token[fresh], key[fresh]
        cut = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(cut, len(token)))
        cut, size = cut[size > 1], size[size > 1]
        offset = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(cut - offset[:-1], size) + np.arange(offset[-1])
        return pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.LargeListArray.from_arrays(pa.array(offset, pa.int64()), pa.array(key[at].view(np.int64))).cast(pa.list_(pa.int64()))], names=["leader", "members"])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, ([], [], [])
        for b in batches:
            for bucket, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != current:
                    if held[0]:
                        yield lists(*held)
                    current, held = bucket, ([], [], [])
                for x, y in zip(held, packed, strict=True):
                    x.append(y)
        if held[0]:
            yield lists(*held)

    raw = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "leader long, members array<long>")
    lists_ = written(raw, "near-lists")
    # lists of one group of near copies should meet: a leader hands over to the smallest leader it shares a list with
    seen = lists_.select("leader", F.explode("members").alias("key")).groupBy("key").agg(F.min("leader").alias("home"))
    return lists_, written(lists_.select(F.col("leader").alias("key")).distinct().join(seen, "key").where("home <> key"), "near-homes")


def _checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def _pair_places(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j < m, at most about a million at a time."""
    step = max(1, 1_000_000 // m)
    for lo in range(0, m - 1, step):
        i = np.arange(lo, min(lo + step, m - 1))
        reps = m - 1 - i
        j = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(i + 1, reps)
        yield np.repeat(i, reps), j


def list_codes(flat: np.ndarray, wide: int, at: np.ndarray, size: np.ndarray, split: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs x < y as x * wide + y, some at a time: within each list, or between its first `split` members and the others."""
    for m in np.unique(size[split == 0]).tolist():  # lists of one length at a time, as a matrix
        starts = at[(size == m) & (split == 0)]
        for i, j in _pair_places(m):
            step = max(1, 1_000_000 // len(i))
            for s in range(0, len(starts), step):
                rows = starts[s : s + step, None]
                yield (flat[rows + i] * wide + flat[rows + j]).ravel()
    for k in np.flatnonzero(split).tolist():
        left, right = flat[at[k] : at[k] + split[k]], flat[at[k] + split[k] : at[k] + size[k]]
        step = max(1, 1_000_000 // len(right))
        for s in range(0, len(left), step):
            x, y = left[s : s + step, None], right[None]
            yield (np.minimum(x, y) * wide + np.maximum(x, y)).ravel()


def grid(members: np.ndarray, cut: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """A list in cells: (cell, members, split), so that each pair of the list is in one cell, which depends on the pair alone."""
    part = (vec.mix(members & ~U64(7)) % U64(cut)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    groups = np.split(members[order], np.searchsorted(part[order], np.arange(1, cut)))
    for x in range(cut):
        if len(groups[x]) > 1:
            yield x * cut + x, np.sort(groups[x]), 0
        for y in range(x + 1, cut):
            if len(groups[x]) and len(groups[y]):
                yield x * cut + y, np.concatenate([groups[x], groups[y]]), len(groups[x])


def _counted(lists_: DataFrame, homes: DataFrame) -> DataFrame:
    """(a, b, block): pairs of set keys that share min(l_a, l_b) prefix tokens, and a leader of theirs."""
    schema = "leader long, cell long, split int, members array<long>"
    postings = lists_.join(_checked(homes), lists_["leader"] == homes["key"], "left").select(F.coalesce("home", "leader").alias("leader"), "members")
    work = postings.groupBy("leader").agg(F.sum(F.pow(F.size("members").cast("double"), 2) / 2).alias("pairs")).where(F.col("pairs") > LIST_PAIRS)
    large = written(work.select(F.col("leader").alias("large"), F.ceil(F.sqrt(2 * F.col("pairs") / LIST_PAIRS)).cast("int").alias("cut")), "near-leaders")
    known = _checked(large, 100_000)

    @vec.tidy
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leader, cut, members in zip(b.column("leader").to_pylist(), b.column("cut").to_pylist(), b.column("members"), strict=True):
                rows = list(grid(members.values.to_numpy().view(U64), cut))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([leader] * len(rows)), pa.array([c for c, _, _ in rows]), pa.array([s for _, _, s in rows], pa.int32()), pa.array([m.view(np.int64) for _, m, _ in rows], pa.list_(pa.int64()))], names=["leader", "cell", "split", "members"])

    plain = postings.join(known, postings["leader"] == known["large"], "left_anti").select("leader", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("split"), "members")
    hot = postings.join(known, postings["leader"] == known["large"]).select("leader", "cut", "members").mapInArrow(cells, schema)

    def emit(leader: int, known: np.ndarray, code: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        return [known[code // len(known)], known[code % len(known)], count.astype(np.int64), np.full(len(code), leader)]

    def counts(leader: int, known: np.ndarray, codes: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
        dense = np.zeros(len(known) ** 2, np.int32) if len(known) <= 2048 else None
        held, total = [], 0

        def settle():
            code = np.concatenate(held)
            if dense is not None and 4 * len(code) >= len(dense):
                dense[:] += np.bincount(code, minlength=len(dense))
                return None
            code, count = np.unique(code, return_counts=True)
            if dense is None:
                return emit(leader, known, code, count)
            dense[code] += count
            return None

        for c in codes:
            held.append(c)
            total += len(c)
            if total > 2_000_000:
                if (out := settle()) is not None:
                    yield out
                held, total = [], 0
        if held and (out := settle()) is not None:
            yield out
        if dense is not None:
            code = np.flatnonzero(dense)
            yield emit(leader, known, code, dense[code])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(4)], names=["a", "b", "n", "block"])

        for batch in batches:
            members = batch.column("members")
            leaders, cells_, split = (batch.column(c).to_numpy() for c in ("leader", "cell", "split"))
            ends = members.offsets.to_numpy()
            flat_all = members.values.to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (leaders[1:] != leaders[:-1]) | (cells_[1:] != cells_[:-1])]))
            stop = np.append(cut[1:], len(leaders))
            small = cut[(stop - cut == 1) & (ends[cut + 1] - ends[cut] == 2)]  # most leaders: one list of two
            if len(small):
                at = ends[small]
                a, b = flat_all[at], flat_all[at + 1]
                out.append([np.minimum(a, b), np.maximum(a, b), np.ones(len(at), np.int64), leaders[small]])
                rows += len(small)
            rest = ~np.isin(cut, small)
            for lo, hi in zip(cut[rest].tolist(), stop[rest].tolist(), strict=True):
                known, flat = np.unique(flat_all[ends[lo] : ends[hi]], return_inverse=True)
                for found in counts(leaders[lo], known, list_codes(flat.astype(np.int64), len(known), ends[lo:hi] - ends[lo], np.diff(ends[lo : hi + 1]), split[lo:hi])):
                    out.append(found)
                    rows += len(found[0])
                    if rows > 200_000:
                        yield flush()
                        out, rows = [], 0
        if out:
            yield flush()

    near = plain.union(hot).repartition("leader", "cell").sortWithinPartitions("leader", "cell").mapInArrow(run, "a long, b long, n long, block long")
    shared = near.groupBy("a", "b").agg(F.sum("n").alias("shared"), F.min("block").alias("block"))
    asked = F.least(F.col("a").bitwiseAND(7), F.col("b").bitwiseAND(7)) + 1
    return shared.where(F.col("shared") >= asked).select(F.col("a").bitwiseAND(-8).alias("a"), F.col("b").bitwiseAND(-8).alias("b"), "block")


def _placed(candidates: DataFrame, speakers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, a, b) of all candidates; (cell, key, speaker, n, size) of the sets that a cell needs."""
    needed = candidates.select("block", F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = written(needed.join(speakers, "key"), "near-sets")
    blocks = candidates.groupBy("block").agg(F.count("*").alias("pairs")).join(sets.groupBy("block").agg(F.sum("size").alias("tokens"), F.count("*").alias("sets")), "block")
    cut = F.least(F.col("sets"), F.greatest(F.ceil(F.sqrt(F.col("pairs") / CELL_PAIRS)), F.ceil(2 * F.col("tokens") / CELL_TOKENS)))
    large = written(blocks.where((F.col("pairs") > CELL_PAIRS) | (F.col("tokens") > CELL_TOKENS)).select("block", cut.cast("int").alias("cut")), "near-blocks")
    known = _checked(large, 100_000)

    def part(key: str):
        return F.when(F.col("cut").isNotNull(), F.pmod(F.xxhash64(key), F.col("cut")))

    pairs = candidates.join(known, "block", "left").select("block", F.xxhash64("block", part("a"), part("b")).alias("cell"), "a", "b", "cut")
    whole = sets.join(known, "block", "left_anti").select(F.xxhash64("block", F.lit(None).cast("long"), F.lit(None).cast("long")).alias("cell"), "key", "speaker", "n", "size")
    split = pairs.where("cut IS NOT NULL").select("block", "cell", F.explode(F.array("a", "b")).alias("key")).distinct().join(sets, ["block", "key"]).select("cell", "key", "speaker", "n", "size")
    return pairs.select("cell", "a", "b"), written(whole.union(split), "near-wanted")


def _sets_of(docs: DataFrame, wanted: DataFrame, many: bool, n: int) -> DataFrame:
    """(cell, key, speaker, n, tokens) of the wanted sets, from the texts of their speakers."""
    sc = docs.sparkSession.sparkContext
    names = ["cell", "key", "speaker", "n", "tokens"]

    def packed(columns: list[str]) -> list[np.ndarray]:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().tobytes()], pa.binary()) for c in columns], names=columns)

        rows = wanted.select(*columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).collect()
        return [np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[k], np.int64) for r in rows)]) for k in range(len(columns))]

    def rows_of(b: pa.RecordBatch, able: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Ids, keys and packed tokens of the rows in `able`."""
        b = b.filter(pa.array(able & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
        ids = b.column("doc_id").to_numpy()
        for at, offset, tokens in token_sets(b.column("text"), n):
            key = set_keys(offset, tokens).view(np.int64)
            yield ids[at : at + len(key)], key, offset, tokens

    def planes(offset: np.ndarray, tokens: np.ndarray, pick: np.ndarray) -> pa.Array:
        return pa.array([_planes(tokens[offset[i] : offset[i + 1]], 6) for i in pick.tolist()], pa.binary())

    if not many:
        cell, key, speaker, count = packed(["cell", "key", "speaker", "n"])
        order = np.argsort(key, kind="stable")
        table = sc.broadcast([x[order] for x in (key, cell, speaker, count)])
        ids = sc.broadcast(np.unique(speaker))

        @vec.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names_, cell, speaker, count = table.value
            for b in batches:
                able = np.isin(b.column("doc_id").fill_null(-1).to_numpy(), ids.value)
                for doc, key, offset, tokens in rows_of(b, able):
                    lo = np.searchsorted(names_, key, "left")
                    times = np.where(key != 0, np.searchsorted(names_, key, "right") - lo, 0)
                    text = np.repeat(np.arange(len(key)), times)
                    row = np.repeat(lo, times) + np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
                    speaks = speaker[row] == doc[text]
                    text, row = text[speaks], row[speaks]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[row]), pa.array(key[text]), pa.array(doc[text]), pa.array(count[row]), planes(offset, tokens, text)], names=names)

        return docs.mapInArrow(run, "cell long, key long, speaker long, n long, tokens binary")

    # too many for a table in every task: a filter of FILTER_BITS bits (8 MB at most) lets most others go, a join does the rest
    bit = F.pmod(F.xxhash64("speaker"), F.lit(FILTER_BITS)) + 1
    pages = wanted.groupBy(F.bitmap_bucket_number(bit).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in pages:
        raw = np.frombuffer(r["bits"], np.uint8)
        bits[(r["page"] - 1) * 4096 :][: len(raw)] = raw
    sent = sc.broadcast(bits)

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            at = b.column("bit").to_numpy()
            for doc, key, offset, tokens in rows_of(b, (bits[(at - 1) // 32768 * 4096 + (at - 1) % 32768 // 8] >> ((at - 1) % 8) & 1).astype(bool)):
                pick = np.flatnonzero(key != 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(doc[pick]), planes(offset, tokens, pick)], names=["key", "speaker", "tokens"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    sets = docs.select("doc_id", "text", place.alias("bit")).mapInArrow(run, "key long, speaker long, tokens binary")
    return sets.join(wanted, ["key", "speaker"]).select(*names)


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens each pair of sets shares: by a sort for few pairs, else by rows of bits, some columns at a time."""
    size = np.array([len(x) for x in sets])
    if len(a) <= 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    edge = np.concatenate([[True], flat[1:] != flat[:-1]])
    df = np.diff(np.append(np.flatnonzero(edge), len(flat)))
    del flat, order
    live = np.repeat(df > 1, df)  # only tokens of two sets or more can count
    column, row = np.repeat(np.cumsum(df > 1) - 1, df)[live], row[live]
    width = int(column[-1]) + 1 if len(column) else 0
    both = np.zeros(len(a), np.int64)
    step = max(64, (8_000_000 // len(size)) & ~63)
    for c in range(0, width, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        wide = -(-min(step, width - c) // 64) * 64
        ones = np.zeros((len(size), wide), bool)
        ones[row[lo:hi], column[lo:hi] - c] = True
        bits = np.packbits(ones, axis=1).view(U64)
        del ones
        some = max(1, 500_000 // bits.shape[1])
        for p in range(0, len(a), some):
            both[p : p + some] += np.bitwise_count(bits[a[p : p + some]] & bits[b[p : p + some]]).sum(1, dtype=np.int64)
    return both


def joined(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of m places the smallest place that pairs lead to."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


PAIRS = "doc_a long, doc_b long, jaccard double"
LINKS = "key long, node long, root long, links long"


def _verified(docs: DataFrame, candidates: DataFrame, speakers: DataFrame, n: int, threshold: float, schema: str) -> DataFrame:
    """Candidate pairs (a, b, block) of set keys whose sets reach the threshold: as PAIRS of speakers, or as LINKS, summed up in each cell:
    the documents that a set is linked to there, and a speaker `root` for each of the cell's groups."""
    pairs, wanted = _placed(candidates, speakers)
    there = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
    sets = _sets_of(docs, wanted, there["rows"] > BROADCAST_ROWS, n)
    rows = sets.select("cell", "key", "speaker", "n", F.lit(None).cast("long").alias("other"), "tokens").union(pairs.select("cell", "a", F.lit(None).cast("long"), F.lit(None).cast("long"), "b", F.lit(None).cast("binary")))

    def judge(keys: np.ndarray, speaker: np.ndarray, count: np.ndarray, sets: list[bytes], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        key, first = np.unique(keys, return_index=True)  # a repeated row sends its set again
        unpacked = [_unplanes(sets[i], 6) for i in first.tolist()]
        speaker, count = speaker[first], count[first]
        size = np.array([len(x) for x in unpacked])
        ia, ib = np.searchsorted(key, a), np.searchsorted(key, b)
        both = overlaps(unpacked, ia, ib).astype(np.float64)
        jaccard = both / (size[ia] + size[ib] - both)
        good = jaccard >= threshold - 1e-12
        ia, ib, jaccard = ia[good], ib[good], jaccard[good]
        if schema == PAIRS:
            return [np.minimum(speaker[ia], speaker[ib]), np.maximum(speaker[ia], speaker[ib]), jaccard]
        links = np.bincount(ia, weights=count[ib], minlength=len(key)) + np.bincount(ib, weights=count[ia], minlength=len(key))
        some = np.flatnonzero(links)
        return [key[some], speaker[some], speaker[joined(len(key), ia, ib)][some], links[some].astype(np.int64)]

    @vec.tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        current, held, out, rows = None, [], [], 0

        def settle() -> None:
            nonlocal rows
            a, b = (np.concatenate([h[k] for h in held]) for k in (4, 5))
            if len(a):
                out.append(judge(*(np.concatenate([h[k] for h in held]) for k in range(3)), [x for h in held for x in h[3]], a, b))
                rows += len(out[-1][0])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(len(names))], names=names)

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            pair = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
            key, speaker, count, other = (batch.column(c).fill_null(0).to_numpy() for c in ("key", "speaker", "n", "other"))
            tokens = batch.column("tokens")
            cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sets_before = np.concatenate([[0], np.cumsum(~pair)])
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True):
                if cell[lo] != current:
                    if held:
                        settle()
                    current, held = cell[lo], []
                    if rows > 200_000:
                        yield flush()
                        out, rows = [], 0
                sets_to = lo + int(sets_before[hi] - sets_before[lo])  # sets come before pairs
                held.append((key[lo:sets_to], speaker[lo:sets_to], count[lo:sets_to], tokens.slice(lo, sets_to - lo).to_pylist(), key[sets_to:hi], other[sets_to:hi]))
        if held:
            settle()
        if out:
            yield flush()

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(there["tokens"] / CELL_TOKENS))
    return rows.repartition(tasks, "cell").sortWithinPartitions("cell", F.col("other").asc_nulls_first()).mapInArrow(check, schema)


def _judged(docs: DataFrame, n: int, threshold: float, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key), each once; (key, speaker, n, size) of the sets; and what `_verified` finds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = written(_survey(docs, n), "near-survey")
    counts = docs.sparkSession.sparkContext.broadcast(_frequent(survey))
    members = survey.where("key IS NOT NULL").select("doc_id", "key", "size").distinct()
    # equal sets count as one, whose smallest doc_id speaks for it
    speakers = written(members.groupBy("key").agg(F.min("doc_id").alias("speaker"), F.count("*").alias("n"), F.first("size").cast("long").alias("size")), "near-speakers")
    total = speakers.agg(F.sum(F.floor(F.col("size") * (1 - threshold)) + 1)).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_ENTRIES))
    lists_, homes = _postings(_entries(docs, counts, buckets, n, threshold), buckets)
    candidates = written(_counted(lists_, homes), "near-candidates")
    forget(lists_, homes)
    counts.unpersist()
    return members.select("doc_id", "key"), speakers, _verified(docs, candidates, speakers, n, threshold, schema)


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard) between the representatives of classes of equal sets, and from each to the other documents of its class."""
    members, speakers, across = _judged(docs, n, threshold, PAIRS)
    within = members.join(speakers.where("n > 1"), "key").where("doc_id > speaker").select(F.col("speaker").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return across.where("doc_a < doc_b").union(within).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of all documents with a link to another."""
    members, speakers, across = _judged(docs, n, threshold, LINKS)
    found = written(across, "near-links")
    several = members.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    bound = several.join(members, "doc_id").join(speakers, "key").select(F.col("speaker").alias("node"), F.col("doc_id").alias("root"))
    group = written(components(found.select("node", "root").union(bound).where("node <> root").distinct(), "node", "root"), "near-groups")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = speakers.join(links, "key", "left").join(group, F.col("speaker") == F.col("node"), "left")
    sets = linked.select("key", F.coalesce("component", "speaker").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")).where("links > 0")
    return members.join(sets, "key").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the smallest doc_id."""
    gone = written(classes(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("__near_gone")), "near-gone")
    inside = _checked(gone, 4 * BROADCAST_ROWS)
    return docs.join(inside, docs["doc_id"] == inside["__near_gone"], "left_anti")


def duckdb_sql(table: str = "documents", n: int = N, threshold: float = THRESHOLD) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END)) AS g FROM words WHERE len(w) > 0),
grams AS (SELECT doc_id, len(g) AS size, unnest(g) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.size) AS p, any_value(b.size) AS q FROM grams a JOIN grams b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING CAST(count(*) AS DOUBLE) / (any_value(a.size) + any_value(b.size) - count(*)) >= {threshold}),
led AS (SELECT x, y FROM links UNION SELECT led.x, links.y FROM led JOIN links ON led.y = links.x)
SELECT x AS doc_id, least(x, low) AS class_id, links FROM (SELECT x, CAST(count(*) AS BIGINT) AS links FROM links GROUP BY x) JOIN (SELECT x, min(y) AS low FROM led GROUP BY x) USING (x)"""
