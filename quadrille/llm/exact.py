"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

The fingerprint of a byte string b is the pair of sum(b[i] * B ** (n - 1 - i)) modulo two primes, with
its length. Fingerprints compose: H(x + y) = H(x) * B ** len(y) + H(y). A batch of texts is cut into
chunks of CHUNK bytes, all chunks are hashed in one vectorized pass however long a document is, and a
document's chunk hashes are combined by that shift. `combine` does the same over rows in Spark, for a
document that is stored as many chunk rows.

Rows meet by fingerprint in one exchange of the texts. Equal fingerprints only nominate: every text is
compared with its class's first text, chunk by chunk, until the first difference, and a text that
differs (a collision) founds its own class. Before the exchange each task drops copies within its own
batches (verified the same way), so that a text with a million copies sends few of them.

The class's smallest doc_id stays. A null text equals no other and always stays; empty texts are copies
of each other. A null doc_id counts as larger than any other. Rows that repeat a doc_id are copies if
their texts are equal; which of such rows stays is settled by their other columns, then is arbitrary
among rows that are equal throughout. Extra columns pass through; reserved names start with `__fp`.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import vec

CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
U64 = np.uint64


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo prime."""
    out = np.ones(n, U64)
    have = 1
    while have < n:
        step = pow(base, have, prime)
        take = min(have, n - have)
        out[have : have + take] = out[:take] * U64(step) % U64(prime)
        have += take
    return out


_FALLING = [_powers(b, p, CHUNK)[::-1].copy() for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each prime, hashes of the chunks data[start:end], none empty or longer than CHUNK, end to end."""
    size = end - start
    # the power of each byte counts from its chunk's end
    at = np.arange(int(start[0]), int(end[-1])) - np.repeat(end - CHUNK, size)
    body = data[int(start[0]) : int(end[-1])].astype(U64) + U64(1)
    where = start - start[0]
    return [np.add.reduceat(body * falling[at] % U64(p), where) % U64(p) for falling, p in zip(_FALLING, PRIMES, strict=True)]


def fingerprints(data: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
    """For each prime, fingerprints of the texts data[offset[i]:offset[i + 1]]."""
    n = len(offset) - 1
    size = np.diff(offset)
    chunks = -(-size // CHUNK)
    out = [np.zeros(n, U64) for _ in PRIMES]
    if not chunks.sum():
        return out
    doc = np.repeat(np.arange(n), chunks)
    first = np.cumsum(chunks) - chunks
    k = np.arange(len(doc)) - first[doc]
    start = offset[doc] + k * CHUNK
    end = np.minimum(start + CHUNK, offset[doc + 1])
    for which, hashes in enumerate(_in_pieces(data, start, end)):
        p, b = PRIMES[which], BASES[which]
        total = out[which]
        one = chunks == 1
        total[one] = hashes[first[one]]
        shift = pow(b, CHUNK, p)
        for d in np.flatnonzero(chunks > 1).tolist():
            h = 0
            for c in hashes[first[d] : first[d] + chunks[d] - 1].tolist():
                h = (h * shift + c) % p
            last = first[d] + chunks[d] - 1
            total[d] = (h * pow(b, int(end[last] - start[last]), p) + int(hashes[last])) % p
    return out


def _in_pieces(data, start, end, most: int = 1 << 21) -> list[np.ndarray]:
    """chunk_hashes over runs of about `most` bytes, so that scratch arrays stay small."""
    cuts = np.flatnonzero(np.diff((start - start[0]) // most, prepend=-1))
    parts = [chunk_hashes(data, start[a:b], end[a:b]) for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True)]
    return [np.concatenate([x[i] for x in parts]) for i in range(len(PRIMES))]


def combine(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Fingerprints (key, fp long, n_bytes long) of documents stored as chunk rows, in the order of `order`.

    Chunk rows of one document are hashed wherever they lie, each becomes (hash, shift) and only those
    meet: aggregation in Spark folds them as h * shift + hash. Null chunks count as empty.
    """
    schema = T.StructType([T.StructField(key, chunks.schema[key].dataType), T.StructField(order, chunks.schema[order].dataType), *(T.StructField(f"{x}{i}", T.LongType()) for i in range(2) for x in "hs"), T.StructField("n", T.LongType())])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offset = _bytes_of(b.column(text))
            hs = fingerprints(data, offset)
            size = np.diff(offset)
            cols = [b.column(key), b.column(order)]
            for h, base, p in zip(hs, BASES, PRIMES, strict=True):
                cols += [pa.array(h.astype(np.int64)), pa.array([pow(base, s, p) for s in size.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size)], names=schema.names)

    def fold(i: int) -> Column:
        p = PRIMES[i]
        return F.aggregate("__parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[f"s{i}"] + x[f"h{i}"]) % p)

    parts = chunks.select(key, order, text).mapInArrow(run, schema).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "h0", "s0", "h1", "s1"))).alias("__parts"), F.sum("n").alias("n_bytes"))
    return parts.select(key, (fold(0) * F.lit(1 << 31) + fold(1)).alias("fp"), "n_bytes")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, laid end to end, and offsets (null as empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offset


def same_bytes(a: memoryview, b: memoryview) -> bool:
    """Whether two byte strings are equal, compared chunk by chunk until they differ."""
    if len(a) != len(b):
        return False
    return all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _id_key(i):
    return (i is None, i if i is not None else 0)


def _with_fingerprints(docs: DataFrame, column: str, id_column: str, carried: list[str], log_copies: bool) -> DataFrame:
    """`carried` columns of docs with __fp and __fp_copy_of, without local copies or with them as bare rows."""
    fields = [docs.schema[c] for c in carried]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), T.StructField("__fp", T.LongType()), T.StructField("__fp_bytes", T.LongType()), T.StructField("__fp_copy_of", T.LongType()), T.StructField("__fp_copy", T.BooleanType())])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column)
            data, offset = _bytes_of(texts)
            h = fingerprints(data, offset)
            fp = (h[0] << U64(31) | h[1]).astype(np.int64)
            size = np.diff(offset)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            ids = b.column(id_column).to_pylist()
            view = memoryview(data)
            copy = np.zeros(len(fp), bool)
            copy_of: list = [None] * len(fp)
            order = np.lexsort((size, fp))
            f, s = fp[order], size[order]
            edge = np.ones(len(order), bool)
            edge[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
            first = np.flatnonzero(edge)
            last = np.append(first[1:], len(order))
            for a, z in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                rows = sorted((r for r in order[a:z].tolist() if not null[r]), key=lambda r: _id_key(ids[r]))
                for r in rows[1:]:
                    top = rows[0]
                    if ids[r] is not None and ids[r] != ids[top] and same_bytes(view[offset[r] : offset[r + 1]], view[offset[top] : offset[top + 1]]):
                        copy[r], copy_of[r] = True, ids[top]
            cols = [b.column(c) for c in carried]
            if log_copies:  # the text of a local copy isn't sent
                at = carried.index(column)
                cols[at] = pa.compute.if_else(pa.array(copy), pa.scalar(None, texts.type), texts)
            out = pa.RecordBatch.from_arrays([*cols, pa.array(fp), pa.array(size), pa.array(copy_of, pa.int64()), pa.array(copy)], names=schema.names)
            yield out if log_copies else out.filter(pa.array(~copy))

    return docs.select(*carried).mapInArrow(run, schema)


def _classes(rows: DataFrame, column: str, id_column: str, out: T.StructType, emit) -> DataFrame:
    """Streams each fingerprint's rows, smallest id first, and compares each text with its class's first."""
    others = [c for c in rows.columns if not c.startswith("__fp") and c not in (column, id_column) and not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
    # null texts never meet: their rows are spread over all tasks
    spread = F.when(F.col(column).isNull() & ~F.col("__fp_copy"), F.xxhash64(id_column, *others))
    placed = rows.withColumn("__fp_spread", spread).repartition("__fp", "__fp_spread")
    ordered = placed.sortWithinPartitions(F.col("__fp"), F.col("__fp_bytes"), F.col("__fp_copy"), F.col(id_column).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in others)).drop("__fp_spread")

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        of_local: dict = {}
        for b in batches:
            fp = b.column("__fp").to_numpy()
            size = b.column("__fp_bytes").to_numpy()
            data, offset = _bytes_of(b.column(column))
            view = memoryview(data)
            ids = b.column(id_column).to_pylist()
            copy = b.column("__fp_copy").to_numpy(zero_copy_only=False)
            local = b.column("__fp_copy_of").to_pylist()
            null = b.column(column).is_null().to_numpy(zero_copy_only=False)
            n = len(fp)
            edge = np.ones(n + 1, bool)
            edge[1:n] = (fp[1:] != fp[:-1]) | (size[1:] != size[:-1])
            keeper: list = [None] * n
            kept = np.zeros(n, bool)
            alone = edge[:-1] & edge[1:]
            alone[:1] = alone[-1:] = False  # the class may go on in another batch
            kept[alone] = True
            for r in np.flatnonzero(~alone).tolist():
                if (fp[r], size[r]) != key:
                    key, heads, of_local = (fp[r], size[r]), [], {}
                if copy[r]:
                    keeper[r] = of_local.get(local[r], local[r])
                elif null[r]:
                    kept[r] = True
                else:
                    text = view[offset[r] : offset[r + 1]]
                    for head, head_id in heads:
                        if same_bytes(text, head):
                            keeper[r] = head_id
                            break
                    else:
                        heads.append((memoryview(bytes(text)), ids[r]))
                        kept[r] = True
                    of_local[ids[r]] = ids[r] if kept[r] else keeper[r]
            yield from emit(b, kept, keeper)

    return ordered.mapInArrow(run, out)


def copies(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row (doc_id, copy_of) for each row that goes: copy_of is the doc_id that stays."""
    rows = _with_fingerprints(docs, column, id_column, [id_column, column], True)
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("copy_of", T.LongType())])

    def emit(b, kept, keeper):
        gone = pa.array(~kept)
        yield pa.RecordBatch.from_arrays([b.column(id_column).cast(pa.int64()).filter(gone), pa.array(keeper, pa.int64()).filter(gone)], names=out.names)

    return _classes(rows, column, id_column, out, emit)


def drop_copies(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """docs without the rows whose text a row of a smaller doc_id has."""
    if clash := [c for c in docs.columns if c.startswith("__fp")]:
        raise ValueError(f"reserved column names: {clash}")
    columns = docs.columns
    rows = _with_fingerprints(docs, column, id_column, columns, False)

    def emit(b, kept, keeper):
        yield b.select(columns).filter(pa.array(kept))

    return _classes(rows, column, id_column, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]), emit)


def duckdb_sql(table: str = "documents") -> str:
    return f"""
SELECT doc_id, first_id AS copy_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth
  FROM {table} WHERE text IS NOT NULL) WHERE nth > 1"""
