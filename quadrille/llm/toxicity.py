"""Toxic spans by a linear-chain conditional random field.

Training. A bounded sample of labelled documents gives features: at most `sample` of each label among those of at most `longest` characters,
smallest hashes first (parameters of `fit`, SAMPLE and LONGEST; longer labelled documents don't train, but are tagged like all others). Features are words and word beginnings of 4, 5
and 6 characters that toxic documents hold far more often than clean ones (log-likelihood ratio and
ratio of document rates). Tokens that bear such a feature in toxic documents are the positive token labels, all
tokens of clean documents negative ones. The field has two states, a weight for each feature, a bias and
transition weights; they maximize the penalized likelihood of windows of labelled tokens: WINDOW tokens long, or what
is left at a document's end (the whole of a short one), with the places beyond masked. At most `windows` of them train
(WINDOWS; half with a toxic token, as far as there are any, drawn at random).

Tagging. Forward and backward messages give each token's marginal over its whole document: documents
are laid out as segments of STEP tokens, segments' transfer matrices are multiplied in parallel, a short
scan links the segments of a document, and a second pass fills in the messages, so the result is exact
for texts of any length. A document's score is its greatest marginal, `toxic_tokens` the expected number
of toxic tokens, and spans are runs of tokens whose marginal is THRESHOLD or more, as character offsets.

Results: one row for each document with a span. Null or empty texts have none; a null doc_id is kept as
null; repeated rows are tagged one by one. Without toxic labels the model has no features and nothing is
tagged. Null labels are left out of training; if a doc_id has several labels, any toxic one counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import vec

SAMPLE, LONGEST = 1000, 20_000
BEGINNINGS = (4, 5, 6)
MIN_RATE, MIN_RATIO, MIN_G2, MAX_FEATURES = 0.01, 20.0, 18.0, 20_000
WINDOW, WINDOWS, ROUNDS, PENALTY = 48, 6000, 80, 1e-3
STEP, THRESHOLD = 128, 0.5
U64 = np.uint64


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    trans: np.ndarray  # log weights [from, to]

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.features & U64(0xFFFF)).astype(np.int64)] = True


def tokens(texts: list[str]):
    """For a block: start and end of each token in the block, its text, texts' starts, and feature hashes by kind."""
    cps, starts = vec.code_points(texts)
    low, begin, end = vec.words(cps)
    prefix = vec.Prefix(low)
    kinds = [prefix.span(begin, end)]
    for k in BEGINNINGS:
        h = prefix.span(begin, np.minimum(begin + k, end)) ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        kinds.append(np.where(end - begin >= k, h, U64(0)))
    return begin, end, vec.owner(starts, begin), starts, kinds


def emissions(kinds: list[np.ndarray], model: Model) -> np.ndarray:
    """Each token's log odds of the toxic state, before its neighbours are heard."""
    out = np.full(len(kinds[0]), model.bias)
    if len(model.features):
        for h in kinds:
            maybe = np.flatnonzero(model.seen[(h & U64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(model.features, h[maybe]), len(model.features) - 1)
            hit = model.features[at] == h[maybe]
            out[maybe[hit]] += model.weights[at[hit]]
    return out


def marginals(emission: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token given its whole document; `doc` is sorted."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    a = np.exp(trans - trans.max())
    first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    size = np.diff(np.append(first, n))
    segs = -(-size // STEP)
    seg0 = np.cumsum(segs) - segs
    rank = np.arange(n) - np.repeat(first, size)
    row, col = np.repeat(seg0, size) + rank // STEP, rank % STEP
    total = int(segs.sum())
    # e[1] / e[0] of each step; padding steps pass messages on unchanged
    odds = np.zeros((STEP, total))
    odds[col, row] = np.exp(np.clip(emission, -50, 50))
    real = np.zeros((STEP, total), bool)
    real[col, row] = True
    opening = np.zeros(total, bool)
    opening[seg0] = True

    def step(v0, v1, t):
        """Row vector times the matrix of step t, of which a document's first has no transition."""
        w0, w1 = v0 * a[0, 0] + v1 * a[1, 0], (v0 * a[0, 1] + v1 * a[1, 1])
        if t == 0:
            w0, w1 = np.where(opening, v0, w0), np.where(opening, v1, w1)
        w1 = w1 * odds[t]
        scale = 1 / (w0 + w1)
        return np.where(real[t], w0 * scale, v0), np.where(real[t], w1 * scale, v1)

    def back(b0, b1, t):
        """Matrix of step t times a column vector."""
        x1 = b1 * odds[t]
        w0, w1 = a[0, 0] * b0 + a[0, 1] * x1, a[1, 0] * b0 + a[1, 1] * x1
        if t == 0:
            w0, w1 = np.where(opening, b0, w0), np.where(opening, x1, w1)
        scale = 1 / (w0 + w1)
        return np.where(real[t], w0 * scale, b0), np.where(real[t], w1 * scale, b1)

    # products of the segments' matrices (rows up to one common factor each: both rows are carried with theirs)
    p = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    if total > len(first):
        for t in range(STEP):
            nxt = []
            for r in (0, 2):
                w0, w1 = p[r] * a[0, 0] + p[r + 1] * a[1, 0], p[r] * a[0, 1] + p[r + 1] * a[1, 1]
                if t == 0:
                    w0, w1 = np.where(opening, p[r], w0), np.where(opening, p[r + 1], w1)
                nxt += [np.where(real[t], w0, p[r]), np.where(real[t], w1 * odds[t], p[r + 1])]
            scale = 1 / (nxt[0] + nxt[1] + nxt[2] + nxt[3])
            p = [x * scale for x in nxt]
    f0, f1 = np.full(total, 0.5), np.full(total, 0.5)
    b0, b1 = np.full(total, 0.5), np.full(total, 0.5)
    most = int(segs.max())
    for k in range(1, most):  # messages at the segments' borders, one segment of every document at a time
        s = seg0[segs > k] + k
        q = s - 1
        w0, w1 = f0[q] * p[0][q] + f1[q] * p[2][q], f0[q] * p[1][q] + f1[q] * p[3][q]
        f0[s], f1[s] = w0 / (w0 + w1), w1 / (w0 + w1)
    last = seg0 + segs - 1
    for k in range(1, most):
        s = last[segs > k] - k
        q = s + 1
        w0, w1 = p[0][q] * b0[q] + p[1][q] * b1[q], p[2][q] * b0[q] + p[3][q] * b1[q]
        b0[s], b1[s] = w0 / (w0 + w1), w1 / (w0 + w1)
    alpha = np.empty((STEP, total, 2))
    for t in range(STEP):
        f0, f1 = step(f0, f1, t)
        alpha[t, :, 0], alpha[t, :, 1] = f0, f1
    out = np.empty((STEP, total))
    for t in range(STEP - 1, -1, -1):
        good, bad = alpha[t, :, 0] * b0, alpha[t, :, 1] * b1
        out[t] = bad / (good + bad)
        b0, b1 = back(b0, b1, t)
    return out[col, row]


def _g2(k1, n1, k2, n2):
    def term(k, e):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0)

    p = (k1 + k2) / (n1 + n2)
    return 2 * (term(k1, n1 * p) + term(n1 - k1, n1 * (1 - p)) + term(k2, n2 * p) + term(n2 - k2, n2 * (1 - p)))


def train(texts: list[str], toxic: list[bool], windows: int = WINDOWS) -> Model:
    """Weights from labelled documents, as the module's docstring says."""
    toxic = np.array(toxic, bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    empty = Model(np.zeros(0, U64), np.zeros(0), -8.0, np.array([[0.0, -4.0], [0.0, -1.0]]))
    if not n1 or not n0:
        return empty
    runs = []
    for at, run in vec.blocks(texts):
        _, _, own, _, kinds = tokens(run)
        runs.append((own + at, kinds))
    own = np.concatenate([o for o, _ in runs])
    kinds = [np.concatenate([k[i] for _, k in runs]) for i in range(1 + len(BEGINNINGS))]
    found, gain = [], []
    for h in kinds:
        real = h != 0
        names, inverse = np.unique(h[real], return_inverse=True)
        once = np.unique(inverse.astype(np.int64) * len(texts) + own[real])
        name, doc = once // len(texts), once % len(texts)
        k1 = np.bincount(name, weights=toxic[doc], minlength=len(names))
        k0 = np.bincount(name, minlength=len(names)) - k1
        g = _g2(k1, n1, k0, n0)
        good = (g >= MIN_G2) & (k1 >= MIN_RATE * n1) & (k1 / n1 >= MIN_RATIO * k0 / n0)
        found.append(names[good])
        gain.append(g[good])
    features, gain = np.concatenate(found), np.concatenate(gain)
    features = features[np.argsort(-gain, kind="stable")[:MAX_FEATURES]]
    features = np.unique(features)
    if not len(features):
        return empty
    # token labels, and each token's features as (token, feature) pairs
    tok, feat = [], []
    for h in kinds:
        at = np.minimum(np.searchsorted(features, h), len(features) - 1)
        hit = np.flatnonzero(features[at] == h)
        tok.append(hit)
        feat.append(at[hit])
    tok, feat = np.concatenate(tok), np.concatenate(feat)
    label = np.zeros(len(own), bool)
    label[tok] = True
    label &= toxic[own]
    # windows within documents, shorter at their ends: those with a positive label, and as many others
    first = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
    size = np.diff(np.append(first, len(own)))
    rest = size % WINDOW
    full = np.concatenate([np.arange(f, f + s - WINDOW + 1, WINDOW) for f, s in zip(first.tolist(), size.tolist(), strict=True)]).astype(np.int64)
    cuts = np.concatenate([full, (first + size - rest)[rest > 0]])
    real = np.arange(WINDOW) < np.concatenate([np.full(len(full), WINDOW), rest[rest > 0]])[:, None]
    grid = np.where(real, cuts[:, None] + np.arange(WINDOW), 0)
    hot = (label[grid] & real).any(1)
    rng = np.random.default_rng(11)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(x))[: windows // 2] for x in (hot, ~hot)])
    grid, real = grid[chosen], real[chosen]
    y = (label[grid] & real).astype(np.int64)
    place = np.full(len(own), -1)
    place[grid[real]] = np.flatnonzero(real)
    use = place[tok] >= 0
    tok, feat = place[tok[use]], feat[use]
    w, bias, trans = np.zeros(len(features)), -4.0, np.array([[0.0, -2.0], [0.0, 0.0]])
    m = [np.zeros(len(features) + 5), np.zeros(len(features) + 5)]
    total = grid.size
    for it in range(1, ROUNDS + 1):
        e = bias + np.bincount(tok, weights=w[feat], minlength=total)
        node, edge = _window_marginals(e.reshape(y.shape), trans, real)
        diff = np.where(real, node - y, 0).ravel()
        ge = np.array([[(edge[i, j] - ((y[:, :-1] == i) & (y[:, 1:] == j) & real[:, 1:]).sum()) for j in (0, 1)] for i in (0, 1)])
        grad = np.concatenate([np.bincount(feat, weights=diff[tok], minlength=len(w)), [diff.sum()], ge.ravel()]) / len(y)
        theta = np.concatenate([w, [bias], trans.ravel()])
        grad += PENALTY * theta
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        theta -= 0.3 * (m[0] / (1 - 0.9**it)) / (np.sqrt(m[1] / (1 - 0.99**it)) + 1e-8)
        w, bias, trans = theta[: len(w)], float(theta[len(w)]), theta[len(w) + 1 :].reshape(2, 2)
    return Model(features, w, bias, trans)


def _window_marginals(e: np.ndarray, trans: np.ndarray, real: np.ndarray):
    """Marginals of toxic at each place of windows, and expected counts of each transition; only the first places of a window, those in `real`, count."""
    a, odds = np.exp(trans), np.exp(np.clip(e, -50, 50))
    n, length = e.shape
    alpha = np.empty((length, n, 2))
    v = np.stack([np.ones(n), odds[:, 0]], 1)
    alpha[0] = v / v.sum(1, keepdims=True)
    for t in range(1, length):
        v = alpha[t - 1] @ a
        v[:, 1] *= odds[:, t]
        alpha[t] = v / v.sum(1, keepdims=True)
    node, edge = np.empty((n, length)), np.zeros((2, 2))
    beta = np.ones((n, 2))
    for t in range(length - 1, -1, -1):
        joint = alpha[t] * beta
        node[:, t] = joint[:, 1] / joint.sum(1)
        if t:
            out = beta.copy()
            out[:, 1] *= odds[:, t]
            x = alpha[t - 1][:, :, None] * a[None] * out[:, None, :]
            edge += (x / x.sum((1, 2), keepdims=True))[real[:, t]].sum(0)
            out = out @ a.T
            beta = np.where(real[:, t, None], out / out.sum(1, keepdims=True), beta)
    return node, edge


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, windows: int = WINDOWS) -> Model:
    """A model from a bounded sample of labelled documents; the sample (2 * sample texts at most) is all that the driver sees."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    sides = [marked.where(side).orderBy(*order).limit(2 * sample) for side in (F.col("toxic"), ~F.col("toxic"))]
    picked = F.broadcast(sides[0].union(sides[1]))  # 4 * sample ids at most
    short = docs.select("doc_id", "text").where(F.length("text").between(1, longest)).join(picked, "doc_id")
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(*order, "text"))  # few rows are left here
    rows = sorted(short.withColumn("nth", nth).where(F.col("nth") <= sample).collect(), key=lambda r: (not r["toxic"], r["nth"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], windows)


def tag(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic_tokens, spans) of documents with a toxic span."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("toxic_tokens", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    @vec.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            ids = b.column("doc_id")
            for at, block in vec.blocks(b.column("text").to_pylist()):
                begin, end, own, starts, kinds = tokens(block)
                p = marginals(emissions(kinds, model), own, model.trans)
                hot = p >= threshold
                if not hot.any():
                    continue
                docs_hot = np.unique(own[hot])
                expected = np.bincount(own, weights=p, minlength=len(block))
                best = np.zeros(len(block))
                np.maximum.at(best, own, p)
                follow = hot.copy()
                follow[1:] &= ~(hot[:-1] & (own[1:] == own[:-1]))
                s = np.flatnonzero(follow)
                run_of = np.cumsum(follow)[hot] - 1
                stop = np.zeros(len(s), np.int64)
                np.maximum.at(stop, run_of, end[hot])
                top = np.zeros(len(s))
                np.maximum.at(top, run_of, p[hot])
                doc = own[s]
                offsets = np.searchsorted(doc, np.append(docs_hot, len(block)))
                spans = pa.StructArray.from_arrays([pa.array((begin[s] - starts[doc]).astype(np.int32)), pa.array((stop - starts[doc]).astype(np.int32)), pa.array(top)], names=["start", "end", "score"])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs_hot + at)), pa.array(best[docs_hot]), pa.array(expected[docs_hot]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
