"""Mixing overlapping sources to target weights by min-cost flow.

A source is a named predicate over the documents; one document may belong to several. Documents are
aggregated by membership pattern (one bit for each source) and by bucket of a seeded hash, so that the
driver sees at most patterns * BUCKETS rows whatever the corpus. Patterns then feed sources in a flow
network: a pattern's tokens can be used again, at costs that rise with every repetition (convex), a
source takes its weight times the budget, and the cheapest flow of the greatest volume is found by
successive shortest paths. A pattern's flow says how many whole copies of its documents to take, and up
to which seeded hash one more; a second hash deals copies to sources in proportion to the flow.

Tokens are counted by encoding every text with the vocabulary of the byte-pair operator, 0 for a null or empty text.
`counted` keeps (doc_id, pattern, tokens) of each document; the plan aggregates it.

Nulls: a predicate that is null doesn't hold. A document of no source isn't taken. A null or empty text
has no tokens and isn't counted, but is taken or left like any other of its pattern. Ties don't arise: rows that repeat a
doc_id share their hash and fare alike; null ids too. A source without documents leaves its quota unfilled. An empty
table gives an empty result. Extra columns pass through in `select_documents`; names that start with `__mix` are reserved.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import bpe
from quadrille.llm.common import written

BUCKETS = 1024
SEED = 20240229
#: Of one pass over a pattern's tokens, and then of each repetition: cost of its first quarter, second, ...
STEPS = 4
REPETITION_COSTS = ((0, 1, 2, 3), (20, 24, 28, 32), (80, 90, 100, 110), (300, 330, 360, 390))
SOURCES = (
    ("bulk", "source = 'src0'", 0.22),
    ("english", "lang = 'en'", 0.38),
    ("german", "lang = 'de'", 0.12),
    ("french", "lang = 'fr'", 0.12),
    ("spanish", "lang = 'es'", 0.10),
    ("long_form", "n_chars >= 8000", 0.06),
)
BUDGET = 0.9  # of all tokens


@dataclass
class Plan:
    """What to take of each pattern: whole copies, the hash below which there is one more, and sources' shares."""

    copies: dict[int, int] = field(default_factory=dict)
    below: dict[int, float] = field(default_factory=dict)
    shares: dict[int, list[tuple[int, float]]] = field(default_factory=dict)
    flow: dict[tuple[int, int], int] = field(default_factory=dict)


class Flow:
    """Min-cost flow by successive shortest paths over residual edges."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, start: int, end: int) -> tuple[int, int]:
        """Volume and cost of the cheapest flow of greatest volume."""
        volume = total = 0
        while True:
            dist: list[float] = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            dist[start] = 0
            queue, queued = deque([start]), [False] * len(self.out)
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and dist[a] + self.cost[e] < dist[b]:
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if via[end] < 0:
                return volume, total
            path, node = [], end
            while node != start:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            volume += push
            total += push * int(dist[end])


def route(capacity: dict[int, int], quotas: list[int], costs=REPETITION_COSTS) -> dict[tuple[int, int], int]:
    """Tokens from each pattern to each source: quotas as full as can be, at the least cost of repetition."""
    patterns = [p for p in sorted(capacity) if p and capacity[p] > 0]
    net = Flow(2 + len(patterns) + len(quotas))
    start, end = 0, 1
    arcs = {}
    for i, p in enumerate(patterns):
        for epoch in costs:
            for k, cost in enumerate(epoch):
                room = capacity[p] * (k + 1) // len(epoch) - capacity[p] * k // len(epoch)
                net.edge(start, 2 + i, room, cost)
        for s in range(len(quotas)):
            if p >> s & 1:
                arcs[p, s] = net.edge(2 + i, 2 + len(patterns) + s, capacity[p] * len(costs))
    for s, quota in enumerate(quotas):
        net.edge(2 + len(patterns) + s, end, quota)
    net.run(start, end)
    return {k: net.room[e ^ 1] for k, e in arcs.items() if net.room[e ^ 1]}


def pattern(sources) -> Column:
    """Bits of the sources that hold for a row."""
    out = F.lit(0)
    for i, (_, predicate, _) in enumerate(sources):
        out = out + F.when(F.expr(predicate), F.lit(1 << i)).otherwise(0)
    return out.cast("int")


def _unit(seed: int) -> Column:
    """A hash of doc_id in [0, 1)."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def counted(docs: DataFrame, sources=SOURCES, seed: int = SEED) -> DataFrame:
    """(doc_id, __mix_pattern, n_tokens) of every row; texts are read here and nowhere else."""
    return bpe.count(docs.select("doc_id", pattern(sources).alias("__mix_pattern"), "text"))


def plan(rows: DataFrame, sources=SOURCES, budget: float = BUDGET, seed: int = SEED) -> Plan:
    """Aggregates `counted` rows and solves the flow; the driver gets one row for each pattern and bucket."""
    bucket = F.floor(_unit(seed) * BUCKETS).cast("int")
    sums = rows.groupBy(F.col("__mix_pattern").alias("p"), F.coalesce(bucket, F.lit(0)).alias("b")).agg(F.sum("n_tokens").alias("t")).collect()
    return solve([(r["p"], r["b"], r["t"]) for r in sums], [w for _, _, w in sources], budget)


def solve(rows: list[tuple[int, int, int]], weights: list[float], budget: float) -> Plan:
    histogram: dict[int, list[int]] = {}
    for p, b, t in rows:
        histogram.setdefault(p, [0] * BUCKETS)[b] += t
    capacity = {p: sum(h) for p, h in histogram.items()}
    quotas = [round(sum(capacity.values()) * budget * w) for w in weights]
    out = Plan(flow=route(capacity, quotas))
    for p, h in histogram.items():
        to = [(s, f) for (q, s), f in sorted(out.flow.items()) if q == p]
        want = sum(f for _, f in to)
        if not want:
            continue
        out.copies[p], rest = divmod(want, capacity[p])
        below = 0.0
        for b, t in enumerate(h):
            if rest <= 0:
                break
            below = (b + min(1.0, rest / t)) / BUCKETS if t else below
            rest -= t
        out.below[p] = below
        run, shares = 0, []
        for s, f in to:
            run += f
            shares.append((s, run / want))
        out.shares[p] = shares
    return out


def assign(rows: DataFrame, made: Plan, sources=SOURCES, seed: int = SEED) -> DataFrame:
    """Rows with __mix_pattern as often as the plan takes them, with __mix_copy (from 1) and __mix_source, the source fed.

    The plan is a table of one row for each pattern that occurs, 2 ** len(sources) at most, which is broadcast."""
    names = [n for n, _, _ in sources]
    table = [(p, made.copies[p], float(made.below[p]), [float(e) for _, e in made.shares[p]], [names[s] for s, _ in made.shares[p]]) for p in made.copies]
    taken = rows.sparkSession.createDataFrame(table, "__mix_pattern int, __mix_whole int, __mix_below double, __mix_edges array<double>, __mix_names array<string>")
    n = F.col("__mix_whole") + (_unit(seed) < F.col("__mix_below")).cast("int")
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1), "__mix_copy"), F.lit(1 << 40)) / float(1 << 40)
    place = F.least(F.size(F.filter("__mix_edges", lambda e: e <= dealt)), F.size("__mix_names") - 1)
    out = rows.join(F.broadcast(taken), "__mix_pattern").withColumn("__mix_n", n).where("__mix_n > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    return out.withColumn("__mix_source", F.get("__mix_names", place)).drop("__mix_n", "__mix_whole", "__mix_below", "__mix_edges", "__mix_names", "__mix_pattern")


def select_documents(docs: DataFrame, sources=SOURCES, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The mixture: docs' rows, left out or repeated as the flow says."""
    if clash := [c for c in docs.columns if c.startswith("__mix")]:
        raise ValueError(f"reserved column names: {clash}")
    made = plan(counted(docs, sources), sources, budget, seed)
    return assign(docs.withColumn("__mix_pattern", pattern(sources)), made, sources, seed).select(*docs.columns)


def mixture(docs: DataFrame, sources=SOURCES, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(doc_id, mixed_for, copy, n_tokens) of every document taken, once for each time."""
    rows = written(counted(docs, sources), "mix-counted")
    got = assign(rows, plan(rows, sources, budget, seed), sources, seed)
    return got.select("doc_id", F.col("__mix_source").alias("mixed_for"), F.col("__mix_copy").alias("copy"), "n_tokens")
