"""Connected components by alternating large-star and small-star rounds.

Each round rewires edges towards the smallest neighbour; the edges end as stars around each
component's smallest node, after a number of rounds logarithmic in the component's size. Rounds are
written to the shared folder, so that the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import forget, written

MAX_ROUNDS = 60


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of the edges with the smallest node that it is connected to.

    Rows with a null end are dropped; repeated edges and loops are harmless; no edges, no rows.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = raw.select(F.col("u").alias("node")).union(raw.select("v")).distinct()
    current = written(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = None
    for _ in range(MAX_ROUNDS):
        # u > v in every edge; a hub's neighbours meet in a minimum that is taken before the shuffle, never in one list
        both = current.select("u", "v").union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").toDF("u", "v").union(low.select("u", "m")).distinct()
        following = written(small, "components")
        forget(current, large)
        current = following
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return nodes.join(current.toDF("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        mark = seen
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
