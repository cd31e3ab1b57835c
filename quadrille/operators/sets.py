"""Set operations, duplicate elimination, ordering and limits over quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import written

TRIPLE = ("s", "p", "o")


def drop_inferred_duplicates(quads: DataFrame, inferred: str = "<urn:rule:") -> DataFrame:
    """Per triple, all asserted quads if there is one, else the inferred one of the smallest context."""
    is_inferred = F.col("c").startswith(inferred)
    w = Window.partitionBy(*TRIPLE)
    rows = quads.withColumn("__asserted", F.max((~is_inferred).cast("int")).over(w)).withColumn("__nth", F.row_number().over(w.orderBy(is_inferred.cast("int"), "c")))
    return rows.where(F.when(F.col("__asserted") == 1, ~is_inferred).otherwise(F.col("__nth") == 1)).drop("__asserted", "__nth")


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__nth = 1").drop("__nth")


def active_groups(rows: DataFrame, key: str, alias: str) -> DataFrame:
    """All rows of the keys of which some row has an alias."""
    return rows.withColumn("__on", F.max(F.col(alias).isNotNull().cast("int")).over(Window.partitionBy(key))).where("__on = 1").drop("__on")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b that the other lacks, with the side, as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def per_key_limit(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= most).drop("__nth")


def slice_hits(hits: DataFrame, first: int, last: int, score: str = "score", key: str = "doc") -> DataFrame:
    """Hits first to last (from 1), by score downwards, then key."""
    return hits.orderBy(F.desc(score), F.asc(key)).offset(max(0, first - 1)).limit(max(0, last - max(1, first) + 1 if first else last))


def sortedness(quads: DataFrame, order: tuple[str, ...], partition: str) -> DataFrame:
    """Rows that sort before their predecessor, by position within a partition column."""
    key = F.struct(*order)
    prev = F.lag(key).over(Window.partitionBy(partition).orderBy("pos"))
    return quads.withColumn("__bad", prev.isNotNull() & (key < prev)).where("__bad").drop("__bad")


def unsorted_rows(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(unsorted): for each task the rows that sort before their predecessor, in the order that they are read in; no row moves."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        bad, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [pa.chunked_array([last.column(c), batch.column(c)] if last is not None else [batch.column(c)]) for c in order]
            less, tied = pa.scalar(False), pa.scalar(True)
            for c in columns:
                # nulls first, as a sort has them
                before, after = c.slice(0, len(c) - 1), c.slice(1)
                down = pc.or_(pc.fill_null(pc.less(after, before), False), pc.and_(pc.is_null(after), pc.is_valid(before)))
                same = pc.or_(pc.fill_null(pc.equal(after, before), False), pc.and_(pc.is_null(after), pc.is_null(before)))
                less, tied = pc.or_(less, pc.and_(tied, down)), pc.and_(tied, same)
            bad += pc.sum(less).as_py() or 0
            last = batch.slice(batch.num_rows - 1)
        yield pa.RecordBatch.from_pydict({"unsorted": pa.array([bad], pa.int64())})

    return rows.select(*order).mapInArrow(count, "unsorted long")


def numbered(rows: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """Rows with their place in the order by the given columns, from 1.

    Rows go to ranges of the order, whose bounds are sampled; a frequent value is cut by the columns that follow it, and by those not in `by`. The sizes of the
    ranges, one row for each, are added to the places within. The ranges are written, since places need them twice."""
    ordered = [c for c in rows.columns if c not in by]
    ranges = written(rows.repartitionByRange(*by, *ordered).sortWithinPartitions(*by, *ordered).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*by, *ordered))
    return ranges.withColumn("__inside", inside).join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__inside") + F.col("__before")).cast("long").alias(position))
