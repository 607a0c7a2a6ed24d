"""Places in a global order, without a task that sees all rows or all of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.common import durable


def ranked(rows: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """rows, written in the order of ``order`` (nulls first), with each one's place from 0 without gaps.

    Ranges of the order are sorted apart from each other and written; only their sizes, one row for each
    partition, are added up in order. ``rows`` is sampled for the ranges, so it should be a written table. Rows that
    agree in all of ``order`` share a range: where these may be many, the caller's last column should tell them apart.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")))
    sizes = placed.groupBy("_part").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).cast("long").alias("_base"))
    # One row for each partition of the shuffle above, which the session's settings bound.
    joined = placed.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_seq"))
    joined = joined.drop("_part", "_seq", "_base")
    joined._quirework_path = placed._quirework_path
    return joined
