"""Connected components of a link table, by alternating star contractions; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import discard, durable


def connected(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. links: (a, b), not null, each way at least once.

    Every round joins each node's larger neighbours, then its smaller ones, to the smallest neighbour;
    the rounds grow with the logarithm of the graph. Each is written to the shared folder and deleted when the next stands.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least are written before they are joined: two plain shuffles, so that Spark can split a hot node's rows.
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = durable(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges, done = durable(small.where("u <> v").distinct()), edges
        discard(done, least, large, small_least)
        # Sums of exact integers name a set of edges well enough to see that nothing moved.
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
