"""VAL-10: which rendering requests of a log are accepted, by size, by number of records and by rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.schema import REQUEST_BYTES, REQUEST_ITEMS

MICROSECONDS = 1_000_000


def status_of(body_bytes: Column, items: Column) -> Column:
    """413 for a body that is too large, else 400 for too many records, else 200; an empty request is answered at once."""
    return F.when(body_bytes > REQUEST_BYTES, 413).when(items > REQUEST_ITEMS, 400).otherwise(200)


def guarded(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """requests (request_id, client, at, body_bytes, items) with ``recent`` and ``status``.

    recent: the client's requests, whatever their answer, in the ``seconds`` up to this one, those of the same moment among them;
    more than ``most`` are refused with 429, which comes after the tests of size. Time is cut into spans of ``seconds``; a
    request is counted in its own and is there to be counted in the next, so that a client of any number of requests is
    spread over tasks. A null client is a client; a request without a time is not counted and has no recent ones.
    """
    span = seconds * MICROSECONDS
    at = F.unix_micros(F.col("at").cast("timestamp"))
    rows = requests.withColumn("_at", at).withColumn("_span", F.expr(f"_at div {span}"))
    timed = rows.where("_at IS NOT NULL").select("request_id", "client", "_at", F.explode(F.array(F.col("_span"), F.col("_span") + 1)).alias("_in"), "_span")
    # Equal moments are counted once for all, so that no window frame sees a client's rows twice.
    moments = timed.groupBy("client", "_in", "_span", "_at").agg(F.count(F.lit(1)).alias("_n"))
    frame = Window.partitionBy("client", "_in").orderBy("_at").rangeBetween(1 - span, 0)
    counted = moments.withColumn("recent", F.sum("_n").over(frame)).where("_in = _span").select(F.col("client").alias("_who"), F.col("_at").alias("_when"), "recent")
    told = rows.join(counted, rows["client"].eqNullSafe(counted["_who"]) & (rows["_at"] == counted["_when"]), "left")
    by_size = status_of(F.col("body_bytes"), F.col("items"))
    status = F.when(by_size != 200, by_size).when(F.col("recent") > most, 429).otherwise(200)
    return told.withColumn("status", status).drop("_at", "_span", "_who", "_when")
