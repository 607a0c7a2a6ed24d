"""SRC-7, SRC-10, the write side: a table of lookup outcomes that is asked first, added to, and compacted.

The table (key, status, csl_json, fetched_at) only grows; a key's latest row is what holds, for as long as its status
says. Only keys that no row answers are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.sources.resolve import fresh

OUTCOMES = "key string, status string, csl_json string, fetched_at timestamp"


def latest(outcomes: DataFrame) -> DataFrame:
    """One row per key, that of the latest look-up; of equal times a good one, then the smallest."""
    rank = F.struct("fetched_at", F.col("status") == "ok", F.hex(F.unhex(F.sha2(F.concat_ws("\x1f", "status", F.coalesce("csl_json", F.lit(""))), 256))))
    rows = outcomes.where("key IS NOT NULL AND fetched_at IS NOT NULL").select("key", rank.alias("_rank"), F.struct("status", "csl_json", "fetched_at").alias("_row"))
    return rows.groupBy("key").agg(F.max_by("_row", "_rank").alias("_row")).select("key", "_row.*")


def unanswered(keys: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The distinct keys that no outcome answers at a time."""
    held = fresh(latest(outcomes), now).select("key")
    return keys.select("key").where("key IS NOT NULL").distinct().join(held, "key", "left_anti")


def look_up(keys: DataFrame, path: str, resolve: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """Outcomes of keys, of which only the unanswered are resolved; these are added to the table at path.

    resolve gives (key, status, csl_json) of some of the keys it is asked; those it does not name are not found.
    """
    spark = keys.sparkSession
    table = read(spark, path)
    asked = unanswered(keys, table, now)
    told = asked.join(resolve(asked), "key", "left").select("key", F.coalesce("status", F.lit("not_found")).alias("status"), "csl_json", now.alias("fetched_at"))
    told.write.mode("append").parquet(path)
    return latest(read(spark, path)).join(keys.select("key").distinct(), "key", "left_semi")


def read(spark, path: str) -> DataFrame:
    """The table at path; empty if nothing was written there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(OUTCOMES).parquet(path) if there else spark.createDataFrame([], OUTCOMES)


def compact(spark, path: str, to: str, now: Column | None = None) -> DataFrame:
    """The table at path with one row a key, written to another place; with a time, without what no longer holds then."""
    rows = latest(read(spark, path))
    (rows if now is None else fresh(rows, now)).write.parquet(to)
    return read(spark, to)
