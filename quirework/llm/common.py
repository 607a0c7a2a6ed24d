"""What the operators of this subpackage share: tokens, durable tables, running totals."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.shipping import ship
from quirework.storage import durable

#: White space and words as the contracts define them: ASCII only, bytes 0x20 and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(df: DataFrame) -> DataFrame:
    """durable() for a scan's narrow rows: shuffled into few files, however many tasks made them."""
    return durable(df.hint("rebalance"))


def discard(*tables: DataFrame) -> None:
    """Delete durable tables from which nothing is left to be read: all that came of them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quirework_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are written.

    It does so when the driver's JVM collects garbage. The last query's plan is held until another one runs.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that go to Python at once, in operators on texts: a batch of long texts must fit beside others.
BATCH_ROWS = 256


def in_small_batches(df: DataFrame) -> DataFrame:
    """df; its session hands at most BATCH_ROWS rows to Python at once from now on, and workers have this package."""
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(squeezed, r"[^w]", "")).cast("long")


def hex_digits(rows: int, per_chunk: int = 2000) -> int:
    """Leading hex digits of a digest that split rows into chunks of about per_chunk."""
    digits = 1
    while 16**digits * per_chunk < rows and digits < 12:
        digits += 1
    return digits


def running_total(df: DataFrame, key: str, chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``key`` in the order of ``chunk``, then ``order``.

    No task sees a whole key: sums per (key, chunk) are totalled first, and only those few
    totals are walked per key; rows are then walked per (key, chunk). ``key`` and ``chunk``
    must not be null.
    """
    totals = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    walk = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(key, chunk, F.coalesce(F.sum("_sum").over(walk), F.lit(0)).cast("long").alias("_base"))
    inner = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(base, [key, chunk])
    return joined.withColumn(
        out, (F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")
    ).drop("_base")


def carried(docs: DataFrame, *columns) -> DataFrame:
    """(doc_id, no_id, *columns) for Python: a batch with a null among its ids would arrive as floats and change others."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNull().alias("no_id"), *columns)


def restored(rows: DataFrame) -> DataFrame:
    """rows without no_id: where it is set, doc_id is null again."""
    told = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    return rows.select(*[told if c == "doc_id" else F.col(c) for c in rows.columns if c != "no_id"])


def raw_print(docs: DataFrame, *more: str) -> Column:
    """A hash of a row's text, and more columns, as they stand, null apart from empty; with doc_id it names a row up to equal rows."""
    return F.xxhash64(*[x for name in ("text", *more) for x in (docs[name].isNull(), docs[name])])


def one_of_each(docs: DataFrame, rows: DataFrame, group: str, *more: str) -> DataFrame:
    """Of each group of documents one row, with all its columns: that of the smallest doc_id, nulls last.

    rows: (doc_id, print, group) of every document, print being raw_print(docs, *more); group is not null. Rows that
    share all three are told apart by a hash of all their columns. What is dropped is what travels, not what stays,
    and groups are aggregated before they are shuffled, so that no task sees a whole one.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    best = durable(rows.groupBy(group).agg(F.min(place).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    names = {"doc_id": "__qw_id", "print": "__qw_print"}
    split = durable(rows.join(best, group).select("doc_id", "print", group, place.eqNullSafe(F.col("_best")).alias("_stays")))
    gone = split.where("not _stays").select("doc_id", "print").distinct().withColumnsRenamed(names)
    twice = split.where("_stays").groupBy("doc_id", "print").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = twice.select("doc_id", "print").withColumnsRenamed(names)
    marked = docs.withColumn("__qw_own", raw_print(docs, *more))
    # Both lists grow with the data, so they are never broadcast.
    gone, twice = gone.hint("merge"), durable(twice).hint("merge")
    some = bool(gone.take(1))
    match = lambda left, right: left["doc_id"].eqNullSafe(right["__qw_id"]) & (left["__qw_own"] == right["__qw_print"])
    rest = marked.join(gone, match(marked, gone), "left_anti") if some else marked
    if not twice.take(1):
        return rest.drop("__qw_own")
    once = rest.join(twice, match(rest, twice), "left_anti").drop("__qw_own")
    again = rest.join(twice, match(rest, twice), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.groupBy("doc_id", "__qw_own").agg(F.min_by(whole, F.xxhash64(whole)).alias("__qw_row"))
    return once.unionByName(again.select("__qw_row.*"))
