"""Counts, checks, latency summaries, caps, and rows collected into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.validate import raw_link_text
from quirework.schema import HARD_CAP, PASTE_CAP, SOFT_CAP


def entry_counts(citations: DataFrame) -> DataFrame:
    """AGG-1, VAL-9: rows per bibliography, and whether they exceed the editor's caps; nothing is cut."""
    counts = citations.groupBy("bibliography_id").agg(F.count(F.lit(1)).alias("entry_count"))
    return counts.withColumn("over_soft_cap", F.col("entry_count") > SOFT_CAP).withColumn("over_hard_cap", F.col("entry_count") > HARD_CAP)


def import_counters(items: DataFrame) -> DataFrame:
    """AGG-2: outcomes per bibliography. items: bibliography_id, outcome, warnings (array), overflow (boolean)."""
    return items.groupBy("bibliography_id").agg(
        F.count_if(F.col("outcome") == "added").alias("added"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if((F.col("outcome") == "added") & (F.size("warnings") > 0)).alias("review_warnings"),
        F.bool_or("overflow").alias("truncated"),
    )


def latency_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """AGG-3, AGG-4: minimum, maximum, mean, median and nearest-rank percentiles of a value, and its sum."""
    rank = lambda r: F.expr(f"percentile_disc({r}) WITHIN GROUP (ORDER BY `{value}`)")
    return samples.groupBy(by).agg(
        F.count(value).alias("runs"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("avg"),
        F.median(value).alias("median"),
        rank(0.5).alias("p50"),
        rank(0.95).alias("p95"),
        F.sum(value).alias("total"),
    )


def first_per_group(items: DataFrame, by: str, order: str, most: int = PASTE_CAP) -> DataFrame:
    """DET-6, WIN-3: items with overflow set beyond the first ``most`` of each group, in order."""
    window = Window.partitionBy(by).orderBy(order)
    return items.withColumn("overflow", F.row_number().over(window) > most)


def collected(rows: DataFrame, by: str, order: str, value: Column, separator: str, end: str = "") -> DataFrame:
    """AGG-5: one text per group, its rows' values in order."""
    # Values are made below the aggregation: Spark compiles no expression inside collect_list().
    made = rows.select(by, F.struct(F.col(order).alias("o"), value.alias("v")).alias("pair"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("pair")), lambda p: p["v"]), separator)
    return made.groupBy(by).agg(F.concat(text, F.lit(end)).alias("content"))


def content_checks(bibliographies: DataFrame, citations: DataFrame) -> DataFrame:
    """VAL-6: four checks per bibliography; true means passed.

    bibliographies: bibliography_id, heading_text, output_json_ld, output_coins, output_csl_json.
    """
    told = citations.groupBy("bibliography_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(raw_link_text(F.col("title"), F.col("URL"), F.col("DOI"))).alias("_raw")
    )
    some = F.coalesce(F.col("_n"), F.lit(0)) > 0
    heading = F.trim(F.coalesce("heading_text", F.lit(""))) != ""
    outputs = [F.coalesce(c, F.lit(False)) for c in ("output_json_ld", "output_coins", "output_csl_json")]
    return bibliographies.join(told, "bibliography_id", "left").select(
        "bibliography_id",
        some.alias("empty_bibliography"),
        (~some | heading).alias("heading_missing"),
        (~F.coalesce("_raw", F.lit(False))).alias("raw_url_link_text"),
        (outputs[0] | outputs[1] | outputs[2]).alias("all_metadata_disabled"),
    )


def first_bad(citations: DataFrame, found: Column, batch: str = "bibliography_id") -> DataFrame:
    """VAL-2: (batch, rows, bad, pos, error) of each batch: how many rows it has and how many are bad, and of these the first, with its first error.

    found: the errors of a row. A batch without bad rows has no pos and error: it is accepted whole; any other is refused.
    """
    rows = citations.select(batch, "pos", found.alias("_found"))
    first = F.min(F.when(F.size("_found") > 0, F.struct("pos", F.get("_found", 0).alias("error"))))
    told = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_found") > 0).alias("bad"), first.alias("_first"))
    return told.select(batch, "rows", "bad", "_first.*")
