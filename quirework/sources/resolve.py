"""Metadata by identifier: lookup tables stand in for web services, and joins for requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import doi_lookup
from quirework.schema import CSL_TYPES

#: The registry's types that are not CSL types.
REGISTRY_TYPES = {
    "journal-article": "article-journal", "book-chapter": "chapter", "book-part": "chapter", "book-section": "chapter",
    "proceedings-article": "paper-conference", "dissertation": "thesis", "posted-content": "manuscript", "monograph": "book",
    "edited-book": "book", "reference-book": "book", "reference-entry": "entry-encyclopedia", "report-component": "report",
}
#: Seconds for which a lookup's outcome holds.
HOLDS = {"ok": 86_400, "not_found": 3_600, "upstream_error": 600, "invalid_response": 600}


def csl_type(registry_type: Column) -> Column:
    """SRC-8: a registry's type as a CSL type; unknown ones become documents."""
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REGISTRY_TYPES.items() for x in kv]), F.coalesce(registry_type, F.lit(""))), registry_type)
    return F.when(mapped.isin(*CSL_TYPES), mapped).otherwise("document")


def pmid_of(value: Column) -> Column:
    """The number of a PubMed identifier, of one to eight digits; null for anything else."""
    digits = F.trim(F.regexp_replace(value, r"(?i)\APMID:\s*", ""))
    return F.when(digits.rlike(r"\A[0-9]{1,8}\z"), digits)


def fresh(metadata: DataFrame, now: Column) -> DataFrame:
    """SRC-10: lookup rows (status, fetched_at) that still hold at a time."""
    holds = F.element_at(F.create_map(*[F.lit(x) for kv in HOLDS.items() for x in kv]), F.col("status"))
    return metadata.where(F.unix_timestamp("fetched_at") + holds > F.unix_timestamp(now))


def _joined(items: DataFrame, metadata: DataFrame, format_: str, key: Column) -> DataFrame:
    """Adds csl_json where items of a format are in the lookup table; its keys are made distinct first."""
    table = metadata.groupBy(F.col("key").alias("_key")).agg(F.min("csl_json").alias("_csl"))
    keyed = items.withColumn("_at", F.when(F.col("format") == format_, key))
    found = keyed.join(table, keyed["_at"] == table["_key"], "left")
    have = F.col("csl_json") if "csl_json" in items.columns else F.lit(None).cast("string")
    return found.withColumn("csl_json", F.coalesce(have, F.col("_csl"))).drop("_at", "_key", "_csl")


def resolve_dois(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """SRC-7: metadata: key (a DOI as doi_lookup() gives it), csl_json."""
    return _joined(items, metadata, "doi", doi_lookup(F.col("value")))


def resolve_pmids(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """SRC-9: metadata: key (digits), csl_json."""
    return _joined(items, metadata, "pmid", pmid_of(F.col("value")))


def pmid_status(requests: DataFrame, metadata: DataFrame, now: Column) -> DataFrame:
    """SRC-10: requests (pmid) with status ok, not_found, upstream_error, invalid_response or invalid_id, and csl_json.

    metadata: key, status, csl_json, fetched_at. A number that no fresh row has is upstream_error.
    """
    table = fresh(metadata, now).select(F.col("key").alias("_key"), "status", "csl_json")
    asked = requests.withColumn("_at", pmid_of(F.col("pmid")))
    found = asked.join(table, asked["_at"] == table["_key"], "left")
    status = F.when(F.col("_at").isNull(), "invalid_id").otherwise(F.coalesce("status", F.lit("upstream_error")))
    return found.select("pmid", status.alias("status"), "csl_json")
