"""The read and write interface: what a host would call, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.names import names_case, title_case
from quirework.functions.reviews import review_title, review_warnings
from quirework.functions.text import blank_to_null, doi_input
from quirework.functions.validate import readable
from quirework.operators.dedupe import first_duplicates, partition_duplicates
from quirework.operators.sets import append, formatted_in, resorted
from quirework.schema import CITATION_COLUMNS, CSL_COLUMNS
from quirework.sources.blocks import CSL_JSON, bibliographies, citations, csl_columns
from quirework.sources.pasted import bibtex_entries, paste_items, parsed
from quirework.storage import durable


def open_posts(posts: DataFrame) -> DataFrame:
    """VAL-8: posts (status, password, type_viewable, may_edit) that may be read."""
    return posts.where(readable(F.col("status"), F.col("password"), F.col("type_viewable"), F.col("may_edit")))


def list_bibliographies(posts: DataFrame) -> DataFrame:
    """EXP-11: every bibliography of readable posts, in stored order."""
    return bibliographies(open_posts(posts))


def get_bibliography(posts: DataFrame, post_id: int, index: int, form: str = "json") -> DataFrame:
    """EXP-11: one bibliography; form is json (its citations), text or csl-json. No rows if there is none.

    Nothing is sorted or rendered on reading.
    """
    if form not in ("json", "text", "csl-json"):
        raise ValueError(f"unknown form {form!r}")
    found = list_bibliographies(posts.where(F.col("post_id") == post_id)).where(F.col("index") == index)
    rows = citations(found).withColumn("bibliography_id", F.col("index"))
    if form == "json":
        return rows
    from quirework.operators.documents import stored_text

    if form == "text":
        return stored_text(rows).select("content")
    listed = F.array_sort(F.collect_list(F.struct("pos", "csl_json")))
    return rows.groupBy("bibliography_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda r: r["csl_json"]), ","), F.lit("]")).alias("content")
    ).select("content")


def normalised(rows: DataFrame) -> DataFrame:
    """NRM-6 to NRM-9: case of names and titles, review titles, warnings. rows: a citation's columns."""
    for k in ("author", "editor", "reviewed_author"):
        rows = rows.withColumn(k, names_case(F.col(k)))
    before = F.col("_title_before")
    rows = rows.withColumn("_title_before", F.col("title"))
    rows = rows.withColumn("title", title_case(F.col("title"))).withColumn("container_title", title_case(F.col("container_title")))
    rows = rows.withColumn("title", review_title(F.col("type"), F.col("title"), F.col("container_title")))
    warnings = review_warnings(F.col("input_format"), F.col("type"), F.col("container_title"), before, F.col("title"), F.col("page"))
    return rows.withColumn("parse_warnings", warnings).drop("_title_before")


def items_as_citations(found: DataFrame, doi_metadata: DataFrame, pmid_metadata: DataFrame) -> DataFrame:
    """Items of pastes as citations, keyed by paste_id and pos; what can't be read is left out."""
    # The rules are one large expression: written once, it isn't planned again with each column that reads it.
    rows = durable(parsed(found, doi_metadata, pmid_metadata))
    named = rows.where("input_format IS NOT NULL AND input_format <> 'bibtex'")
    named = named.withColumn("j", F.from_json("csl_json", CSL_JSON))
    looked, free = csl_columns(F.col("j")), F.col("record")
    have = {f.name for f in rows.schema["record"].dataType.fields}
    empty = F.expr("cast(array() as array<string>)")
    picked = []
    for k, kind in CSL_COLUMNS.items():
        other = free[k] if k in have else (empty if kind == "array<string>" else F.lit(None).cast(kind))
        picked.append(F.when(F.col("csl_json").isNotNull(), looked[k]).otherwise(other).cast(kind).alias(k))
    plain = named.select("paste_id", "pos", "input_format", *picked)
    entries = bibtex_entries(found).withColumn("input_format", F.lit("bibtex")).drop("entry", "citation_key")
    return plain.unionByName(entries, allowMissingColumns=True)


def import_paste(
    existing: DataFrame, pastes: DataFrame, style: str, doi_metadata: DataFrame, pmid_metadata: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """MUT-1: (citations after the import, outcomes). pastes: paste_id, which is the bibliography_id, and text.

    Items are split, resolved, normalised, checked for duplicates among themselves and with what is stored,
    appended, rendered and sorted. Ids are digests of content, so a run can be repeated.
    """
    found = paste_items(pastes)
    rows = normalised(items_as_citations(found, doi_metadata, pmid_metadata)).withColumnRenamed("paste_id", "bibliography_id")
    rows = durable(rows.withColumn("DOI", blank_to_null(doi_input(F.col("DOI")))))
    stored = first_duplicates(rows, existing).select("bibliography_id", "pos", F.lit(True).alias("_stored"))
    # Lists that grow with the pastes are never broadcast: their files are far smaller than their rows.
    rows = rows.join(stored.hint("merge"), ["bibliography_id", "pos"], "left")
    fresh = partition_duplicates(rows.where("_stored IS NULL").drop("_stored"))
    new = fresh.where("not duplicate").drop("duplicate")
    digest = F.sha2(F.to_json(F.struct("bibliography_id", "pos", "title", "DOI", "author")), 256)
    new = new.withColumn("id", F.concat(F.lit("citation-"), F.substring(digest, 1, 16)))
    outcomes = rows.where("_stored").select("bibliography_id", "pos", F.lit("duplicate").alias("outcome"), "parse_warnings")
    decided = fresh.select(
        "bibliography_id", "pos", F.when(F.col("duplicate"), "duplicate").otherwise("added").alias("outcome"), "parse_warnings"
    )
    read = rows.select("bibliography_id", "pos")
    failed = found.where("not overflow").withColumnRenamed("paste_id", "bibliography_id").join(read.hint("merge"), ["bibliography_id", "pos"], "left_anti")
    errors = failed.select("bibliography_id", "pos", F.lit("error").alias("outcome"), F.expr("cast(array() as array<string>)").alias("parse_warnings"))
    missing = [F.lit(None).cast(t).alias(k) for k, t in CITATION_COLUMNS.items() if k not in new.columns]
    after = resorted(formatted_in(append(existing, new.select("*", *missing)), style), style)
    return after, outcomes.unionByName(decided).unionByName(errors)
