"""Pasted text: guards, items, the cap, and what could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.detect import chunks, items, paste_error
from quirework.functions.freetext import parse
from quirework.functions.text import doi_lookup, trim
from quirework.operators.aggregate import first_per_group
from quirework.schema import PASTE_CAP, PASTE_UNITS
from quirework.sources.bibtex import read_bibtex
from quirework.sources.resolve import resolve_dois, resolve_pmids


def paste_items(pastes: DataFrame, cap: int = PASTE_CAP) -> DataFrame:
    """DET-1 to DET-6: pastes (paste_id, text) as items: paste_id, pos, format, value, raw, fallback, overflow.

    Pastes that are blank, too large or LaTeX documents give no items; paste_errors() tells which.
    """
    good = pastes.where(paste_error(F.col("text"), PASTE_UNITS).isNull())
    each = good.select("paste_id", F.posexplode(chunks(F.col("text"))).alias("chunk_pos", "chunk"))
    split = each.select("paste_id", "chunk_pos", F.posexplode(items(F.col("chunk"))).alias("item_pos", "item"))
    # A position that orders items: chunks and items are far fewer than 2**31 in one text.
    pos = F.shiftleft(F.col("chunk_pos").cast("long"), 31) + F.col("item_pos")
    flat = split.select("paste_id", pos.alias("pos"), "item.*")
    return first_per_group(flat, "paste_id", "pos", cap)


def paste_errors(pastes: DataFrame) -> DataFrame:
    """(paste_id, error): empty, too_large or latex_document."""
    blank = F.coalesce(trim(F.col("text")), F.lit("")) == ""
    error = F.when(blank, "empty").otherwise(paste_error(F.col("text"), PASTE_UNITS))
    return pastes.select("paste_id", error.alias("error")).where("error IS NOT NULL")


def without_known_dois(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DET-7: (items to resolve, skipped items). known: paste_id, DOI of what the bibliography has.

    Known DOIs leave before any lookup.
    """
    keyed = found.withColumn("lookup", F.when(F.col("format") == "doi", doi_lookup(F.col("value"))))
    have = known.select("paste_id", doi_lookup(F.col("DOI")).alias("lookup")).where("lookup <> ''").distinct()
    return keyed.join(have, ["paste_id", "lookup"], "left_anti"), keyed.join(have, ["paste_id", "lookup"], "left_semi")


def parsed(found: DataFrame, doi_metadata: DataFrame, pmid_metadata: DataFrame) -> DataFrame:
    """DET-8: items with a record in ``csl_json`` or ``record``, and the way it was found in ``input_format``.

    An identifier that was found inside a longer text and is not in the lookup tables falls back to the
    free-text rules on the whole text; what nothing can read has input_format null.
    """
    todo = found.where("not overflow")
    looked = resolve_pmids(resolve_dois(todo, doi_metadata), pmid_metadata)
    fallback = F.when(F.col("format") == "freetext", F.col("value")).otherwise(F.col("fallback"))
    rows = looked.withColumn("record", F.when(F.col("csl_json").isNull(), parse(fallback)))
    kind = (
        F.when(F.col("csl_json").isNotNull(), F.col("format"))
        .when(F.col("record").isNotNull(), "freetext")
        .when((F.col("format") == "bibtex") & F.col("value").rlike(r"(?s)\A\s*@"), "bibtex")
    )
    return rows.withColumn("input_format", kind)


def remaining_input(found: DataFrame, failed: DataFrame) -> DataFrame:
    """DET-9: per paste, what is over the cap, then what failed, parted by blank lines."""
    rows = found.where("overflow").select("paste_id", F.lit(0).alias("kind"), "pos", "raw")
    rows = rows.unionByName(failed.select("paste_id", F.lit(1).alias("kind"), "pos", "raw"))
    listed = F.array_sort(F.collect_list(F.struct("kind", "pos", "raw")))
    return rows.groupBy("paste_id").agg(F.array_join(F.transform(listed, lambda r: r["raw"]), "\n\n").alias("remaining_input"))


def bibtex_entries(found: DataFrame) -> DataFrame:
    """The BibTeX items' entries as records: paste_id, pos and the reader's columns."""
    return read_bibtex(found.where("format = 'bibtex' and not overflow"), ["paste_id", "pos"], "value")
