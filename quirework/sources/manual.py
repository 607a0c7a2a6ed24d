"""Form rows as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.names import names_from_field
from quirework.functions.text import blank_to_null, manual_doi, manual_url, trim
from quirework.functions.validate import manual_error
from quirework.schema import DATE

FIELDS = ("type", "authors", "title", "containerTitle", "publisher", "year", "page", "doi", "url")


def manual_citations(forms: DataFrame) -> DataFrame:
    """SRC-11: forms (FIELDS and any other columns) as records, with ``error`` where a row is not valid."""
    f = {k: F.col(k) for k in FIELDS}
    text = lambda k: blank_to_null(trim(f[k]))
    people = F.when(F.size(names_from_field(f["authors"])) > 0, names_from_field(f["authors"]))
    edited = trim(f["type"]) == "collection"
    none = F.lit(None).cast("string")
    year = F.struct(F.array(F.array(trim(f["year"]).try_cast("int"))).alias("date_parts"), none.alias("literal"), none.alias("raw")).cast(DATE)
    others = [F.col(c) for c in forms.columns if c not in FIELDS]
    return forms.select(
        *others,
        text("type").alias("type"),
        text("title").alias("title"),
        text("containerTitle").alias("container_title"),
        text("publisher").alias("publisher"),
        text("page").alias("page"),
        blank_to_null(manual_doi(f["doi"])).alias("DOI"),
        blank_to_null(manual_url(f["url"])).alias("URL"),
        F.when(~F.coalesce(edited, F.lit(False)), people).alias("author"),
        F.when(edited, people).alias("editor"),
        F.when(trim(f["year"]).rlike(r"\A[0-9]{4}\z"), year).alias("issued"),
        F.lit("manual").alias("input_format"),
        manual_error(f).alias("error"),
    )
