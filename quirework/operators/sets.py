"""Appending, deleting, updating and moving citations: editor commands as pure functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.names import names_from_field
from quirework.functions.render import render
from quirework.functions.text import blank_to_null, trim
from quirework.operators.dedupe import first_duplicates
from quirework.operators.ordering import sorted_citations
from quirework.schema import CSL_COLUMNS, DATE
from quirework.schema import style as style_row


def csl(columns: list[str] | None = None, prefix: str = "") -> dict[str, Column]:
    """The record's columns by field, as the functions take them."""
    return {k: F.col(f"{prefix}{k}") for k in CSL_COLUMNS if columns is None or k in columns}


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SET-1: new rows after the stored ones of their bibliography."""
    last = existing.groupBy("bibliography_id").agg((F.max("pos") + 1).alias("_from"))
    place = Window.partitionBy("bibliography_id").orderBy("pos")
    moved = (
        new.join(last, "bibliography_id", "left")
        .withColumn("pos", (F.coalesce("_from", F.lit(0)) + F.row_number().over(place) - 1).cast("long"))
        .drop("_from")
    )
    return existing.unionByName(moved, allowMissingColumns=True)


def delete(citations: DataFrame, ids: DataFrame) -> DataFrame:
    """SET-2, MUT-6: without the rows whose id is in ids; positions close up."""
    left = citations.join(ids.select("id"), "id", "left_anti")
    place = Window.partitionBy("bibliography_id").orderBy("pos")
    return left.withColumn("pos", (F.row_number().over(place) - 1).cast("long"))


def update(citations: DataFrame, patches: DataFrame) -> DataFrame:
    """SET-3: columns of patches (keyed by id, one row each) replace those of the same name; null leaves a value."""
    fields = [c for c in patches.columns if c != "id"]
    renamed = patches.select("id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = citations.join(renamed, "id", "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in citations.columns])


#: The form fields that an edit sets, and the columns they go to.
FORM = {
    "title": "title", "containerTitle": "container_title", "publisher": "publisher", "page": "page", "doi": "DOI", "url": "URL",
}


def edit_fields(citations: DataFrame, forms: DataFrame) -> DataFrame:
    """MUT-3: forms (id, authors, year and FORM's fields) replace eight fields; blank ones are deleted.

    The override and the warnings go, as they spoke of the record before.
    """
    joined = citations.join(forms.select("id", *[F.col(c).alias(f"_f_{c}") for c in forms.columns if c != "id"]), "id", "left")
    hit = F.coalesce(*[F.col(f"_f_{c}").isNotNull() for c in forms.columns if c != "id"], F.lit(False)) & F.col("_f_title").isNotNull()
    new: dict[str, Column] = {to: blank_to_null(trim(F.col(f"_f_{name}"))) for name, to in FORM.items()}
    people = F.when(F.size(names_from_field(F.col("_f_authors"))) > 0, names_from_field(F.col("_f_authors")))
    edited = F.col("type") == "collection"
    new["author"] = F.when(edited, F.col("author")).otherwise(people)
    new["editor"] = F.when(edited, people).otherwise(F.col("editor"))
    none = F.lit(None).cast("string")
    date = F.struct(F.array(F.array(F.col("_f_year").try_cast("int"))).alias("date_parts"), none.alias("literal"), none.alias("raw")).cast(DATE)
    new["issued"] = F.when(trim(F.col("_f_year")).rlike(r"\A[0-9]{4}\z"), date)
    new["display_override"], new["parse_warnings"] = none, F.expr("cast(array() as array<string>)")
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in citations.columns])


def override_text(citations: DataFrame, texts: DataFrame) -> DataFrame:
    """MUT-4: texts (id, text) become overrides; one that equals the automatic text removes the override."""
    joined = citations.join(texts.select("id", F.col("text").alias("_text")), "id", "left")
    automatic = F.coalesce(blank_to_null(F.col("formatted_text")), F.col("title"), F.lit(""))
    value = F.when(F.col("_text").isNull(), F.col("display_override")).when(trim(F.col("_text")) != automatic, blank_to_null(trim(F.col("_text"))))
    return joined.withColumn("display_override", value).select(*citations.columns)


def reset_override(citations: DataFrame, ids: DataFrame) -> DataFrame:
    """MUT-5."""
    joined = citations.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    value = F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("display_override"))
    return joined.withColumn("display_override", value).select(*citations.columns)


def move(citations: DataFrame, moves: DataFrame) -> DataFrame:
    """WIN-2, MUT-7: moves (bibliography_id, pos, step of 1 or -1) swap neighbours; a step over the end does nothing."""
    m = moves.select("bibliography_id", F.col("pos").alias("_at"), (F.col("pos") + F.col("step")).alias("_to"))
    sizes = citations.groupBy("bibliography_id").agg(F.max("pos").alias("_last"))
    m = m.join(sizes, "bibliography_id").where("_to >= 0 and _to <= _last and _at >= 0 and _at <= _last").drop("_last")
    joined = citations.join(m, "bibliography_id", "left")
    place = F.when(F.col("pos") == F.col("_at"), F.col("_to")).when(F.col("pos") == F.col("_to"), F.col("_at")).otherwise(F.col("pos"))
    return joined.withColumn("pos", place).select(*citations.columns)


def formatted_in(citations: DataFrame, style: str) -> DataFrame:
    """FMT-7, MUT-8: every record rendered anew; overrides stay."""
    return citations.withColumn("formatted_text", render(style, csl()))


def change_heading(bibliographies: DataFrame, old: str, new: str) -> DataFrame:
    """MUT-8: the heading follows the style if it is the old style's default or blank."""
    before, after = style_row(old)["heading"], style_row(new)["heading"]
    kept = trim(F.coalesce("heading_text", F.lit("")))
    heading = F.when((kept == before) | (kept == ""), after).otherwise(F.col("heading_text"))
    return bibliographies.withColumn("heading_text", heading).withColumn("citation_style", F.lit(new))


def add_manual(existing: DataFrame, rows: DataFrame, style: str) -> DataFrame:
    """MUT-2: rows that duplicate none of the stored ones, appended and rendered."""
    known = first_duplicates(rows, existing).select("bibliography_id", "pos")
    fresh = rows.join(known, ["bibliography_id", "pos"], "left_anti")
    return resorted(formatted_in(append(existing, fresh), style), style)


def resorted(citations: DataFrame, style: str) -> DataFrame:
    """MUT-10: stored positions become the style's order."""
    return sorted_citations(citations, style, "_position").withColumn("pos", F.col("_position")).drop("_position")


def next_focus(citations: DataFrame, deleted: DataFrame) -> DataFrame:
    """WIN-4: for each deleted id the id that takes its place, else the one before, else null."""
    place = Window.partitionBy("bibliography_id").orderBy("pos")
    near = citations.withColumn("focus", F.coalesce(F.lead("id").over(place), F.lag("id").over(place)))
    return near.join(deleted.select("id"), "id", "left_semi").select("bibliography_id", "id", "focus")
