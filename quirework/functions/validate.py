"""Validation as columns: a sanitised record and an array of errors, never an exception per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import WS, blank_to_null, manual_doi, manual_url, strip_markup, strip_tags, trim
from quirework.schema import CSL_TYPES, DATE, FIELD_BYTES, NAME, column_name

MODES = ("lenient", "strict")


def clean_date(date: Column) -> Column:
    """VAL-4: date parts that are not empty; null unless there are some, or a literal or raw text."""
    parts = F.filter(
        F.transform(date["date_parts"], lambda p: F.filter(p, lambda x: x.isNotNull())), lambda p: p.isNotNull() & (F.size(p) > 0)
    )
    parts = F.when(F.size(parts) > 0, parts)
    some = parts.isNotNull() | date["literal"].isNotNull() | date["raw"].isNotNull()
    return F.when(some, F.struct(parts.alias("date_parts"), date["literal"].alias("literal"), date["raw"].alias("raw")).cast(DATE))


def clean_names(names: Column, mode: str) -> Column:
    """Names with at least one part; the strict mode strips markup from their parts."""
    clean = strip_markup if mode == "strict" else lambda v: v
    fields = ("family", "given", "literal", "ORCID")
    made = F.transform(names, lambda n: F.struct(*[clean(n[k]).alias(k) for k in fields]).cast(NAME))
    return F.filter(made, lambda n: F.coalesce(*[n[k] for k in fields]).isNotNull())


def clean_text(value: Column, mode: str) -> Column:
    return strip_markup(value) if mode == "strict" else strip_tags(value)


def largest_text(c: dict[str, Column]) -> Column:
    """VAL-3: UTF-8 bytes of a record's longest text, those in names, dates and lists among them."""
    most = lambda texts: F.array_max(F.transform(texts, F.octet_length))
    sizes = []
    for field, value in c.items():
        if field in ("author", "editor", "reviewed_author"):
            sizes.append(F.array_max(F.transform(value, lambda n: F.greatest(*[F.octet_length(n[k]) for k in ("family", "given", "literal", "ORCID")]))))
        elif field in ("issued", "accessed"):
            sizes += [F.octet_length(value["literal"]), F.octet_length(value["raw"])]
        else:
            sizes.append(most(value) if field in ("ISBN", "ISSN") else F.octet_length(value))
    return F.greatest(*sizes, F.lit(0))


def errors(c: dict[str, Column], mode: str) -> Column:
    """VAL-1, VAL-2, VAL-3: what makes a record invalid; an empty array if nothing does."""
    found = [
        F.when(c["type"].isNull() | (c["type"] == ""), "type_missing"),
        F.when(~c["type"].isin(*CSL_TYPES) & (c["type"] != ""), "type_unknown"),
    ]
    for field in ("issued", "accessed"):
        found.append(F.when(c[field].isNotNull() & clean_date(c[field]).isNull(), f"{field}_invalid"))
    for field in ("author", "editor", "reviewed-author"):
        names = c[column_name(field)]
        empty = F.exists(names, lambda n: F.coalesce(n["family"], n["given"], n["literal"]).isNull())
        found.append(F.when(empty, f"{field}_invalid"))
    if mode == "strict":
        found.append(F.when(largest_text(c) > FIELD_BYTES, "field_too_large"))
    return F.array_compact(F.array(*found))


def manual_error(fields: dict[str, Column]) -> Column:
    """VAL-5: the first thing wrong with a form row, or null."""
    given = lambda k: F.coalesce(trim(fields[k]), F.lit(""))
    return (
        F.when(given("type") == "", "type_required")
        .when(given("title") == "", "title_required")
        .when((given("doi") != "") & manual_doi(fields["doi"]).isNull(), "doi_invalid")
        .when((given("url") != "") & manual_url(fields["url"]).isNull(), "url_invalid")
    )


def raw_link_text(title: Column, url: Column, doi: Column) -> Column:
    """Whether a record links under no title, or under a bare address."""
    link = F.coalesce(blank_to_null(url), blank_to_null(doi))
    bare = trim(title).rlike(rf"\A(?i)(?:https?://[^{WS}]+|10\.[0-9]{{4,}}/[^{WS}]+)\z")
    return link.isNotNull() & (F.coalesce(title, F.lit("")).eqNullSafe("") | F.coalesce(bare, F.lit(False)))


def linkable(url: Column) -> Column:
    """VAL-7: http and https addresses only."""
    return F.coalesce(url.rlike(rf"\A(?i)https?://[^{WS}/?#]"), F.lit(False))


def readable(status: Column, password: Column, type_viewable: Column, may_edit: Column) -> Column:
    """VAL-8: published posts of viewable types without a password are open; all others need the right to edit."""
    is_open = (status == "publish") & type_viewable & (F.coalesce(password, F.lit("")) == "")
    return F.coalesce(is_open, F.lit(False)) | F.coalesce(may_edit, F.lit(False))
