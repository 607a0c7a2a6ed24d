"""Scalar normalisers. Patterns name Unicode white space, as the JVM's \\s is ASCII only."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space with the Unicode spaces, as a character class and as its inside.
WS = r"\s   -     　﻿"
S = f"[{WS}]"
DOI_URL = r"^(?i)(?:https?://)?(?:dx\.)?doi\.org/"
TAIL = rf"[).,;:{WS}]+\z"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def trim(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A{S}+|{S}+\z", "")


def collapse(value: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(value, f"{S}+", " "))


def doi_input(value: Column) -> Column:
    """NRM-1: trailing punctuation and a doi: prefix go; a doi.org address stays."""
    return F.regexp_replace(F.regexp_replace(trim(value), TAIL, ""), r"^(?i)(?:https?://)?doi:", "")


def doi_lookup(value: Column) -> Column:
    """NRM-2: the key by which a DOI is looked up."""
    return F.regexp_replace(F.lower(doi_input(value)), DOI_URL, "")


def doi_dedupe(value: Column) -> Column:
    """NRM-3: the key by which DOIs are compared for duplicates; a doi: prefix counts. Null if empty."""
    bare = F.regexp_replace(F.lower(collapse(value)), DOI_URL, "")
    return blank_to_null(F.regexp_replace(bare, TAIL, ""))


def manual_doi(value: Column) -> Column:
    """NRM-4: '' if blank, null if invalid."""
    bare = F.regexp_replace(F.regexp_replace(trim(value), TAIL, ""), r"^(?i)(?:https?://)?doi:", "")
    return F.when(F.coalesce(trim(value), F.lit("")) == "", "").when(bare.rlike(rf"\A10\.[0-9]{{4,}}/[^{WS}]+\z"), bare)


def manual_url(value: Column) -> Column:
    """NRM-4: '' if blank, null unless it is an http or https address."""
    bare = trim(value)
    good = bare.rlike(rf"\A(?i)https?://[^{WS}/?#]+[^{WS}]*\z")
    return F.when(F.coalesce(bare, F.lit("")) == "", "").when(good, bare)


def match_text(value: Column) -> Column:
    """NRM-5: lower case, letters, digits and single spaces; dropped signs may leave spaces next to each other."""
    return F.regexp_replace(F.lower(collapse(value)), rf"[^\p{{L}}\p{{N}}{WS}]", "")


def strip_tags(value: Column) -> Column:
    """NRM-10: without tags. One pass leaves none: no sign that opens a tag stays before one that would close it."""
    return F.regexp_replace(value, "<[^>]*>", "")


def strip_markup(value: Column) -> Column:
    """The strict variant: the bodies of script and style go too, and the ends are trimmed."""
    return trim(strip_tags(F.regexp_replace(value, r"(?is)<(script|style)[^>]*?>.*?</\1>", "")))


def bounded(value: Column, most: int = 65_536) -> Column:
    """NRM-11: at most ``most`` UTF-8 bytes, cut before a broken character, then without markup.

    A byte prefix of valid text can end inside one character only; decoding replaces that tail, and it goes.
    """
    raw = F.encode(value, "UTF-8")
    head = F.substring(raw, 1, most)
    # The tail of the cut: back to the last byte that begins a character.
    tails = F.array(*[F.hex(F.substring(raw, most + 1 - k, 1)) for k in range(0, 4)])
    begins = lambda h: ~F.conv(h, 16, 10).cast("int").between(128, 191)
    back = F.array_position(F.transform(tails, begins), True).cast("int") - 1
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(most) - F.greatest(back, F.lit(0))), "UTF-8")
    return strip_markup(F.when(F.octet_length(value) > most, cut).otherwise(F.decode(head, "UTF-8")))


def _entities() -> Column:
    """The named character references of HTML 5, as a constant map: the standard library's table."""
    named = {name: sign for name, sign in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(named)), "map<string,string>")


REFERENCE = "&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);"


def unescape(value: Column) -> Column:
    """Named and numeric character references, each decoded once; what names no character that HTML 5 allows stays."""

    def numbered(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9A-Fa-f]*);$", 1)
        point = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")

        def sign(p: Column) -> Column:
            text = p.isin(9, 10, 12) | p.between(0x20, 0x7E) | p.between(0xA0, 0xD7FF) | p.between(0xE000, 0xFDCF) | p.between(0xFDF0, 0x10FFFF)
            allowed = text & (p.bitwiseAND(0xFFFE) != 0xFFFE)
            return F.when(allowed, F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))

        return F.when(F.length(digits).between(1, 8), let(point, sign))

    def one(reference: Column) -> Column:
        named = F.element_at(_entities(), F.substring(reference, F.lit(2), F.length(reference)))
        return F.coalesce(F.when(reference.startswith("&#"), numbered(reference)).otherwise(named), reference)

    def whole(text: Column) -> Column:
        signs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one)
        return F.array_join(F.zip_with(F.split(text, REFERENCE, -1), signs, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")

    return F.when(value.contains("&"), let(value, whole)).otherwise(value)


def formatted(value: Column) -> Column:
    """NRM-12: decode references, strip markup within the bound, collapse white space."""
    return collapse(bounded(unescape(value)))


def style_fixes(value: Column, style: Column, family: Column) -> Column:
    """NRM-13: artefacts of formatters, by style."""
    numeric = F.regexp_replace(value, rf"^{S}*(?:\[[0-9]+\]|[0-9]+\.){S}*", "")
    abnt = value
    for bad, good in ((r"\bv\. vol\.", "v."), (r"\bn\. no\.", "n."), (r"\bp\. pp\.", "p.")):
        abnt = F.regexp_replace(abnt, bad, good)
    fixed = F.when(family == "numeric", numeric).when(style == "abnt", abnt).otherwise(value)
    return F.regexp_replace(fixed, r"\band et al\.", "et al.")


def page_bounds(page: Column) -> Column:
    """NRM-14: struct<first, last>; hyphens and dashes part the bounds."""
    parts = F.split(page, rf"{S}*[-–—]{S}*")
    return F.struct(blank_to_null(trim(F.get(parts, 0))).alias("first"), blank_to_null(trim(F.get(parts, 1))).alias("last"))


def iso_date(date: Column) -> Column:
    """NRM-15: year, then month and day with two digits, as far as they are known."""
    parts = F.get(date["date_parts"], 0)
    padded = F.transform(parts, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")))
    return blank_to_null(F.array_join(padded, "-"))


def year_of(date: Column) -> Column:
    """The first date part; a year of 0 counts as missing."""
    year = F.get(F.get(date["date_parts"], 0), 0)
    return F.when(year != 0, year)


def slug(key: Column, author: Column, year: Column, title: Column) -> Column:
    """NRM-16: a file name from the key, else author and year, else four title words, else 'citation'.

    Accents of Latin letters are folded by a table made from Unicode decompositions.
    """

    def clean(value: Column) -> Column:
        plain = F.regexp_replace(F.translate(value, *fold_table()), r"[^A-Za-z0-9_\s-]", "")
        plain = F.regexp_replace(F.regexp_replace(F.trim(plain), r"[\s_]+", "-"), "-{2,}", "-")
        return blank_to_null(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, 60))

    words = F.array_join(F.slice(F.split(title, f"{S}+"), 1, 4), " ")
    dated = F.concat_ws("-", blank_to_null(author), year.cast("string"))
    return F.coalesce(clean(key), clean(dated), clean(words), F.lit("citation"))


def fold_table() -> tuple[str, str]:
    """Latin letters with marks, and the plain letters that they decompose to."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def script_safe(json: Column) -> Column:
    """NRM-20: JSON that can stand inside a script element."""
    for sign, escape in (("<", "\\u003c"), (" ", "\\u2028"), (" ", "\\u2029")):
        json = F.replace(json, F.lit(sign), F.lit(escape))
    return json


def percent_encoded(value: Column) -> Column:
    """Percent-encoding of all but letters, digits and -_.!~*'()."""
    value = F.url_encode(value)
    for bad, good in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        value = F.replace(value, F.lit(bad), F.lit(good))
    return value


def primary(values: Column) -> Column:
    """NRM-17: the first string that is not empty."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), 0)
