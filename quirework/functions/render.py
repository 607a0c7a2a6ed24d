"""Rendering: three layouts as one expression each, display text, italic segments and link parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import WS, S, blank_to_null, formatted, let, style_fixes, year_of
from quirework.schema import style as style_row

#: The item types whose titles stand in quotation marks.
QUOTED_TYPES = (
    "article-journal", "article-magazine", "article-newspaper", "chapter", "paper-conference", "post", "post-weblog",
    "review", "review-book", "webpage",
)
#: The item types whose own title is in italics, and those whose container's is.
ITALIC_TITLE = (
    "book", "broadcast", "collection", "dataset", "entry-dictionary", "entry-encyclopedia", "graphic", "interview",
    "legal_case", "legislation", "manuscript", "map", "motion_picture", "musical_score", "pamphlet", "patent",
    "performance", "periodical", "regulation", "report", "software", "song", "speech", "standard", "thesis", "treaty",
    "webpage",
)
ITALIC_CONTAINER = (
    "article-journal", "article-magazine", "article-newspaper", "chapter", "entry", "paper-conference", "post",
    "post-weblog", "review", "review-book",
)
NO_DATE = "n.d."


def initials(given: Column) -> Column:
    """'Mary Jo-Ann' becomes 'M. J.-A.'."""
    words = F.filter(F.split(given, rf"{S}+"), lambda w: w != "")

    def one(word: Column) -> Column:
        parts = F.filter(F.split(word, "-"), lambda p: p != "")
        return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), "-")

    return F.array_join(F.transform(words, one), " ")


def rendered_name(n: Column, family_first: bool) -> Column:
    given, family = blank_to_null(initials(n["given"])), blank_to_null(n["family"])
    parts = (family, given) if family_first else (given, family)
    return F.coalesce(blank_to_null(n["literal"]), F.concat_ws(", " if family_first else " ", *parts))


def rendered_names(names: Column, family_first: bool) -> Column:
    shown = F.filter(F.transform(names, lambda n: rendered_name(n, family_first)), lambda x: x != "")
    return blank_to_null(F.array_join(shown, ", "))


def contributors(author: Column, editor: Column, family_first: bool) -> Column:
    """Authors, else editors with their label; null if there are neither."""
    label = F.when(F.size(editor) > 1, ", eds.").otherwise(", ed.")
    return F.coalesce(rendered_names(author, family_first), F.concat(rendered_names(editor, family_first), label))


def ended(value: Column, sign: str) -> Column:
    """value with a closing sign, unless a full stop would be doubled."""
    doubled = value.rlike(r"[.!?]\z") | value.rlike(r"[.!?]”\z")
    return F.when(doubled, value).otherwise(F.concat(value, F.lit(sign))) if sign == "." else F.concat(value, F.lit(sign))


def layout(template: str, c: dict[str, Column]) -> Column:
    """The text of one record in a layout. c: columns by field.

    A title that stands in for the contributors is not given twice; a full stop is never doubled and goes
    inside a closing quotation mark.
    """
    title = blank_to_null(c["title"])
    quoted = F.concat(F.lit("“"), F.when(title.rlike(r"[.!?]\z"), title).otherwise(F.concat(title, F.lit("."))), F.lit("”"))
    shown_title = F.when(c["type"].isin(*QUOTED_TYPES), quoted).otherwise(ended(title, "."))
    container = ended(blank_to_null(c["container_title"]), ".")
    publisher = blank_to_null(c["publisher"])
    year = ended(F.coalesce(year_of(c["issued"]).cast("string"), F.lit(NO_DATE)), ".")
    access = F.coalesce(F.concat(F.lit("https://doi.org/"), blank_to_null(c["DOI"])), blank_to_null(c["URL"]))

    def whole(people: Column) -> Column:
        head = ended(F.coalesce(people, title), ".")
        heading = F.when(people.isNotNull(), shown_title)
        parts = {
            "author-date": [head, year, heading, container, ended(publisher, ".")],
            "notes": [head, heading, container, ended(publisher, ","), year],
            "numeric": [head, heading, container, year],
        }[template]
        return F.concat_ws(" ", *parts, F.concat(access, F.lit(".")))

    return let(contributors(c["author"], c["editor"], template != "numeric"), whole)


def render(style: str, c: dict[str, Column]) -> Column:
    """FMT-1: a record's text in a style; every record is rendered, however many a bibliography has."""
    return layout(style_row(style)["template"], c)


def render_any(style: Column, template: Column, c: dict[str, Column]) -> Column:
    """FMT-1 with the style in a column; template comes from the style dimension."""
    return F.when(template == "author-date", layout("author-date", c)).when(template == "numeric", layout("numeric", c)).otherwise(
        layout("notes", c)
    )


def from_formatter(text: Column, style: Column, family: Column) -> Column:
    """FMT-2: text that another formatter rendered, as it is stored."""
    return style_fixes(formatted(text), style, family)


def display_text(override: Column, stored: Column, title: Column) -> Column:
    """FMT-4: what a reader sees; empty strings count as missing."""
    return F.coalesce(blank_to_null(override), blank_to_null(stored), blank_to_null(title), F.lit(""))


def segments(display: Column, override: Column, type_: Column, title: Column, container: Column) -> Column:
    """FMT-5: array<struct<text, italic>>. The last occurrence that is not in quotation marks is in italics."""
    value = F.when(type_.isin(*ITALIC_TITLE), title).when(type_.isin(*ITALIC_CONTAINER), container)
    wanted = F.when(blank_to_null(override).isNull(), blank_to_null(value))
    return let(display, lambda text: let(wanted, lambda v: _cut_out(text, v)))


def _cut_out(display: Column, v: Column) -> Column:
    """display as segments, of which the last occurrence of v that is not in quotation marks is in italics."""
    # Read from the right: what parts the reversed text at the reversed value gives the places of occurrences.
    size, whole = F.length(v), F.length(display)
    pieces = F.split(F.reverse(display), F.concat(F.lit("\\Q"), F.reverse(v), F.lit("\\E")), -1)

    def segment(text: Column, italic: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(italic).alias("italic"))

    def quoted(i: Column) -> Column:
        left = F.substring(display, F.greatest(i - 1, F.lit(1)), F.least(i - 1, F.lit(1)))
        return left.isin('"', "“") & F.substring(display, i + size, F.lit(1)).isin('"', "”")

    def last(gaps: Column) -> Column:
        place = lambda i: whole - F.length(F.array_join(F.slice(gaps, F.lit(1), i), "")) - i * size + 1
        places = F.transform(F.sequence(F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(1))), place)
        return F.get(F.filter(places, lambda i: ~quoted(i)), 0)

    def cut(at: Column) -> Column:
        before, after = F.substring(display, F.lit(1), at - 1), F.substring(display, at + size, F.length(display))
        three = F.array(segment(before, False), segment(v, True), segment(after, False))
        return F.when(at.isNotNull(), F.filter(three, lambda s: s["text"] != ""))

    found = F.when(display.contains(v), let(let(pieces, last), cut))
    return F.coalesce(found, F.array(segment(display, False)))


LINK = "struct<text:string,href:string,link:boolean>"


def trimmed_link(url: Column) -> Column:
    """FMT-6: an address without the punctuation that follows it; closing brackets that it opens stay.

    Of what follows, the first so many closing brackets stay as the address opens and does not close, with what stands between.
    """

    def of(tail: Column) -> Column:
        head = F.substring(url, F.lit(1), F.length(url) - F.length(tail))
        many = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
        open_ = F.least(F.greatest(many(head, "(") - many(head, ")"), F.lit(0)), many(tail, ")"))
        kept = F.concat(F.call_function("substring_index", tail, F.lit(")"), open_), F.lit(")"))
        return F.when(open_ > 0, F.concat(head, kept)).otherwise(head)

    return let(F.regexp_extract(url, r"[.,;:!?)]*\z", 0), of)


def link_parts(text: Column) -> Column:
    """FMT-6: array<struct<text, href, link>> of a text; only http and https addresses link."""
    pattern = rf"(?i)https?://[^{WS}]+"
    none = F.lit(None).cast("string")

    def part(value: Column, href: Column, link: bool) -> Column:
        return F.struct(value.alias("text"), href.alias("href"), F.lit(link).alias("link")).cast(LINK)

    def whole(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        urls = F.concat(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.array(F.lit("")))

        def pieces(gap: Column, url: Column) -> Column:
            def of(href: Column) -> Column:
                rest = F.substring(url, F.length(href) + 1, F.length(url))
                linked = href.rlike(r"(?i)\Ahttps?://[^/?#]")
                middle = F.when(linked, F.array(part(href, href, True), part(rest, none, False))).otherwise(F.array(part(url, none, False)))
                return F.filter(F.concat(F.array(part(gap, none, False)), middle), lambda p: p["text"] != "")

            return let(trimmed_link(url), of)

        return F.flatten(F.zip_with(gaps, urls, pieces))

    empty = F.array(part(F.lit(""), none, False))
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(let(text, whole))
