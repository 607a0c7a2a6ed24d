"""Titles of book reviews that registries fill with the reviewed book's imprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import blank_to_null, collapse, let

#: A title that begins again repeats this many of its words at least.
REPEATED = 4


def _places(words: Column, test) -> Column:
    """The places of the words for which test(word, place) holds, ascending."""
    marked = F.transform(words, lambda w, i: F.when(test(w, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _marks(words: Column) -> Column:
    """Where a review's title may end: array<place>, each told by the words around it alone.

    A number before 'pp.' and the price that ends the title, or the sentence of place and year before that number; where the
    title's opening comes again, and a word that runs into another before that; and a word that begins with one of the
    names that come before the title.
    """
    n = F.size(words)
    at = lambda i: F.get(words, i)
    names_end = F.get(_places(words, lambda w, i: w.rlike(r"^\p{Lu}[\p{L}'’\-]+\.$") & (i < n - 1)), 0)

    def extents(_: Column) -> Column:
        price = lambda i: at(i + 2).rlike(r"^[$£€]?[0-9]|^[$£€]$") & ~F.exists(F.slice(words, i + 4, n), lambda w: w.rlike(r"\.$") & (w != at(n - 1)))
        counts = _places(words, lambda w, i: w.rlike("^[0-9]+$") & at(i + 1).rlike(r"^pp\.$") & price(i) & (i > 0))

        def imprint(i: Column) -> Column:
            stops = _places(words, lambda w, j: w.rlike(r"\.$") & (j < i - 1))
            start = F.coalesce(F.try_element_at(stops, F.lit(-1)) + 1, F.lit(0))
            told = F.array_join(F.slice(words, start + 1, i - start), " ")
            return F.when(told.rlike(r"^\p{Lu}[^.]*,\s[0-9]{4}\.$") & (start > 0), start).otherwise(i)

        return F.transform(counts, imprint)

    def of_title(first: Column) -> Column:
        opening = F.slice(words, first + 1, REPEATED)
        again = F.get(_places(words, lambda _, i: (i > first) & (i + REPEATED <= n) & (F.slice(words, i + 1, REPEATED) == opening)), 0)
        run = F.filter(_places(words, lambda w, i: (i > first) & w.rlike(r"^\p{Lu}\p{Ll}+\p{Lu}")), lambda i: i < again)
        names = F.filter(F.transform(F.slice(words, F.lit(1), first), lambda w: F.regexp_extract(w, r"^[\p{L}'’\-]{2,}", 0)), lambda x: x.rlike(r"^\p{Lu}"))
        into = _places(words, lambda w, i: (i > first) & F.exists(names, lambda x: w.startswith(x) & F.substring(w, F.length(x) + 1, F.lit(1)).rlike(r"\p{Lu}")))
        return F.array_compact(F.concat(F.array(again), F.coalesce(run, F.array().cast("array<int>")), into))

    inside = F.when(names_end.isNotNull(), let(names_end + 1, of_title)).otherwise(F.array().cast("array<int>"))
    return F.concat(extents(n), inside)


def review_title(type_: Column, title: Column, container: Column) -> Column:
    """NRM-8: titles of journal articles that show pages, a price or words run together end at the first of their marks."""
    shows = title.rlike(r"(?<![A-Za-z0-9_])[0-9]+\s+pp\.|[$£€]\s*[0-9]|[a-z][A-Z][a-z]")

    def cut(words: Column) -> Column:
        end = F.coalesce(F.array_min(_marks(words)), F.size(words))
        return F.regexp_replace(F.array_join(F.slice(words, F.lit(1), end), " "), r"\.$", "")

    wanted = (type_ == "article-journal") & blank_to_null(container).isNotNull() & shows
    return F.when(wanted, let(F.split(collapse(title), " "), cut)).otherwise(title)


def review_warnings(input_format: Column, type_: Column, container: Column, before: Column, after: Column, page: Column) -> Column:
    """NRM-9: a review found by DOI whose title had to change and that has no pages."""
    incomplete = (
        (input_format == "doi")
        & (type_ == "article-journal")
        & blank_to_null(container).isNotNull()
        & (before != after)
        & blank_to_null(page).isNull()
    )
    empty = F.expr("cast(array() as array<string>)")
    return F.when(F.coalesce(incomplete, F.lit(False)), F.array(F.lit("review-metadata-incomplete"))).otherwise(empty)
