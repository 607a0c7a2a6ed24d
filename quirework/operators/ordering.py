"""Ordering within bibliographies. Every order ends with the stored position, so it is stable.

Sort keys are columns with an ICU collation of primary strength: case and accents do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import blank_to_null, year_of
from quirework.schema import style as style_row

#: What stands after every name: a record without author, editor and title sorts last.
LAST = "￿"


def collation_of(locale: str) -> str:
    return "pt_CI_AI" if locale.startswith("pt") else "en_CI_AI"


def people(author: Column, editor: Column) -> Column:
    return F.when(F.size(author) > 0, author).when(F.size(editor) > 0, editor)


def title_key(title: Column) -> Column:
    """SRT-6: without a leading English article, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\A(?:a|an|the)\s+", ""))


def author_key(names: Column, title: Column) -> Column:
    """SRT-5: the first name; a record without names sorts by its title."""
    first = F.get(names, 0)
    named = F.lower(F.coalesce(blank_to_null(first["family"]), blank_to_null(first["literal"]), F.lit("")))
    return F.when(names.isNotNull(), named).otherwise(F.coalesce(blank_to_null(title_key(title)), F.lit(LAST)))


def chain_of(names: Column) -> Column:
    """SRT-8: 'family|given' of each name, or its literal."""

    def one(n: Column) -> Column:
        low = lambda k: F.lower(F.trim(F.coalesce(n[k], F.lit(""))))
        personal = blank_to_null(n["family"]).isNotNull() | blank_to_null(n["given"]).isNotNull()
        return F.when(personal, F.concat_ws("|", low("family"), low("given"))).otherwise(low("literal"))

    return F.transform(names, one)


def sort_columns(style: str, pos: str = "pos") -> list[Column]:
    """SRT-2, 3, 4: what to order by, for the style's family. Expects author, editor, title and issued."""
    row = style_row(style)
    collation = collation_of(row["locale"])
    names = people(F.col("author"), F.col("editor"))
    title, year = F.collate(title_key(F.col("title")), collation), year_of(F.col("issued"))
    first = F.collate(author_key(names, F.col("title")), collation)
    if row["family"] == "numeric":
        return [F.col(pos)]
    if row["family"] == "notes":
        return [first, title, year.asc_nulls_last(), F.col(pos)]
    chain = chain_of(names)
    head = F.collate(F.coalesce(F.get(chain, 0), author_key(names, F.col("title"))), collation)
    rest = F.slice(chain, 2, F.greatest(F.size(chain), F.lit(1))).cast(f"array<string collate {collation}>")
    # Undated works by the same authors stay in stored order: their titles are not compared.
    by_title = F.when(year.isNotNull(), title)
    return [head, F.coalesce(F.size(chain) > 1, F.lit(False)), rest, year.asc_nulls_last(), by_title, F.col(pos)]


def sorted_citations(citations: DataFrame, style: str, out: str = "position") -> DataFrame:
    """SRT-1: citations with their place in their bibliography, from 0; rows are not moved."""
    window = Window.partitionBy("bibliography_id").orderBy(*sort_columns(style))
    return citations.withColumn(out, (F.row_number().over(window) - 1).cast("long"))


def sorted_by_own_style(citations: DataFrame, styles: list[str], out: str = "position") -> DataFrame:
    """SRT-1 where each row names its bibliography's style: one branch per style, one row each in the result."""
    parts = [sorted_citations(citations.where(F.col("style") == s), s, out) for s in styles]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def exact_order(citations: DataFrame, style: str) -> DataFrame:
    """(bibliography_id, ids): the author-date comparator in full, one bibliography at a time.

    A record without names compares by family name with others, and by chain only among records with names.
    """
    if style_row(style)["family"] != "author-date":
        placed = sorted_citations(citations, style)
        pairs = F.array_sort(F.collect_list(F.struct("position", "id")))
        return placed.groupBy("bibliography_id").agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))
    collation = collation_of(style_row(style)["locale"])
    names = people(F.col("author"), F.col("editor"))
    chain = F.coalesce(chain_of(names), F.expr("cast(array() as array<string>)"))
    year = F.coalesce(year_of(F.col("issued")), F.lit(2**31 - 1))
    row = F.struct(
        chain.alias("chain"), author_key(names, F.col("title")).alias("first"), year.alias("year"),
        title_key(F.col("title")).alias("title"), F.col("pos").alias("pos"), F.col("id").alias("id"),
    )

    def compare(left: Column, right: Column) -> Column:
        def text(a: Column, b: Column) -> Column:
            a, b = F.collate(a, collation), F.collate(b, collation)
            return F.when(a < b, -1).when(a > b, 1).otherwise(0)

        def number(a: Column, b: Column) -> Column:
            return F.when(a < b, -1).when(a > b, 1).otherwise(0)

        a, b = left["chain"], right["chain"]
        both = (F.size(a) > 0) & (F.size(b) > 0)
        kind = f"array<string collate {collation}>"
        ra, rb = F.slice(a, 2, F.greatest(F.size(a), F.lit(1))).cast(kind), F.slice(b, 2, F.greatest(F.size(b), F.lit(1))).cast(kind)
        rest = F.when(ra < rb, -1).when(ra > rb, 1).otherwise(0)
        chains = F.coalesce(
            *[F.nullif(x, F.lit(0)) for x in (text(F.get(a, 0), F.get(b, 0)), number((F.size(a) > 1).cast("int"), (F.size(b) > 1).cast("int")), rest)],
            F.lit(0),
        )
        head = F.when(both, chains).otherwise(text(left["first"], right["first"]))
        undated = (left["year"] == 2**31 - 1) & (right["year"] == 2**31 - 1)
        steps = [head, number(left["year"], right["year"]), F.when(~undated, text(left["title"], right["title"])), number(left["pos"], right["pos"])]
        return F.coalesce(*[F.nullif(s, F.lit(0)) for s in steps], F.lit(0))

    rows = citations.groupBy("bibliography_id").agg(F.collect_list(row).alias("rows"))
    return rows.select("bibliography_id", F.transform(F.array_sort("rows", compare), lambda r: r["id"]).alias("ids"))
