"""Saved posts: bibliography blocks in their content, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.schema import CITATION_COLUMNS, DATE, DEFAULT_STYLE, NAMES

#: Which block types hold a bibliography, as a pattern: those of that name, whoever registered them.
BLOCK = r"[a-z][a-z0-9-]*/bibliography"
#: The JSON of one stored citation: CSL fields keep their names with hyphens.
CSL_JSON = (
    "id string, type string, title string, `container-title` string, publisher string, page string, volume string, "
    "issue string, DOI string, URL string, language string, edition string, medium string, genre string, "
    "`publisher-place` string, `event-place` string, `reviewed-title` string, ISBN string, ISSN string, "
    f"author {NAMES}, editor {NAMES}, `reviewed-author` {NAMES}, "
    "issued struct<`date-parts`:array<array<int>>,literal:string,raw:string>, "
    "accessed struct<`date-parts`:array<array<int>>,literal:string,raw:string>"
)
ATTRIBUTES = (
    "citationStyle string, headingText string, outputJsonLd boolean, outputCoins boolean, outputCslJson boolean, "
    "outputCiteExport boolean, bibliographyId string, citations string"
)
CITATION_JSON = (
    "id string, csl string, displayOverride string, formattedText string, inputFormat string, parseWarnings array<string>, "
    "exportBibtex string, exportBiblatex string"
)


def blocks(content: Column, block: str = BLOCK) -> Column:
    """SRC-1: the attribute JSON of every bibliography block in document order, nested ones too.

    The opening comments of blocks come in the order of a walk that visits a block before what it holds.
    """
    pattern = rf"(?s)<!--\s+wp:(?:{block})\s+(\{{.*?\}}\s+)?/?-->"
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda a: F.when(F.trim(a) == "", "{}").otherwise(F.trim(a)))


def bibliographies(posts: DataFrame, block: str = BLOCK) -> DataFrame:
    """SRC-2, SRC-3: one row per block: post_id, index, attributes with their defaults, entry_count, citations_json."""
    rows = posts.select("post_id", F.posexplode(blocks(F.col("content"), block)).alias("index", "attrs"))
    a = F.from_json("attrs", ATTRIBUTES)
    rows = rows.select("post_id", F.col("index").cast("long").alias("index"), a.alias("a"))
    listed = F.coalesce(F.from_json("a.citations", "array<string>"), F.expr("cast(array() as array<string>)"))
    return rows.select(
        "post_id",
        "index",
        F.coalesce("a.citationStyle", F.lit(DEFAULT_STYLE)).alias("citation_style"),
        F.coalesce("a.headingText", F.lit("")).alias("heading_text"),
        F.coalesce("a.outputJsonLd", F.lit(True)).alias("output_json_ld"),
        F.coalesce("a.outputCoins", F.lit(False)).alias("output_coins"),
        F.coalesce("a.outputCslJson", F.lit(False)).alias("output_csl_json"),
        F.coalesce("a.outputCiteExport", F.lit(False)).alias("output_cite_export"),
        F.size(listed).cast("long").alias("entry_count"),
        listed.alias("citations_json"),
    )


def string_list(value: Column) -> Column:
    """A string, or a JSON array of strings, as an array."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.expr("cast(array() as array<string>)")).when(value.startswith("["), listed).otherwise(F.array(value))


def csl_columns(json: Column) -> dict[str, Column]:
    """The typed columns of a CSL-JSON object; every column reads the same parse, which is bound once by callers."""
    names = {k: json[k.replace("_", "-") if k not in ("DOI", "URL") else k] for k in CITATION_COLUMNS if k in _CSL_STRINGS}
    dates = {
        k: F.when(
            json[k].isNotNull(),
            F.struct(json[k]["date-parts"].alias("date_parts"), json[k]["literal"].alias("literal"), json[k]["raw"].alias("raw")),
        ).cast(DATE)
        for k in ("issued", "accessed")
    }
    lists = {k: string_list(json[k]) for k in ("ISBN", "ISSN")}
    people = {"author": json["author"], "editor": json["editor"], "reviewed_author": json["reviewed-author"]}
    return names | lists | people | dates


_CSL_STRINGS = {k for k, t in CITATION_COLUMNS.items() if t == "string"} - {
    "id", "display_override", "formatted_text", "input_format", "export_bibtex", "export_biblatex",
}


def citations(blocks_: DataFrame) -> DataFrame:
    """The citations of bibliographies(), one row each, keyed by post_id, index and pos; csl_json keeps unknown members."""
    rows = blocks_.select("post_id", "index", "citation_style", F.posexplode("citations_json").alias("pos", "json"))
    rows = rows.select("post_id", "index", "citation_style", F.col("pos").cast("long").alias("pos"), F.from_json("json", CITATION_JSON).alias("c"))
    rows = rows.withColumn("k", F.from_json("c.csl", CSL_JSON))
    return rows.select(
        "post_id",
        "index",
        "citation_style",
        "pos",
        F.coalesce("c.id", "k.id").alias("id"),
        *[v.alias(n) for n, v in csl_columns(F.col("k")).items()],
        F.col("c.displayOverride").alias("display_override"),
        F.col("c.formattedText").alias("formatted_text"),
        F.col("c.inputFormat").alias("input_format"),
        F.col("c.parseWarnings").alias("parse_warnings"),
        F.col("c.exportBibtex").alias("export_bibtex"),
        F.col("c.exportBiblatex").alias("export_biblatex"),
        F.col("c.csl").alias("csl_json"),
    )
