"""The data model: citations as flat columns, names and dates as structs, styles as a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "struct<family:string,given:string,literal:string,ORCID:string>"
NAMES = f"array<{NAME}>"
DATE = "struct<date_parts:array<array<int>>,literal:string,raw:string>"

#: The item types of the CSL 1.0.2 vocabulary that records may have.
CSL_TYPES = (
    "article", "article-journal", "article-magazine", "article-newspaper", "bill", "book", "broadcast", "chapter",
    "classic", "collection", "dataset", "document", "entry", "entry-dictionary", "entry-encyclopedia", "event",
    "figure", "graphic", "hearing", "interview", "legal_case", "legislation", "magazine", "manuscript", "map", "motion_picture",
    "musical_score", "pamphlet", "paper-conference", "patent", "performance", "periodical", "personal_communication",
    "post", "post-weblog", "regulation", "report", "review", "review-book", "software", "song", "speech", "standard",
    "thesis", "treaty", "webpage",
)

#: The typed fields of a record, by their CSL names.
STRING_FIELDS = (
    "type", "title", "container-title", "publisher", "page", "volume", "issue", "DOI", "URL", "language", "edition",
    "medium", "genre", "publisher-place", "event-place", "reviewed-title",
)
LIST_FIELDS = ("ISBN", "ISSN")
NAME_FIELDS = ("author", "editor", "reviewed-author")
DATE_FIELDS = ("issued", "accessed")


def column_name(field: str) -> str:
    """A CSL field's column: hyphens become underscores."""
    return field.replace("-", "_")


CSL_COLUMNS = (
    {column_name(f): "string" for f in STRING_FIELDS}
    | {f: "array<string>" for f in LIST_FIELDS}
    | {column_name(f): NAMES for f in NAME_FIELDS}
    | {f: DATE for f in DATE_FIELDS}
)
CITATION_COLUMNS = {"bibliography_id": "bigint", "pos": "bigint", "id": "string"} | CSL_COLUMNS | {
    "display_override": "string",
    "formatted_text": "string",
    "input_format": "string",
    "parse_warnings": "array<string>",
    "export_bibtex": "string",
    "export_biblatex": "string",
}
INPUT_FORMATS = ("doi", "pmid", "bibtex", "freetext", "manual")


#: The citation schema as DDL.
CITATION_DDL = ", ".join(f"`{k}` {v}" for k, v in CITATION_COLUMNS.items())

STYLE_COLUMNS = "style string, label string, template string, list_type string, family string, locale string, heading string"
DEFAULT_STYLE = "chicago-notes-bibliography"
#: The nine styles.
STYLES = (
    ("chicago-notes-bibliography", "Chicago Notes-Bibliography", "notes", "ul", "notes", "en-US", "Bibliography"),
    ("chicago-author-date", "Chicago Author-Date", "author-date", "ul", "author-date", "en-US", "References"),
    ("apa-7", "APA 7", "author-date", "ul", "author-date", "en-US", "References"),
    ("mla-9", "MLA 9", "notes", "ul", "author-date", "en-US", "Works Cited"),
    ("harvard", "Harvard", "author-date", "ul", "author-date", "en-US", "References"),
    ("ieee", "IEEE", "numeric", "ol", "numeric", "en-US", "References"),
    ("vancouver", "Vancouver", "numeric", "ol", "numeric", "en-US", "References"),
    ("oscola", "OSCOLA", "notes", "ul", "notes", "en-GB", "Bibliography"),
    ("abnt", "ABNT", "author-date", "ul", "author-date", "pt-BR", "Referências"),
)


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STYLES), STYLE_COLUMNS)


def with_styles(rows: DataFrame, key: str) -> DataFrame:
    """rows with the columns of their style, by a column of its key; an unknown or null key has the default style's."""
    table = styles(rows.sparkSession)
    known = F.when(F.col(key).isin(*[row[0] for row in STYLES]), F.col(key)).otherwise(DEFAULT_STYLE)
    # Nine rows.
    return rows.join(F.broadcast(table), known == table["style"])


def style(key: str | None) -> dict[str, str]:
    """A style's row; an unknown key has the default style's."""
    names = [c.split()[0] for c in STYLE_COLUMNS.split(", ")]
    rows = {row[0]: dict(zip(names, row, strict=True)) for row in STYLES}
    return rows.get(key or "", rows[DEFAULT_STYLE])


PASTE_CAP, SOFT_CAP, HARD_CAP = 50, 100, 200
REQUEST_ITEMS, REQUEST_BYTES, FIELD_BYTES, PASTE_UNITS = 50, 1_048_576, 65_536, 1_048_576
