"""Pieces of oracle SQL, in DuckDB's dialect, over the flat columns of CITES."""

from __future__ import annotations

from quirework.plans.cites import CITES

SENTINEL = "chr(65535)"
TS = r"lower(regexp_replace(title, '^(?i:a|an|the)\s+', ''))"
HAS_AUTHOR = "(family IS NOT NULL OR literal IS NOT NULL)"
A1 = f"CASE WHEN {HAS_AUTHOR} THEN lower(coalesce(family, literal)) WHEN family_e IS NOT NULL THEN lower(family_e) ELSE {TS} END"
HEAD = (
    f"CASE WHEN family IS NOT NULL THEN lower(family) || '|' || lower(given) WHEN literal IS NOT NULL THEN lower(literal) "
    f"WHEN family_e IS NOT NULL THEN lower(family_e) || '|' || lower(given_e) ELSE {TS} END"
)
ORDER = {
    "notes": f"{A1}, {TS}, year NULLS LAST, pos",
    "author-date": f"{HEAD}, family2 IS NOT NULL, coalesce(lower(family2) || '|' || lower(given2), ''), year NULLS LAST, "
    f"CASE WHEN year IS NOT NULL THEN {TS} END, pos",
    "numeric": "pos",
}


def with_cites(select: str, more: str = "") -> str:
    return f"WITH c AS ({CITES}){', ' + more if more else ''} {select}"


def position(family: str) -> str:
    return f"(row_number() OVER (PARTITION BY bibliography_id ORDER BY {ORDER[family]}) - 1)::BIGINT"


def ended(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END)"


QUOTED = "type IN ('article-journal', 'chapter', 'webpage')"
YEAR = "coalesce(year || '.', 'n.d.')"
ACCESS = "coalesce('https://doi.org/' || DOI, URL) || '.'"


def names(family_first: bool) -> str:
    """Authors, else the editor with a label, else null. Given names are one or two words."""
    one = "family || ', B.'" if family_first else "'B. ' || family"
    two = "family2 || ', J. A.'" if family_first else "'J. A. ' || family2"
    editor = "family_e || ', B., ed.'" if family_first else "'B. ' || family_e || ', ed.'"
    return f"coalesce(nullif(concat_ws(', ', coalesce({one}, literal), {two}), ''), {editor})"


def rendered(template: str) -> str:
    people = names(template != "numeric")
    shown = f"coalesce({people}, title)"
    heading = f"CASE WHEN {people} IS NULL THEN NULL WHEN {QUOTED} THEN '“' || title || '.”' ELSE {ended('title')} END"
    middle = {
        "author-date": [YEAR, heading, ended("container_title"), ended("publisher")],
        "notes": [heading, ended("container_title"), "publisher || ','", YEAR],
        "numeric": [heading, ended("container_title"), YEAR],
    }[template]
    return f"concat_ws(' ', {ended(shown)}, {', '.join(middle)}, {ACCESS})"


def encoded(x: str) -> str:
    out = f"url_encode({x})"
    for bad, good in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("+", "%20")):
        out = f"replace({out}, '{bad}', '{good}')"
    return out


def json_text(x: str) -> str:
    return f"to_json({x})::VARCHAR"


FIRST_PAGE = "split_part(page, '–', 1)"
LAST_PAGE = "nullif(split_part(page, '–', 2), '')"
ISO = "(year::VARCHAR || coalesce('-' || lpad(month::VARCHAR, 2, '0'), ''))"
DOI_KEY = "lower(DOI)"
#: Trailing brackets are cut from keys, as from any DOI that ends a sentence.
DOI_MATCH = r"regexp_replace(lower(DOI), '[).,;:\s]+$', '')"
TITLE_MATCH = r"nullif(regexp_replace(lower(title), '[^\p{L}\p{N}\s]', '', 'g'), '')"
AUTHOR_MATCH = r"nullif(regexp_replace(lower(coalesce(family, literal, CASE WHEN family2 IS NOT NULL THEN family2 END)), '[^\p{L}\p{N}\s]', '', 'g'), '')"
