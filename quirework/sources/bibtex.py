"""BibTeX: a brace-balanced reader, as no regular expression can balance braces.

Grammar: @type{key, field = value, ...}; a value is a number, a string macro, a {braced} or "quoted" text, or
several joined by #. Values lose their outer braces; TeX accents, dashes and quotation marks become Unicode.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.schema import DATE, NAMES
from quirework.shipping import ship

#: Entry types in other languages, and the CSL types of BibTeX's.
ALIASES = {"artikel": "article", "buch": "book", "inbuch": "inbook", "insammlung": "incollection"}
TYPES = {
    "article": "article-journal", "book": "book", "booklet": "pamphlet", "collection": "collection", "conference": "paper-conference",
    "inbook": "chapter", "incollection": "chapter", "inproceedings": "paper-conference", "manual": "report",
    "mastersthesis": "thesis", "misc": "document", "online": "webpage", "phdthesis": "thesis", "proceedings": "book",
    "report": "report", "techreport": "report", "thesis": "thesis", "unpublished": "manuscript",
}
#: The string macros that BibTeX styles define.
MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ACCENTS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊"}
SIGNS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı"}
SCHEMA = (
    "citation_key string, type string, title string, container_title string, publisher string, publisher_place string, page string, "
    f"volume string, issue string, edition string, DOI string, URL string, ISBN array<string>, ISSN array<string>, author {NAMES}, "
    f"editor {NAMES}, issued {DATE}"
)


def detex(value: str) -> str:
    """TeX text as Unicode."""

    def accent(m: re.Match) -> str:
        base = m[2] or m[3] or m[4]
        base = {"\\i": "i", "\\j": "j"}.get(base, base)
        return unicodedata.normalize("NFC", base + ACCENTS[m[1]])

    value = re.sub(r"\\([`'^\"~=.])\s*(?:\{(\\?[A-Za-z])\}|(\\[ij])(?![A-Za-z])|([A-Za-z]))", accent, value)
    value = re.sub(r"\\([uvHckr])(?:\s*\{(\\?[A-Za-z])\}|\s+(\\[ij])(?![A-Za-z])|\s+([A-Za-z]))", accent, value)
    value = re.sub(r"\\(ss|ae|AE|oe|OE|aa|AA|[oOlLi])(?![A-Za-z])\s*(?:\{\})?", lambda m: SIGNS[m[1]], value)
    value = re.sub(r"\\(?:emph|textit|textbf|texttt|textsc|url|mbox)\s*\{([^{}]*)\}", r"\1", value)
    value = re.sub(r"\\([&%$#_{}])", r"\1", value)
    value = value.replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("~", " ")
    return re.sub(r"\s+", " ", re.sub(r"[{}]", "", value)).strip()


def split_top(value: str, word: str) -> list[str]:
    """Parts of a text at a word that is not inside braces."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(rf"[{{}}]|{word}", value):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
        elif depth == 0:
            parts.append(value[last : m.start()])
            last = m.end()
    return [*parts, value[last:]]


def names_of(value: str | None) -> list[dict] | None:
    """BibTeX names: 'von Last, First', 'First von Last' or {Body}."""
    if not value:
        return None
    out = []
    for raw in split_top(value, r"\s+and\s+"):
        raw = raw.strip()
        if not raw:
            continue
        if raw.startswith("{") and raw.endswith("}"):
            out.append({"family": None, "given": None, "literal": detex(raw), "ORCID": None})
            continue
        parts = [detex(p) for p in split_top(raw, ",")]
        if len(parts) > 1:
            given = parts[-1]
            family = parts[0] if len(parts) == 2 else f"{parts[0]} {parts[1]}"
        else:
            words = [detex(w) for w in split_top(raw, r"\s+") if w]
            if len(words) == 1:
                out.append({"family": None, "given": None, "literal": "et al." if words[0] == "others" else words[0], "ORCID": None})
                continue
            von = next((k for k, w in enumerate(words[:-1]) if k and w[:1].islower()), len(words) - 1)
            given, family = " ".join(words[:von]), " ".join(words[von:])
        out.append({"family": family, "given": given, "literal": None, "ORCID": None})
    return out or None


def entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, raw fields by lower-case name) of every entry; an entry that does not close is left out."""
    found, macros = [], dict.fromkeys(MONTHS, "")
    macros = {m: m for m in macros}
    for m in re.finditer(r"@\s*([A-Za-z-]+)\s*\{", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0) if text[at - 1] != "\\" else 0
            at += 1
        if depth:
            continue
        body, kind = text[m.end() : at - 1], m[1].lower()
        kind = ALIASES.get(kind, kind)
        if kind in ("comment", "preamble"):
            continue
        key, _, rest = ("", "", body) if kind == "string" else body.partition(",")
        fields = {}
        for part in split_quoted(rest):
            name, equals, value = part.partition("=")
            if equals and name.strip():
                fields[name.strip().lower()] = joined_value(value.strip(), macros)
        if kind == "string":
            macros |= fields
        else:
            found.append((kind, key.strip(), fields))
    return found


def split_quoted(body: str) -> list[str]:
    """Parts at commas outside braces and quotation marks."""
    parts, depth, quoted, last = [], 0, False, 0
    for k, c in enumerate(body):
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == '"' and depth == 0:
            quoted = not quoted
        elif c == "," and depth == 0 and not quoted:
            parts.append(body[last:k])
            last = k + 1
    return [*parts, body[last:]]


def joined_value(value: str, macros: dict[str, str]) -> str:
    out = []
    for part in split_top(value, "#") if value[:1] not in '{"' or "#" in value else [value]:
        part = part.strip()
        bare = part[1:-1] if part[:1] + part[-1:] in ("{}", '""') and len(part) > 1 else macros.get(part.lower(), part)
        out.append(bare)
    return "".join(out)


def record(kind: str, key: str, f: dict[str, str]) -> dict:
    """The typed columns of an entry."""
    text = lambda *names: next((detex(f[n]) for n in names if f.get(n)), None)
    parts: list[int] = []
    date = re.match(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", text("date") or "")
    if date:
        parts = [int(x) for x in date.groups() if x]
    elif (year := re.search(r"\d{4}", text("year") or "")) is not None:
        parts = [int(year[0])]
        month = (text("month") or "").lower()
        number = MONTHS.get(month[:3]) or (int(month) if month.isdigit() and 1 <= int(month) <= 12 else None)
        parts += [number] if number else []
    page = text("pages")
    many = lambda *names: [v for v in [text(*names)] if v] or None
    return {
        "citation_key": key or None,
        "type": TYPES.get(kind, "document"),
        "title": text("title"),
        "container_title": text("journal", "journaltitle", "booktitle"),
        "publisher": text("publisher", "school", "institution", "organization"),
        "publisher_place": text("address", "location"),
        "page": re.sub(r"\s*[–—]\s*", "-", page) if page else None,
        "volume": text("volume"),
        "issue": text("number", "issue"),
        "edition": text("edition"),
        "DOI": text("doi"),
        "URL": text("url"),
        "ISBN": many("isbn"),
        "ISSN": many("issn"),
        "author": names_of(f.get("author")),
        "editor": names_of(f.get("editor")),
        "issued": {"date_parts": [parts], "literal": None, "raw": None} if parts else None,
    }


def read_bibtex(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """SRC-5, SRC-6: one row per entry: the key columns, entry (its number in the text) and the record."""
    ship(rows.sparkSession)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)

    def scan(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for k, entry in enumerate(entries(row[text] or "")):
                    out.append({key: row[key] for key in keys} | {"entry": k} | record(*entry))
            yield pd.DataFrame(out, columns=[*keys, "entry", *[x.split()[0] for x in re.split(r", (?=[A-Za-z_]+ )", SCHEMA)]])

    return rows.select(*keys, F.col(text)).mapInPandas(scan, f"{head}, entry int, {SCHEMA}")
