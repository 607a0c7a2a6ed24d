"""Compiled styles against an interpreter, over records of all types and of any shape."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.functions.csl import FOLDER, Style, full_style
from quirework.operators.disambiguate import disambiguated, rendered_apart
from quirework.operators.sets import csl
from quirework.schema import CITATION_COLUMNS, CITATION_DDL, CSL_TYPES, STYLES, column_name
from quirework.schema import style as style_row
from tests.csl_interpreter import Entry

TEXTS = {
    "title": ["A study", "Who goes there?", "Notes on X.", "the small things", "Stop!", "Ação e reação"],
    "container-title": ["Journal of Things", "The Whole", "Proc."], "publisher": ["Press", "Some Univ. Press", "Acme Inc."],
    "page": ["5-9", "101-108", "321–328", "1496--1504", "42", "e12", "100-104", "107–8", "11564-68", "12, 15-17", "1003–1005", "600-613", "208 - 209"],
    "volume": ["3", "12", "IV", "2-3"], "issue": ["1", "2/3", "4"], "DOI": ["10.1000/x.y", "10.5/(a)"], "URL": ["https://example.org/a."],
    "edition": ["1", "2", "3", "11", "21", "112", "rev."], "genre": ["PhD thesis", "map"], "publisher-place": ["London", "São Paulo"],
}
PEOPLE = [
    {"family": "Doe", "given": "Jane Mary"}, {"family": "van Roe", "given": "Jean-Luc"}, {"literal": "World Body Inc."}, {"family": "Solo"},
    {"given": "Cher"}, {"family": " Ng ", "given": " t. "}, {"family": "Müller", "given": "Ä"}, {"family": "", "given": "", "literal": ""},
]


def random_records(n, seed):
    rng = random.Random(seed)
    records = []
    for k in range(n):
        r = {"type": CSL_TYPES[k % len(CSL_TYPES)]}
        for name, values in TEXTS.items():
            r[name] = rng.choice([None, "", *values, *values])
        for name in ("author", "editor"):
            r[name] = [rng.choice(PEOPLE) for _ in range(rng.choice([0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 12, 22]))]
        date = rng.choice([None, [[2001]], [[1999, 5]], [[2010, 12, 3]], [[1998], [2001]], [[2003], [2003]], [[0]], []])
        r["issued"] = rng.choice([None, (date, None), (date, "spring of that year"), (date, "")])
        records.append(r)
    return records


def frame(spark, records):
    rows = []
    for k, r in enumerate(records):
        row = {"bibliography_id": 1, "pos": k, "id": f"c{k}", "ISBN": [], "ISSN": []} | {column_name(n): v for n, v in r.items()}
        for name in ("author", "editor"):
            row[name] = [(p.get("family"), p.get("given"), p.get("literal"), None) for p in r[name]]
        row["issued"] = None if r["issued"] is None else (*r["issued"], None)
        rows.append(tuple(row.get(c) for c in CITATION_COLUMNS))
    return spark.createDataFrame(rows, CITATION_DDL)


def compare(spark, xml, locale, records):
    out = frame(spark, records).select("pos", Style(xml, locale).bibliography(csl(), number=F.col("pos") + 1).alias("text")).collect()
    for r in out:
        want = Entry(xml, locale, records[r["pos"]], r["pos"] + 1).text()
        assert (r["text"] or "") == want, records[r["pos"]]


@pytest.mark.parametrize("key", [row[0] for row in STYLES])
def test_full_styles(spark, key):
    with open(os.path.join(FOLDER, f"{key}.csl"), encoding="utf-8") as file:
        compare(spark, file.read(), style_row(key)["locale"], random_records(460, key))


def test_styles_differ(spark):
    record = {"type": "article-journal", "author": [PEOPLE[0], PEOPLE[1]], "editor": [], "issued": ([[2001, 5]], None)}
    record |= {"title": "A study", "container-title": "Journal", "volume": "3", "issue": "2", "page": "101-108", "DOI": "10.1/x"}
    df = frame(spark, [record])
    texts = {row[0]: df.select(full_style(row[0]).bibliography(csl(), number=F.col("pos") + 1)).first()[0] for row in STYLES}
    assert texts == {
        "chicago-notes-bibliography": "Doe, Jane Mary, and Jean-Luc van Roe. “A study.” Journal 3, no. 2 (2001): 101–8. https://doi.org/10.1/x.",
        "chicago-author-date": "Doe, Jane Mary, and Jean-Luc van Roe. 2001. “A study.” Journal 3 (2): 101–8. https://doi.org/10.1/x.",
        "apa-7": "Doe, J. M., & van Roe, J.-L. (2001). A study. Journal, 3(2), 101–108. https://doi.org/10.1/x",
        "mla-9": "Doe, Jane Mary, and Jean-Luc van Roe. “A study.” Journal, vol. 3, no. 2, 2001, pp. 101–08, https://doi.org/10.1/x.",
        "harvard": "Doe, J.M. and van Roe, J.-L. (2001), “A study.” Journal, 3(2), pp. 101–108. doi:10.1/x.",
        "ieee": "[1] J. M. Doe and J.-L. van Roe, “A study,” Journal, vol. 3, no. 2, May 2001, pp. 101–108, doi: 10.1/x.",
        "vancouver": "1. Doe JM, van Roe J-L. A study. Journal. 2001 May;3(2):101–8. doi:10.1/x.",
        "oscola": "Doe JM and van Roe J-L, ‘A study’ (2001) 3(2) Journal 101–08 doi:10.1/x",
        "abnt": "DOE, Jane Mary; VAN ROE, Jean-Luc. A study. Journal, v. 3, n. 2, p. 101–108, maio 2001. DOI: 10.1/x.",
    }


MADE = """<style xmlns="http://purl.org/net/xbiblio/csl" version="1.0" class="note" {opts}><macro name="m"><text variable="volume"/><text value="x"/></macro>
<locale xml:lang="en"><style-options punctuation-in-quote="false"/><terms><term name="in">within</term><term name="page" form="short"><single>pg</single><multiple>pgs</multiple></term></terms></locale>
<bibliography {bib}><sort><key variable="issued" sort="descending"/><key variable="title"/></sort><layout prefix="[" suffix="]">{body}</layout></bibliography></style>"""
BODIES = {
    "nested groups": '<group delimiter="; "><group prefix="(" suffix=")" delimiter="/"><text value="no"/><text variable="volume"/><group><text term="in"/><text variable="issue" prefix="-"/></group></group><text macro="m"/></group>',
    "tests": '<choose><if type="book chapter" match="none" variable="URL"><text value="a"/></if><else-if is-numeric="volume edition"><text value="b"/></else-if><else-if variable="DOI URL" match="any"><text variable="DOI"/></else-if></choose><text value="."/>',
    "two kinds of names": '<names variable="author editor" delimiter="; "><label form="verb" suffix=" "/><name form="short" and="text" et-al-min="3" et-al-use-first="2"/></names><text variable="title" prefix=", " quotes="true" suffix=","/>',
    "names before et al.": '<names variable="editor"><name delimiter="; " name-as-sort-order="first" delimiter-precedes-last="after-inverted-name" delimiter-precedes-et-al="after-inverted-name" and="symbol" et-al-min="3" et-al-use-first="1"/></names>',
    "dates": '<date variable="issued" form="numeric"/><date variable="issued" form="text" date-parts="year-month" prefix=" / "/><date variable="issued" delimiter="-" prefix=" "><date-part name="year"/><date-part name="month" form="numeric-leading-zeros"/><date-part name="day" form="numeric-leading-zeros"/></date>',
    "case and labels": '<text variable="title" text-case="uppercase" strip-periods="true"/><label variable="page" form="short" prefix=" " plural="always"/><text variable="page" prefix=" "/><number variable="edition" form="ordinal" prefix=", "/>',
}


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("opts", ["", 'page-range-format="minimal"', 'page-range-format="expanded" initialize-with=". "'])
def test_elements(spark, body, opts):
    xml = MADE.format(opts=opts, bib='names-delimiter=" + "', body=BODIES[body])
    compare(spark, xml, "en-GB", random_records(92, body + opts))


def apart_by_hand(records, least, first):
    """(names shown, letters, label) of each record of one bibliography."""
    told = []
    for r in records:
        names = r["author"] or r["editor"]
        shorts = [s for s in (n.get("family") or n.get("literal") or n.get("given") for n in names) if s]
        issued = r["issued"]
        told.append((shorts, issued and issued[0] and issued[0][0] and issued[0][0][0] or None, r["title"] or ""))

    def shown(shorts, k):
        if k < len(shorts):
            return ", ".join(shorts[:k]) + " et al."
        return shorts[0] if k == 1 else ", ".join(shorts[:-1]) + (", and " if k > 2 else " and ") + shorts[-1]

    options = [[(k, shown(s, k)) for k in range(min(first, len(s)) if len(s) >= least else len(s), len(s) + 1)] if s else [] for s, _, _ in told]
    heads, widths = [], []
    for (shorts, year, title), own in zip(told, options, strict=True):
        clash = lambda text: any(other != shorts and y == year and text in [t for _, t in o] for (other, y, _), o in zip(told, options, strict=True))  # noqa: B023, E731
        best = next(((k, t) for k, t in own if not clash(t)), (len(shorts), shown(shorts, len(shorts)) if shorts else title))
        widths.append(best[0])
        heads.append(best[1])
    out = []
    for k, (_, year, _) in enumerate(told):
        same = sorted((re.sub(r"^(?i:a|an|the)\s+", "", told[j][2]).lower(), j) for j in range(len(told)) if heads[j] == heads[k] and told[j][1] == year)
        letter = None
        if len(same) > 1:
            n, letter = [j for _, j in same].index(k) + 1, ""
            while n:
                n, letter = (n - 1) // 26, chr(97 + (n - 1) % 26) + letter
        when = f"{year}{letter or ''}" if year else "n.d." + (f"-{letter}" if letter else "")
        out.append((widths[k], letter, f"{heads[k]}, {when}" if heads[k] else when))
    return out


@pytest.mark.parametrize(("least", "first"), [(3, 1), (2, 1), (4, 3)])
def test_records_told_apart(spark, least, first):
    rng = random.Random(least)
    records = random_records(150, "apart")
    for r in records:
        r["author"] = [{"family": rng.choice("AB") if k else "Doe"} for k in range(rng.choice([0, 1, 2, 3, 4, 5]))]
        r["editor"] = []
        r["issued"] = ([[rng.choice([2001, 2002])]], None) if rng.random() < 0.9 else None
    out = {r["pos"]: (r["names_shown"], r["year_suffix"], r["label"]) for r in disambiguated(frame(spark, records), least, first).collect()}
    expected = apart_by_hand(records, least, first)
    assert [out[k] for k in range(len(records))] == expected
    assert len({label for _, _, label in expected}) == len(records)
    assert any(len(letter or "") == 1 for _, letter, _ in expected) and {w for w, _, _ in expected} > {1, 2, 3}


def test_letters_stand_after_the_year(spark):
    works = [{"type": "book", "title": t, "author": [{"family": "Doe", "given": "J"}], "editor": [], "issued": i} for t, i in (("Beta", ([[2001]], None)), ("Alpha", ([[2001]], None)), ("C", None), ("D", None))]
    texts = {k: [r["text"] for r in rendered_apart(frame(spark, works), k).orderBy("pos").collect()] for k in ("apa-7", "chicago-author-date", "harvard")}
    assert texts == {
        "apa-7": ["Doe, J. (2001b). Beta.", "Doe, J. (2001a). Alpha.", "Doe, J. (n.d.-a). C.", "Doe, J. (n.d.-b). D."],
        "chicago-author-date": ["Doe, J. 2001b. Beta.", "Doe, J. 2001a. Alpha.", "Doe, J. n.d.-a. C.", "Doe, J. n.d.-b. D."],
        "harvard": ["Doe, J. (2001b), Beta.", "Doe, J. (2001a), Alpha.", "Doe, J. (n.d.-a), C.", "Doe, J. (n.d.-b), D."],
    }
    assert disambiguated(frame(spark, works).limit(0)).count() == 0


def test_records_told_apart_are_dealt_once(spark):
    df = frame(spark, random_records(60, "dealt")).repartition(3)
    plan = disambiguated(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_unknown_elements_are_refused():
    for body in ('<blink variable="title"/>', '<text macro="nothing"/>', '<choose><if moon="full"><text value="x"/></if></choose>', '<text variable="title" text-case="wavy"/>'):
        style = Style(MADE.format(opts="", bib="", body=body))
        with pytest.raises(ValueError):
            style.bibliography({"type": F.lit("book"), "title": F.lit("t")})


def test_own_order(spark):
    records = random_records(60, "order")
    df = frame(spark, records)
    style = Style(MADE.format(opts="", bib="", body='<text variable="title"/>'))
    got = [r["pos"] for r in df.orderBy(*style.sort_keys(csl()), "pos").collect()]

    def key(k):
        issued = records[k]["issued"]
        year = issued and issued[0] and issued[0][0] and issued[0][0][0] or None
        title = records[k]["title"] or None
        return (year is None, -(year or 0), title is None, (title or "").lower(), k)

    assert got == sorted(range(60), key=key)
    by_name = [r["pos"] for r in df.orderBy(*full_style("apa-7").sort_keys(csl()), "pos").collect()]
    assert sorted(by_name) == list(range(60)) and by_name != got
